"""Row-local text expressions; all of them are legal on a streaming DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The characters Python's str.strip() and \s treat as blank.
BLANKS = (
    r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
BLANK = f"[{BLANKS}]"

# Characters counted per language, in tie order.
SCRIPTS = {
    "ko": "[가-힣]",
    "en": "[a-zA-Z]",
    "zh": r"[\x{4e00}-\x{9fff}]",
    "ja": r"[\x{3040}-\x{309f}\x{30a0}-\x{30ff}]",
}

POSITIVE, NEGATIVE, NEUTRAL = "positive", "negative", "neutral"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_text(c: Column | str) -> Column:
    return F.coalesce(_col(c).cast("string"), F.lit(""))


def strip_blanks(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), f"^{BLANK}+|{BLANK}+$", "")


def is_blank(c: Column | str) -> Column:
    return ~as_text(c).rlike(f"[^{BLANKS}]")


def strip_html(c: Column | str) -> Column:
    tagless = F.regexp_replace(_col(c), "<[^>]+>", " ")
    return F.trim(F.regexp_replace(tagless, f"{BLANK}+", " "))


def truncate(c: Column | str, n: int, ellipsis: str = "") -> Column:
    c = _col(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(ellipsis))).otherwise(c)


def sign_label(score: Column | str) -> Column:
    """positive above zero, negative below, neutral at zero (integer scores)."""
    s = _col(score)
    return F.when(s >= 1, POSITIVE).when(s <= -1, NEGATIVE).otherwise(NEUTRAL)


sentiment_label = sign_label


def script_counts(c: Column | str) -> dict[str, Column]:
    text = as_text(c)
    return {lang: F.regexp_count(text, F.lit(chars)).cast("long") for lang, chars in SCRIPTS.items()}


def _winner(counts: dict[str, Column]) -> Column:
    best = F.greatest(*counts.values())
    pick = F.when(best == 0, "en")
    for lang, n in counts.items():
        pick = pick.when(n == best, lang)
    return pick


def language_of(c: Column | str) -> Column:
    """Language of one text by its most frequent script."""
    counts = F.struct(*[n.alias(lang) for lang, n in script_counts(c).items()])
    # One-element transform: the counts are computed once, then compared.
    return F.element_at(
        F.transform(F.array(counts), lambda s: _winner({k: s[k] for k in SCRIPTS})), 1
    )


def detect_language(df: DataFrame, text: str) -> DataFrame:
    """One row ``(language)``: the script that dominates all texts, in one aggregation."""
    totals = df.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(lang) for lang, n in script_counts(text).items()])
    return totals.select(_winner({k: F.col(k) for k in SCRIPTS}).alias("language"))
