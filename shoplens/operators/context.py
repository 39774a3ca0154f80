"""Text context of a run or a conversation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shoplens.functions.text import as_text, is_blank, strip_html

CONTEXT_PARTS = ("analysis", "summary", "details")


def last_turns(conversations: DataFrame, k: int = 10, by: str = "conv_id", turn: str = "turn") -> DataFrame:
    """The last k turns of each conversation, with ``back`` = 1 for the newest.

    Every task keeps at most k rows per conversation before the shuffle.
    """
    newest = W.partitionBy(by).orderBy(F.desc(turn))
    return conversations.withColumn("back", F.row_number().over(newest)).where(F.col("back") <= k)


def join_parts(parts: Sequence[Column]) -> Column:
    """Parts joined by a blank line; blank ones are skipped."""
    return F.array_join(F.array_compact(F.array(*[F.when(~is_blank(p), p) for p in parts])), "\n\n")


def build_context(
    parts: DataFrame,
    kinds: Sequence[str] = CONTEXT_PARTS,
    by: str = "job_id",
    kind: str = "part",
    html: str = "html",
    labels: Mapping[str, str] | None = None,
) -> DataFrame:
    """``(<by>, context)`` from rows ``(<by>, part, html)``, in the order of ``kinds``.

    Parts of one kind follow each other by their text; other kinds come last, by name.
    ``labels`` puts a text in front of the non-blank parts of a kind.
    """
    plain = strip_html(as_text(html))
    for x, label in (labels or {}).items():
        plain = F.when((F.col(kind) == x) & (plain != ""), F.concat(F.lit(label), plain)).otherwise(plain)
    place = F.array_position(F.array(*[F.lit(x) for x in kinds]), F.col(kind))
    place = F.when(place > 0, place).otherwise(len(kinds) + 1)
    listed = parts.groupBy(by).agg(
        F.sort_array(F.collect_list(F.struct(place.alias("place"), as_text(kind).alias("kind"), plain.alias("line")))).alias("parts"))
    lines = F.filter(F.col("parts")["line"], lambda x: ~is_blank(x))
    return listed.select(by, F.array_join(lines, "\n\n").alias("context"))


def conversation_context(conversations: DataFrame, k: int = 10) -> DataFrame:
    """``(conv_id, context)``: the last k turns as ``role: text``, oldest first."""
    line = F.concat(F.col("role"), F.lit(": "), strip_html(as_text("text")))
    turns = last_turns(conversations.select("conv_id", "turn", line.alias("line")), k)
    wide = turns.groupBy("conv_id").agg(
        *[F.max(F.when(F.col("back") == b, F.col("line"))).alias(f"back_{b}") for b in range(k, 0, -1)]
    )
    return wide.select("conv_id", join_parts([F.col(f"back_{b}") for b in range(k, 0, -1)]).alias("context"))
