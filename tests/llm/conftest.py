import pytest

# Every operator meets these: nulls, empty and blank texts, ties, repeated rows, odd scripts, names that clash.
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from the angry farmer today"),
    (2, "The quick brown fox jumps over the lazy dog and runs away from the angry farmer today"),
    (2, "The quick brown fox jumps over the lazy dog and runs away from the angry farmer today"),
    (3, None), (4, ""), (5, " \t\n "), (None, "no id here but some words"), (None, None),
    (6, "ÀÉ straße 漢字 한글   😀 <|endoftext|> x\x1cy it's 12,5"), (7, "1234 --- 5678"),
    (8, "word " * 5000), (9, "x" * 30000), (10, "Released under the MIT License."),
]
CLASHES = "id string, body string, node string, row string, value string, text0 string, n_chunks string, lang_pred string, shard string, view0 string, key string"


@pytest.fixture(scope="module")
def odd(spark):
    """The texts with columns whose names the operators use themselves."""
    names = [c.split()[0] for c in CLASHES.split(", ")]
    rows = [(i, t, "en" if t and i and i < 3 else None, "s", len(t or ""), *names) for i, t in TEXTS]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {CLASHES}")


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)
