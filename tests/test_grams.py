import random

import pytest
from pyspark.sql import functions as F

from shoplens.functions import grams
from shoplens.operators import reviews as rv
from tests.test_reviews import texts


@pytest.mark.parametrize("few", [0, 300])
@pytest.mark.parametrize("count", [5, 400, 3000])
def test_contained_equals_a_search_for_each_word(spark, monkeypatch, few, count):
    monkeypatch.setattr(grams, "FEW", few)
    rng = random.Random(count)
    letters = "abé배😀 \n.$"
    words = list(dict.fromkeys("".join(rng.choice(letters) for _ in range(rng.randrange(1, 9))) for _ in range(count)))
    bodies = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 200))) for _ in range(40)] + ["", "ab", None, words[0], words[-1] * 3]
    found = texts(spark, *bodies).select("id", grams.contained(F.col("text"), words).alias("places")).collect()
    for row in found:
        body = bodies[row.id]
        assert row.places == (None if body is None else [i for i, w in enumerate(words) if w in body])


def test_long_lists_keep_order_and_first_category(spark):
    words = [f"word{i:05d}x" for i in range(2000)]
    taxonomy = [("first", words[:900]), ("none", []), ("second", [*words[800:], "zz"])]
    df = texts(spark, words[1999], words[850], f"{words[1999]} {words[3]}", "zz", "word", None)
    assert [r.category for r in rv.classify(df, "text", taxonomy).orderBy("id").collect()] == [
        "second", "first", "first", "second", "unclassified", "unclassified"]
    lexicon = [(w, i % 3 - 1) for i, w in enumerate(words)] + [("word", 5)]
    scored = rv.score_sentiment(df, "text", lexicon).orderBy("id").collect()
    assert [r.score for r in scored] == [5 + 1999 % 3 - 1, 5 + 850 % 3 - 1, 5 + 1999 % 3 - 1 + 3 % 3 - 1, 0, 5, 0]
    assert scored[2].keywords == f"{words[3]}, {words[1999]}, word"


def test_matching_runs_once_and_not_at_the_scan(spark, tmp_path):
    texts(spark, "good", "bad").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t")).repartition(2, "id")
    plan = rv.top_keywords(rv.score_sentiment(df, "text", [("good", 1), ("bad", -1)]))._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Repartition"):]
    assert plan.lower().count("contains(") == 1 and "contains(" not in below.lower()


def test_words_with_nul_are_refused():
    with pytest.raises(ValueError):
        grams.contained(F.lit("x"), ["a\x00b"])
