import random

import pytest

import corpus_pipeline
from shoplens.llm.bpe import bpe_of
from shoplens.llm.queries import word_bpe

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    path = tmp_path_factory.mktemp("tables")
    item, passage = words(rng, 40), words(rng, 80)
    texts = {i: words(rng, 120) for i in range(40)}
    texts[50] = texts[1]  # an exact copy
    near = texts[2].split()
    near[60] = "changed"
    texts[51] = " ".join(near)
    for i in (3, 4, 5):
        texts[i] = " ".join([words(rng, 60), passage, words(rng, 60)])
    texts[6] = " ".join([words(rng, 50), item, words(rng, 50)])
    texts |= {60: None, 61: "", 62: "123 456 !!"}
    rows = [(i, t, "xx", "s", len(t or "")) for i, t in texts.items()] + [(1, texts[1], "xx", "s", 1), (None, words(rng, 50), None, "s", 1)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(0, item), (1, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), texts, passage


def stages(spark, docs, path):
    out = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
        out.append(docs)
    return out


def test_every_stage_keeps_clean_rows_and_catches_the_others(spark, folder):
    path, texts, passage = folder
    found = stages(spark, spark.read.parquet(f"{path}/documents.parquet"), path)
    kept = [[(r.doc_id, r.text) for r in df.collect()] for df in found[:4]]
    ids = [sorted(i for i, _ in rows if i is not None) for rows in kept]
    clean = [i for i in range(40)]
    assert ids[0] == sorted([*clean, 1, 50, 51])  # those without letters went
    assert ids[1] == ids[2] == clean
    assert ids[3] == [i for i in clean if i != 6]
    assert all(any(i is None for i, _ in rows) for rows in kept)
    last = dict(kept[2])
    assert all(last[i] == texts[i] for i in clean if i not in (4, 5))
    assert last[3] == texts[3] and all(passage not in last[i] and texts[i].startswith(last[i][:200]) for i in (4, 5))
    assert found[2].columns == [c.split()[0] for c in COLUMNS.split(", ")]
    tokens = {r.doc_id: r.n_tokens for r in found[4].collect()}
    own = bpe_of(word_bpe())
    assert tokens == {i: len(own.encode(t)) // 4 for i, t in kept[3]}


def test_run_writes_every_stage(spark, folder):
    assert corpus_pipeline.run(spark, folder[0]).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_odd_rows_and_none(spark, folder, odd, none):
    for df in stages(spark, odd, folder[0])[:4]:
        assert df.columns == odd.columns and {r.key for r in df.select("key").collect()} <= {"key"}
    assert all(df.count() == 0 for df in stages(spark, none, folder[0]))
