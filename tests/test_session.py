from pathlib import Path

from shoplens import session
from shoplens.operators import graph


def test_loops_drop_their_rounds(spark, tmp_path, monkeypatch):
    chain = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}", 1) for i in range(9)], "w1 string, w2 string, weight long")
    session.release()
    monkeypatch.setattr(session, "checkpoint_dir", lambda _: f"file://{tmp_path}")
    found = graph.components(chain)
    assert {r.component for r in found.collect()} == {"n00"} and len(list(Path(tmp_path).iterdir())) == 1
    assert graph.communities(chain).count() == 10
    session.release()
    assert not list(Path(tmp_path).iterdir())


def test_kept_tables_are_released(spark):
    session.release()
    kept = session.reuse(spark.range(5).selectExpr("id * 7 AS x"))
    last = session.next_round(kept.selectExpr("x + 1 AS x"))
    last = session.next_round(last.selectExpr("x + 1 AS x"), last)
    assert kept.is_cached and sorted(r.x for r in last.collect()) == [2, 9, 16, 23, 30]
    session.release()
    assert not kept.is_cached and kept.count() == 5
