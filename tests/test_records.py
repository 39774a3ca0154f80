"""CSV records over many ranges, against the reader that takes a file in one task."""

import csv
import random
from contextlib import contextmanager

import pytest

from shoplens.sources.readers import read_any, read_table
from shoplens.sources.records import csv_records

SCHEMA = "id string, text string, note string"


@contextmanager
def ranges_of(spark, size):
    keys = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def write(path, rows, end="\n"):
    with open(path, "w", newline="", encoding="utf-8") as f:
        csv.writer(f, lineterminator=end).writerows([["id", "text", "note"], *rows])


def cell(rng):
    pieces = ["a", "안녕", ",", "\n", "\n\n", '"', '""', '"\n"', "\r\n", " ", "long " * 20]
    return "x" + "".join(rng.choice(pieces) for _ in range(rng.randrange(6))) + "y"


@pytest.mark.parametrize("seed,size,end", [(1, 150, "\n"), (2, 400, "\r\n"), (3, 1 << 20, "\n")])
def test_records_equal_other_readers(spark, tmp_path, rows, seed, size, end):
    rng, given = random.Random(seed), []
    for name in ("a", "b"):
        given += (own := [(f"{name}{i}", cell(rng), cell(rng)) for i in range(20)])
        write(tmp_path / f"{name}.csv", own, end)
    with ranges_of(spark, size):
        got = read_table(spark, str(tmp_path), SCHEMA, multiline="split")
        assert rows(got) == sorted(given)
        assert size > 1000 or got.rdd.getNumPartitions() > 8
    if end == "\n":
        assert rows(read_table(spark, str(tmp_path), SCHEMA, multiline=True)) == sorted(given)


def test_a_record_over_many_ranges(spark, tmp_path, rows):
    long = "\n".join(f'line {i}, "quoted"' for i in range(40))
    write(tmp_path / "t.csv", [("1", long, "end"), ("2", "x", long), ("3", "y", "z")])
    with ranges_of(spark, 200):
        assert rows(read_table(spark, str(tmp_path / "t.csv"), SCHEMA, multiline="split")) == [
            ("1", long, "end"), ("2", "x", long), ("3", "y", "z")]


def test_a_header_over_two_lines_and_blank_lines(spark, tmp_path, rows):
    (tmp_path / "t.csv").write_bytes(b'\n\n"the\nid",t\n\n1,"a\n\nb"\n   \n2,\n3,"c\xff\nd"')
    for size in (6, 1 << 20):
        with ranges_of(spark, size):
            got = read_any(spark, str(tmp_path / "t.csv"), multiline="split")
            assert got.columns == ["the\nid", "t"]
            assert rows(got) == [(1, "a\n\nb"), (2, None), (3, "c\ufffd\nd")]


def test_plain_files_need_no_second_reader(spark, tmp_path, rows):
    write(tmp_path / "t.csv", [("1", 'a, "b"', ""), ("2", "", "c")])
    assert csv_records(spark, str(tmp_path / "t.csv")) is None
    assert rows(read_table(spark, str(tmp_path / "t.csv"), SCHEMA, multiline="split")) == [("1", 'a, "b"', None), ("2", None, "c")]
    (tmp_path / "empty.csv").write_text("")
    assert csv_records(spark, str(tmp_path / "empty.csv")) is None


def test_an_open_cell_is_an_error(spark, tmp_path):
    (tmp_path / "t.csv").write_text('id,t\n1,"a\n2,b\n')
    with pytest.raises(ValueError, match="does not end"):
        read_table(spark, str(tmp_path / "t.csv"), multiline="split")
