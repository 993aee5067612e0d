"""Quoted CSV read by many tasks equals the reader that takes a file whole."""

import random

import pytest
from pyspark.sql import functions as F

from folioquery.sources import quoted, tables


def cut_at(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")


@pytest.fixture
def splits(spark):
    yield lambda size: cut_at(spark, size)
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def cells(df):
    return sorted((r.file_name, r.row_no, tuple(r.headers), tuple(r.cells)) for r in df.collect())


def some_csv(seed, records):
    rnd = random.Random(seed)
    plain = ["", "x", "ab c", "ñ", 'in"side', "tail\"", "1.5", "NA"]
    inside = ["", "a,b", "two\nlines", 'say ""hi""', '""', "\n\n", ",", '"",""', "x\r\ny", '""\n""', " pad "]
    cell = lambda: rnd.choice(plain) if rnd.random() < 0.5 else '"' + rnd.choice(inside) + '"'
    rows = ['a,"b\nc",d'] + [",".join(cell() for _ in range(3)) for _ in range(records)]
    return "".join(r + rnd.choice(["\n", "\n", "\n\n"]) for r in rows)


def test_files_cut_at_every_byte(spark, tmp_path, splits):
    text = 'a,"b\nc"\n1,"x\n""y"",\nz"\n\n"",""\n2,"p,""\n"\n3,q"r\n"",t\n4,"u""'
    (tmp_path / "f.csv").write_text(text + '"', encoding="utf-8")
    want = cells(tables.csv_cells(spark, str(tmp_path), whole_files=True))
    assert [r[1] for r in want] == [2, 3, 4, 5, 6, 7]
    for size in (1, 7):  # splits of one byte cut the file at every byte
        splits(size)
        assert cells(tables.csv_cells(spark, str(tmp_path))) == want, size


def test_random_files(spark, tmp_path, splits):
    for n in range(3):
        (tmp_path / f"f{n}.csv").write_bytes(some_csv(n, 120 * n + 1).encode("utf-8-sig" if n == 1 else "utf-8"))
    want = cells(tables.csv_cells(spark, str(tmp_path), whole_files=True))
    for size in (37, 1 << 20):
        splits(size)
        assert cells(tables.csv_cells(spark, str(tmp_path))) == want


def test_carriage_returns_before_line_ends(spark, tmp_path, splits):
    (tmp_path / "f.csv").write_bytes(b'a,b\r\n1,"x\r\ny"\r\n\r\n2,z\n3,"w"\r\n')
    splits(3)
    assert [r[1:2] + r[3:] for r in cells(tables.csv_cells(spark, str(tmp_path)))] == [(2, ("1", "x\r\ny")), (3, ("2", "z")), (4, ("3", "w"))]


def test_a_large_file_has_many_tasks(spark, tmp_path, splits):
    (tmp_path / "f.csv").write_text("a,b\n" + "".join(f'{i},"line\nbreak {i}"\n' for i in range(3000)), encoding="utf-8")
    splits(8192)
    lines = spark.read.option("lineSep", "\n").text(str(tmp_path))
    assert lines.rdd.getNumPartitions() > 5
    got = tables.csv_documents(spark, str(tmp_path)).select("row_no", "text").collect()
    assert sorted(map(tuple, got)) == [(i + 2, f"a: {i}. b: line\nbreak {i}") for i in range(3000)]


@pytest.mark.parametrize("line, from_out, from_in", [
    ("a,b", False, True), ('"a', True, False), ('a"b', False, False), ('"a",b', False, False), ('x",y', False, False),
    ('x","y', True, True), ('""', False, True), ('"""', True, False), (',"', True, False), ('a,"b""', True, False), ("", False, True)])
def test_states_of_a_line(spark, line, from_out, from_in):
    got = spark.createDataFrame([(line,)], "x string").select(
        quoted.ends_inside(F.col("x"), False), quoted.ends_inside(F.col("x"), True)).first()
    assert tuple(got) == (from_out, from_in)
