"""Delimited files in splits against ``csv.reader`` over the whole file."""

import csv
import io
import random

import pytest

from plumbline.sources.delimited import read_delimited

PARTS = ['"', '"', ",", "a", "b", "\n", "\r", "\r\n", '""', ',"', '"\n', "é"]


def whole(data: bytes, delimiter=","):
    return list(csv.reader(io.StringIO(data.decode("utf-8-sig"), newline=""), delimiter=delimiter))


@pytest.fixture
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {n: spark.conf.get(n, None) for n in names}
    spark.conf.set(names[0], "97")
    spark.conf.set(names[1], "1")
    spark.conf.set(names[2], "1")
    yield
    for n, v in before.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def read(spark, folder):
    rows, bad = read_delimited(spark, f"file://{folder}")
    got = {}
    for r in rows.collect():
        got.setdefault(r.path.rsplit("/", 1)[-1], {})[r.row_i] = list(r.cells)
    assert all(sorted(x) == list(range(len(x))) for x in got.values())
    return {n: [x[i] for i in range(len(x))] for n, x in got.items()}, {r.path.rsplit("/", 1)[-1]: r.message for r in bad.collect()}


def test_any_mix_of_quotes_and_line_ends(spark, tmp_path, small_splits):
    """Files of several splits each: quotes open over borders, quotes inside fields, bare carriage returns, none of a last line feed."""
    rng = random.Random(4)
    files = {}
    for i in range(60):
        data = "".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 400))).encode()
        files[f"{i} a+b%20.{'csv' if i % 3 else 'tsv'}"] = (b"\xef\xbb\xbf" if i % 5 == 0 else b"") + data
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "empty.csv").write_bytes(b"")
    (tmp_path / "bad.csv").write_bytes(b"a,b\n" * 80 + b"\xff\n")
    (tmp_path / "other.txt").write_bytes(b"no")
    got, bad = read(spark, tmp_path)
    assert list(bad) == ["bad.csv"] and "UTF-8" in bad["bad.csv"]
    want = {n: whole(d, "\t" if n.endswith("tsv") else ",") for n, d in files.items()}
    assert got == {n: rows for n, rows in want.items() if rows}


def test_a_record_over_many_splits(spark, tmp_path, small_splits):
    data = 'x,y\n1,"' + "line ""quoted"" and more\n".replace('"', '""') * 40 + '",z\n2,3\n' + '"never closed\n' + "and on\n" * 30
    (tmp_path / "a.csv").write_text(data)
    got, _ = read(spark, tmp_path)
    assert got["a.csv"] == whole(data.encode()) and len(got["a.csv"]) == 4


def test_a_large_file_in_many_tasks(spark, tmp_path):
    """Twelve MB with quoted line feeds, over splits of 256 KB."""
    out = io.StringIO()
    writer = csv.writer(out)
    rng = random.Random(9)
    for i in range(90_000):
        writer.writerow([i, "a \"quoted\"\ntext, of two lines" if i % 3 == 0 else "plain", "x" * rng.randrange(200), "" if i % 7 else "\n\n"])
    data = out.getvalue().encode()
    (tmp_path / "a.csv").write_bytes(data)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    try:
        rows, _ = read_delimited(spark, f"file://{tmp_path}")
        got = {r.row_i: list(r.cells) for r in rows.toLocalIterator()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [got[i] for i in range(len(got))] == whole(data)
