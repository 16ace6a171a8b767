import random

import duckdb
import pytest
from pyspark.sql import functions as F

from plumbline import queries
from plumbline.operators import audits, values
from tests.test_screen import cells

DATA = "/root/testdata/sf0.001"


def test_steps_over_parts_of_a_column_carry_places_and_values_alone(spark, monkeypatch):
    monkeypatch.setattr(values, "PART", 40)
    rng = random.Random(5)
    a = [rng.choice([None, "x", "", f"{rng.random() * 9:.2f}", "1e2", "1,000", "7%"]) for _ in range(100)] + [None] * 200 + [f"{rng.random():.1f}" for _ in range(50)]
    parsed = [None if v in (None, "x", "") else float(v.replace(",", "").rstrip("%")) for v in a]
    numbers = [v for v in parsed if v is not None]
    out = values.lagged(cells(spark, {"t": {"a": a, "b": [1] * 350}}))
    assert set(out.columns) == {"table_index", "col_i", "row_i", "val", "before", "d"}
    got = [(r.val, r.before and r.before.val) for r in out.where("col_i = 0").orderBy("row_i").collect()]
    assert got == list(zip(numbers, [None, *numbers[:-1]]))


def test_texts_are_counted_before_the_shuffle_and_first_rows_are_found(spark):
    a = ["0.50", "1.0", "0.5", "0.50", "x", None] * 40
    table = cells(spark, {"t": {"a": a}})
    assert {(r.raw, r.c, r.first) for r in values.counted(table).collect()} == {("0.50", 80, 0), ("1.0", 40, 1), ("0.5", 40, 2)}
    found = audits.duplicate_values(table).first()
    assert '"top_repeated_values":[{"value":"0.5","count":120' in found.details
    rows = [x.split(",")[0] for x in found.details.split('"row_index":')[1:]]
    assert rows == ["2", "4", "5", "8", "10", "11", "14", "16"]


def test_checks_gather_numbers_in_parts_and_look_texts_up(spark, monkeypatch):
    monkeypatch.setattr(audits, "CHECKED", 100)
    n = 200
    table = {"t": {"length": [2] * n, "width": [3] * n, "volume": ["50" if i % 50 == 7 else "9" for i in range(n)]}, "u": {"length of volume": [2.0] * 9, "width": [5] * 9}}
    hits, rows = audits._checks(cells(spark, table))
    got = {r.table_name: (r.n, r.details.mismatch_count) for r in hits.collect()}
    assert got == {"t": (n, 4), "u": (9, 9)}  # a column may be the length and the volume
    assert [(r.example.row_index, r.example.cell, r.example.value) for r in rows.where("table_index = 0").orderBy("pos").collect()] == [(i + 2, f"C{i + 2}", "50") for i in (7, 57, 107, 157)]


def test_a_table_of_several_splits_is_not_written_again_by_each_pass(spark, tmp_path, monkeypatch):
    from plumbline.sources import melt

    spark.range(1000).write.parquet(f"file://{tmp_path}/t")
    df = spark.read.parquet(f"file://{tmp_path}/t")
    monkeypatch.setattr(melt, "SMALLEST", 0)
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", f"{size // 2}b")
    try:
        assert melt.spread(df) is df
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def melted_cells(spark, n=60):
    """A melted table with odd fields, and the same cells without their tables."""
    from plumbline.sources.melt import Melt, melt_all

    odd = [None, -0.0, 0.0, 0.011, 0.012, -3.0, 100.0, 1e9, 7.5]
    rows = [(i * 3, odd[i % 9], i if i % 4 else None, odd[(i * 2) % 9], 0.5 if i in (1, 2, 58) or i > 50 else 0.7) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, a double, b int, t double, late double")
    tables = {"x": df, "none": df.limit(0)}
    cells = melt_all(tables, [Melt("x", 0, "id", {"a": "fixed", "b": "whole", "t": "text", "late": "trimmed"}, "signal"), Melt("none", 1, "id", {"a": "trimmed"})])
    return cells, cells.select("*")


def test_fields_of_melted_tables_are_counted_before_they_are_printed(spark):
    from plumbline.sources import melt

    cells, plain = melted_cells(spark)
    assert melt.melted(plain) is None
    made = melt.counts(melt.melted(cells))
    assert "Generate" not in made._jdf.queryExecution().executedPlan().toString()
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(values.counted(cells)) == rows(values.counted(plain)) != []
    assert rows(melt.named(cells, ["table_index", "table_name", "col_i", "column", "column_context"])) == rows(melt.named(plain, ["table_index", "table_name", "col_i", "column", "column_context"]))


def test_melted_cells_have_the_findings_of_cells(spark):
    cells, plain = melted_cells(spark)
    for screen in (audits.last_digit_distribution, audits.decimal_tail_regularity, audits.column_screens):
        rows = [sorted(map(tuple, screen(c).collect()), key=str) for c in (cells, plain)]
        assert rows[0] == rows[1] != []


def test_first_cells_are_found_where_rows_of_a_key_are_uneven(spark, monkeypatch):
    looked = []
    monkeypatch.setattr(values, "narrowed", lambda cells, bounds: looked.append(1) or cells)
    n = 2000
    table = {"late": ["1" if i == 0 or i > 1900 else "x" for i in range(n)], "even": [str(i % 5) for i in range(n)], "few": ["9" if i in (3, 900) else "x" for i in range(n)], "many": [str(i % 50) for i in range(n)]}
    made = cells(spark, {"t": table})
    texts = values.counted(made).withColumn("key", F.lit("k"))
    got = values.first_cells(texts, made, [*values.COLUMN, "key"], 8).orderBy("col_i", "k").collect()
    expected = [[i for i in range(n) if v[i] != "x"][:8] for v in table.values()]
    assert [[r.row_i for r in got if r.col_i == c] for c in range(4)] == expected
    assert len(looked) == 2  # once within bounds, once for the key that came short
    looked.clear()
    values.first_cells(texts.where("col_i <> 0"), made, [*values.COLUMN, "key"], 8)
    assert len(looked) == 1


@pytest.mark.parametrize("name", ["arithmetic_sequence", "duplicate_values", "formula_check"])
def test_order_keys_that_no_long_can_pack(spark, tmp_path, name):
    """Keys moved by 97 * 2^20 leave the order of rows as it is, and exceed what the packed number may have in a long."""
    con = duckdb.connect()
    for t in ("customer", "supplier", "part", "orders", "lineitem", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
        key = {"orders": "o_orderkey", "lineitem": "l_orderkey"}.get(t)
        con.sql(f"COPY (SELECT * {f'REPLACE ({key} + {97 << 20} AS {key})' if key else ''} FROM {t}) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    got = queries.QUERIES[name](spark, str(tmp_path))
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    rounded = lambda rows: sorted(tuple(round(x, 4) if isinstance(x, float) else x for x in r) for r in rows)
    assert rounded(map(tuple, got.collect())) == rounded(want)
