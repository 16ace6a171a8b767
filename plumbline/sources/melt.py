"""Relational tables as cells: a table per source, a column per numeric field."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.tokens import column_letters
from plumbline.model import CELLS

#: Bytes of files below which a table is quicker left in one task.
SMALLEST = 1 << 20
#: Names of the fields of a cell, in order.
FIELDS = [f.split()[0] for f in CELLS.split(", ")]


def printed(name: str, mode: str) -> Column:
    """A field as it is printed: ``fixed`` two decimals, ``trimmed`` of closing zeros, ``whole``, or ``text`` as it is."""
    if mode == "text":
        return F.col(name).cast("string")
    if mode == "whole":
        return F.col(name).cast("bigint").cast("string")
    fixed = F.col(name).cast("decimal(18,2)").cast("string")
    return fixed if mode == "fixed" else F.regexp_replace(F.regexp_replace(fixed, "0+$", ""), r"\.$", "")


#: What numbers rows that no long can.
WIDE = "decimal(38,0)"


@dataclass(frozen=True)
class Melt:
    """order: a number that orders the rows, unique. weights: where it is a sum of integer fields, what each is multiplied by. kind: the type of the number; see ``fitted``."""

    table: str
    index: int
    order: str
    columns: dict[str, str]
    context: str = ""
    weights: tuple[tuple[str, int], ...] = ()
    kind: str = "bigint"


def fitted(tables: dict[str, DataFrame], specs: list[Melt]) -> list[Melt]:
    """The specs with a type that holds the numbers of all their rows: a long, or ``WIDE`` where a weighted sum exceeds it. Asks each field of such a sum for its ends."""

    def exceeds(spec: Melt) -> bool:
        ends = tables[spec.table].agg(*[f(c).cast("bigint") for c, _ in spec.weights for f in (F.min, F.max)]).first()
        sums = [sum(w * (ends[2 * i + j] or 0) for i, (_, w) in enumerate(spec.weights)) for j in (0, 1)]
        return sums[0] < -(1 << 63) or sums[1] >= 1 << 63

    if not any(s.weights and exceeds(s) for s in specs):
        return specs
    return [replace(s, kind=WIDE) for s in specs]


def row_order(spec: Melt) -> Column:
    """The number that orders the rows of a table."""
    if spec.kind == "bigint" or not spec.weights:
        return F.expr(spec.order).cast(spec.kind)
    term = lambda c, w: F.col(c).cast("decimal(20,0)") * F.lit(w).cast("decimal(17,0)")
    return reduce(Column.__add__, [term(c, w) for c, w in spec.weights]).cast(WIDE)


def melt(df: DataFrame, spec: Melt, only: int | None = None) -> DataFrame:
    """Cells of the columns of df: one pass, no shuffle. only: the one column to melt."""
    order = row_order(spec)
    fields = [F.struct(F.lit(i).alias("col_i"), F.lit(c).alias("column"), printed(c, mode).alias("raw")) for i, (c, mode) in enumerate(spec.columns.items()) if only in (None, i)]
    long = df.select(order.alias("row_i"), F.explode(F.array(*fields)).alias("x"))
    return long.select(
        F.lit(spec.index).alias("table_index"), F.lit(f"{spec.table}.parquet").alias("source_path"), F.lit("table").alias("source_kind"), F.lit("raw_table").alias("source_confidence"), F.lit(spec.table).alias("table_name"),
        "row_i", (F.col("row_i") if spec.kind == "bigint" else F.col("row_i").try_cast("bigint")).alias("row_no"), "x.col_i", "x.column", F.lit(spec.context).alias("column_context"), F.concat(column_letters(F.col("x.col_i")), F.col("row_i").cast("string")).alias("cell"), "x.raw",
    )


def spread(df: DataFrame) -> DataFrame:
    """Rows of a small table in as many tasks as there are cores: its files may be one row group, which no scan can split.

    A table of more bytes than one split has row groups of its own for the cores and is returned as it is: each pass over it would write all of it once more.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return df.repartition(cores) if SMALLEST < size <= split else df


def melt_all(tables: dict[str, DataFrame], specs: list[Melt]) -> DataFrame:
    """Cells of all tables. They remember their tables: what is asked of few columns, rows or values need not melt all of them (see ``named``, ``counts`` and ``narrowed``)."""
    specs = fitted(tables, specs)
    out = reduce(DataFrame.unionByName, [melt(spread(tables[s.table]), s) for s in specs])
    out._plumbline_melted = [(tables[s.table], s) for s in specs]
    return out


def melted(cells: DataFrame) -> list[tuple[DataFrame, Melt]] | None:
    """The tables that cells were melted from; none for other cells."""
    return getattr(cells, "_plumbline_melted", None)


def named(cells: DataFrame, key: list[str]) -> DataFrame:
    """The different keys of cells: properties of tables and columns. Of a melted table, one row tells them."""
    tables = melted(cells)
    if tables is None:
        return cells.select(*key).distinct()
    return reduce(DataFrame.unionByName, [melt(df.limit(1), spec) for df, spec in tables]).select(*key).distinct()


def counts(tables: list[tuple[DataFrame, Melt]]) -> DataFrame:
    """(table_index, col_i, raw, c, first, last): how often fields are printed so, and the first and last row. Fields are counted as they are stored, and printed once for each value.

    Values that are printed alike still have a row each.
    """

    def of(df: DataFrame, spec: Melt, i: int, name: str, mode: str) -> DataFrame:
        field = F.col(name).cast("string") if mode == "text" else F.col(name)
        rows = spread(df).select(field.alias(name), row_order(spec).alias("_row"))
        groups = rows.groupBy(name).agg(F.count("*").alias("_c"), F.min("_row").alias("_first"), F.max("_row").alias("_last"))
        return groups.select(F.lit(spec.index).alias("table_index"), F.lit(i).alias("col_i"), printed(name, mode).alias("raw"), F.col("_c").alias("c"), F.col("_first").alias("first"), F.col("_last").alias("last"))

    return reduce(DataFrame.unionByName, [of(df, spec, i, c, mode) for df, spec in tables for i, (c, mode) in enumerate(spec.columns.items())])


def narrowed(cells: DataFrame, bounds: DataFrame) -> DataFrame:
    """Cells, for whoever keeps those of bounds(table_index, col_i, _bound) up to row ``_bound`` alone: of melted ones no other need be made."""
    tables = melted(cells)
    if tables is None:
        return cells
    most = {(r.table_index, r.col_i): r.most for r in bounds.groupBy("table_index", "col_i").agg(F.max("_bound").alias("most")).collect()}  # a row for a column of the tables at most
    asked = [melt(df, spec, i).where(F.col("row_i") <= most[spec.index, i]) for df, spec in tables for i in range(len(spec.columns)) if most.get((spec.index, i)) is not None]
    return reduce(DataFrame.unionByName, asked) if asked else cells.limit(0)
