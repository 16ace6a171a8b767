"""From rows of cells to named columns: header detection, column names, contexts, cells."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.tokens import clean_cell, column_letters

# Words that headers have.
HINTS = (
    "seqnames", "chr", "chrom", "start", "end", "width", "strand", "annotation", "gene", "protein", "pvalue", "p value", "padj", "sample", "group", "condition",
    "time", "day", "length", "volume", "weight", "mean", "sd", "sem", "n", "ratio", "intensity", "level",
)
#: What parts no words: letters and digits of any script, and the underscore.
_WORD = r"[\p{L}\p{N}_]"
SCANNED = 20
CONTEXT_ROWS = 3
#: What Python's float() takes.
_FLOAT = r"(?i)^\s*[-+]?(?:\d+(?:_\d+)*(?:\.(?:\d+(?:_\d+)*)?)?|\.\d+(?:_\d+)*)(?:e[-+]?\d+(?:_\d+)*)?\s*$|^\s*[-+]?(?:inf|infinity|nan)\s*$"


def is_numeric_text(cell: Column) -> Column:
    return F.regexp_replace(cell, ",", "").rlike(_FLOAT)


def header_score(cells: Column) -> Column:
    """How much a row (of cleaned cells that aren't empty) looks like a header."""
    n = F.size(cells)
    numbers = F.size(F.filter(cells, is_numeric_text))
    joined = F.lower(F.array_join(cells, " "))
    # Few rows contain a word at all, which is told faster than whether it stands alone.
    hints = sum(((joined.contains(h) & joined.rlike(rf"(?<!{_WORD}){re.escape(h)}(?!{_WORD})")).cast("int") for h in HINTS), F.lit(0))
    score = (n - numbers) * 2.0 + hints * 5.0 - numbers * 1.5
    score = score + F.when(n >= 3, 3.0).otherwise(0.0) - F.when((n == 1) & (F.length(F.get(cells, F.lit(0))) > 40), 6.0).otherwise(0.0)
    return F.when(n == 0, -10.0).otherwise(score)


def detect_headers(rows: DataFrame) -> DataFrame:
    """(table_index, header_i): of the first rows the best header, the earliest of equals. rows: (table_index, row_i, cells)."""
    head = rows.where(F.col("row_i") <= SCANNED).select("table_index", "row_i", F.filter(F.transform("cells", clean_cell), lambda x: x != "").alias("c"))
    below = F.lead("c").over(Window.partitionBy("table_index").orderBy("row_i"))
    scored = head.withColumn("below", below).where(F.col("row_i") < SCANNED)
    numbers = F.size(F.filter("below", is_numeric_text))
    bonus = F.when((F.size("below") > 0) & (numbers >= F.greatest(F.lit(1), F.floor(F.size("below") / 3))), 3.0).otherwise(0.0)
    scored = scored.withColumn("score", header_score(F.col("c")) + bonus)
    return scored.groupBy("table_index").agg(F.max_by("row_i", F.struct("score", -F.col("row_i"))).alias("header_i"))


def unique_names(columns: DataFrame) -> DataFrame:
    """Names of (table_index, col_i, label): blanks are numbered, repeats get .2, .3."""
    base = F.when(F.col("label") == "", F.concat(F.lit("col_"), (F.col("col_i") + 1).cast("string"))).otherwise(F.col("label"))
    named = columns.withColumn("base", base)
    k = F.row_number().over(Window.partitionBy("table_index", "base").orderBy("col_i"))
    return named.withColumn("_k", k).withColumn("column", F.when(F.col("_k") == 1, F.col("base")).otherwise(F.concat_ws(".", "base", F.col("_k").cast("string")))).drop("_k", "base", "label")


def to_cells(rows: DataFrame) -> DataFrame:
    """Cells of all tables. rows: those of sources.tables with table_index; tables that bring their columns have no header row."""
    some = rows.where("row_i >= 0")
    headers = detect_headers(some.where("columns is null"))
    shape = some.groupBy("table_index").agg(F.max(F.greatest(F.size("cells"), F.size(F.coalesce("columns", F.array().cast("array<string>"))))).alias("width"), F.max("columns").alias("columns_given"))
    tables = shape.join(headers, "table_index", "left")
    spread = tables.select("table_index", "header_i", "columns_given", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("col_i")).where("col_i >= 0")
    wanted = some.join(tables, "table_index").where(F.col("header_i").isNotNull() & F.col("row_i").between(F.col("header_i") - CONTEXT_ROWS, F.col("header_i")))
    label = clean_cell(F.get("cells", F.col("col_i")))
    labels = wanted.select("table_index", "row_i", "cells", "header_i", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("col_i")).select("table_index", "row_i", "header_i", "col_i", label.alias("label"))
    filled = F.last(F.when(F.col("label") != "", F.col("label")), ignorenulls=True).over(Window.partitionBy("table_index", "row_i").orderBy("col_i").rowsBetween(Window.unboundedPreceding, 0))
    above = labels.withColumn("filled", filled).where("row_i < header_i and filled is not null")
    contexts = above.groupBy("table_index", "col_i").agg(F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("row_i", "filled"))), lambda x: x["filled"])), " | ").alias("column_context"))
    header = labels.where("row_i = header_i").select("table_index", "col_i", F.col("label").alias("found"))
    names = unique_names(
        spread.join(header, ["table_index", "col_i"], "left").select("table_index", "col_i", F.coalesce(F.get("columns_given", F.col("col_i")), "found", F.lit("")).alias("label"))
    )
    names = names.join(contexts, ["table_index", "col_i"], "left").fillna("", ["column_context"])
    body = some.join(tables, "table_index").where(F.col("header_i").isNull() | (F.col("row_i") > F.col("header_i")))
    restarts = F.col("source_kind") == "pdf"  # rows of extracted tables are counted from 1 below the header
    row_no = F.when(restarts & F.col("header_i").isNotNull(), F.col("row_i") - F.col("header_i")).otherwise(F.col("row_i") + 1)
    long = body.select(
        "table_index", "source_path", "source_kind", "source_confidence", "table_name", "row_i", row_no.alias("row_no"), "cells", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("col_i")
    )
    return long.join(names, ["table_index", "col_i"]).select(
        "table_index", "source_path", "source_kind", "source_confidence", "table_name", "row_i", "row_no", "col_i", "column", "column_context",
        F.concat(column_letters(F.col("col_i")), F.col("row_no").cast("string")).alias("cell"), clean_cell(F.get("cells", F.col("col_i"))).alias("raw"),
    )
