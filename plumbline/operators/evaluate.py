"""How well findings recover planted anomalies, and leads the figures of a known case."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.model import HIGH, NOT_APPLICABLE
from plumbline.operators.classify import EXCLUDED_TYPES
from plumbline.sources.store import stored

ORACLE = "id string, error_type string, source_contains string, table_name string, columns array<string>, expected_disposition string"


def measurement_fixture(spark: SparkSession) -> DataFrame:
    """The synthetic table, 80 rows, as (row_i, name, raw): planted anomalies among decoys and clean columns."""
    rows = []
    for i in range(1, 81):
        plain = 10 + math.sin(i / 4) + 0.03 * i
        length, width = 5 + math.sin(1.7 * i) + 0.07 * (i % 7), 3 + 0.4 * math.cos(1.3 * i) + 0.03 * (i % 11)
        signal = str(round(5 + math.sin(i / 6), 4))
        made = {
            "chr": "chr1", "start": str(1000 + i), "end": str(1100 + i), "sample_id": str(i), "day": str(i),
            "normal_measurement": str(round(plain, 3)), "foci_last_digit_heap": f"{plain:.2f}7", "fluorescence_decimal_tail_heap": f"{20 + 3 * math.sin(i / 5) + 0.4 * (i % 13):.0f}.05",
            "signal_clone_group_a": signal, "signal_clone_group_b": signal, "smooth_measurement": str(round(1 + 0.5 * i, 3)),
            "length_mm": str(round(length, 3)), "width_mm": str(round(width, 3)), "volume_mm3": str(round(length * width * width / 2 + (15 if i in (10, 20, 30) else 0), 3)),
            "n": "9", "sd": "3.0", "sem": "3.0" if i == 1 else "1.0",
        }
        rows += [(i, c, name, raw) for c, (name, raw) in enumerate(made.items())]
    return spark.createDataFrame(rows, "row_i bigint, col_i int, column string, raw string")


def fixture_cells(spark: SparkSession, name: str = "neutral_source_data.csv") -> DataFrame:
    lit = F.lit
    return measurement_fixture(spark).select(
        lit(0).alias("table_index"), lit(name).alias("source_path"), lit("table").alias("source_kind"), lit("raw_table").alias("source_confidence"), lit(name).alias("table_name"),
        "row_i", (F.col("row_i") + 1).alias("row_no"), "col_i", "column", lit("").alias("column_context"), F.concat(F.chr(65 + F.col("col_i")), (F.col("row_i") + 1).cast("string")).alias("cell"), "raw",
    )


def fixture_oracle(spark: SparkSession, name: str = "neutral_source_data.csv") -> DataFrame:
    planted = {
        "terminal_digit_heaping": ["foci_last_digit_heap"], "decimal_tail_heaping": ["fluorescence_decimal_tail_heap"], "clone_vector": ["signal_clone_group_a", "signal_clone_group_b"],
        "arithmetic_smoothness": ["smooth_measurement"], "formula_mismatch": ["volume_mm3"], "summary_math_inconsistency": ["sem"],
    }
    return spark.createDataFrame([(f"planted-{i}", kind, name, name, columns, HIGH) for i, (kind, columns) in enumerate(planted.items(), 1)], ORACLE)


#: Bytes of patterns that are shared with all tasks at once; more are looked for in several passes.
SHARED_BYTES = 8 << 20


def _occurring(shared, columns: tuple[str, ...]):
    """(finding, place, pattern): which patterns occur in which text of a finding, by one walk through each text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for p in shared.value:
            automaton.add_word(p, p)
        automaton.make_automaton()
        for batch in batches:
            out = [(i, place, p) for place in columns for i, text in zip(batch["finding"], batch[place], strict=True) if text for p in {p for _, p in automaton.iter(text)}]
            yield pd.DataFrame(out, columns=["finding", "place", "pattern"])

    return run


def occurrences(findings: DataFrame, patterns: DataFrame) -> DataFrame:
    """(finding, place, pattern) of findings(finding, source, blob) for patterns(pattern): what ``contains`` would say of all pairs.

    An automaton of all patterns (Aho and Corasick 1975) costs the texts and the hits, not the pairs. Patterns are weighed first; beyond
    ``SHARED_BYTES`` they are dealt into parts of about that weight.
    """
    spark = findings.sparkSession
    asked = stored(patterns.where("pattern <> ''").distinct(), "patterns")
    weight = asked.agg(F.sum(F.octet_length("pattern") + 64)).first()[0] or 0
    parts = -(-weight // SHARED_BYTES)
    out = None
    for part in range(parts):
        mine = asked if parts == 1 else asked.where(F.pmod(F.xxhash64("pattern"), F.lit(parts)) == part)
        shared = spark.sparkContext.broadcast([r["pattern"] for r in mine.collect()])  # about SHARED_BYTES
        found = findings.mapInPandas(_occurring(shared, ("source", "blob")), "finding bigint, place string, pattern string")
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], "finding bigint, place string, pattern string") if out is None else stored(out, "occurrences")


def matches(normalized: DataFrame, oracle: DataFrame) -> DataFrame:
    """(oracle_id, normalized_rank) of the findings that an oracle's items ask for; normalized_rank tells findings apart.

    An item asks for an error type, and if it says so for a table, for a part of the source's path, and for one of some columns, to be named by the finding's column or details.
    """
    told = normalized.where(F.col("disposition") != NOT_APPLICABLE).select(F.col("normalized_rank").alias("finding"), F.col("source_path").alias("source"), F.concat_ws(" ", "column", "details").alias("blob"), "error_type", "table_name")
    items = oracle.select(F.col("id").alias("item"), F.col("error_type"), F.coalesce("source_contains", F.lit("")).alias("part"), F.coalesce("table_name", F.lit("")).alias("of_table"), F.coalesce("columns", F.array().cast("array<string>")).alias("columns"))
    columns = items.select("*", F.explode(F.array_distinct("columns")).alias("pattern"))
    hits = occurrences(told.select("finding", "source", "blob"), items.select(F.col("part").alias("pattern")).unionByName(columns.select("pattern")))
    named = hits.where("place = 'blob'").join(told.select("finding", "error_type", "table_name"), "finding").join(columns.where("pattern <> ''"), ["pattern", "error_type"])
    # An item without columns, or with an empty name (which any text contains), asks no more of a finding than its type.
    any_column = (F.size("columns") == 0) | F.array_contains("columns", "")
    found = named.select("item", "finding", "table_name", "of_table", "part").unionByName(told.join(items.where(any_column), "error_type").select("item", "finding", "table_name", "of_table", "part"))
    found = found.where("of_table = '' or of_table = table_name").distinct()
    there = hits.where("place = 'source'").select("finding", F.col("pattern").alias("part"))
    return found.where("part = ''").select("item", "finding").unionByName(found.join(there, ["finding", "part"], "left_semi").select("item", "finding")).select(F.col("item").alias("oracle_id"), F.col("finding").alias("normalized_rank"))


def score_oracle(normalized: DataFrame, oracle: DataFrame) -> DataFrame:
    """A row for every planted item: exact, near or miss, and its first hit."""
    expected = oracle.select(F.col("id").alias("oracle_id"), "expected_disposition")
    hits = matches(normalized, oracle).join(normalized.select("normalized_rank", "disposition", "summary"), "normalized_rank").join(expected, "oracle_id")
    hits = hits.withColumn("exact", F.col("disposition") == F.col("expected_disposition"))
    best = hits.groupBy(F.col("oracle_id").alias("o_id")).agg(F.max("exact").alias("exact"), F.min_by(F.struct("normalized_rank", "disposition", "summary"), F.struct(~F.col("exact"), "normalized_rank")).alias("first"))
    out = oracle.join(best, oracle.id == best.o_id, "left")
    status = F.when(F.col("exact"), "exact").when(F.col("o_id").isNotNull(), "near").otherwise("miss")
    return out.select(F.col("id").alias("oracle_id"), "error_type", "expected_disposition", status.alias("status"), F.col("first.normalized_rank").alias("first_hit_rank"), F.col("first.disposition").alias("first_hit_disposition"), F.col("first.summary").alias("first_hit_summary"))


def recovery(results: DataFrame, normalized: DataFrame, min_exact: float = 0.7, min_near: float = 0.85) -> DataFrame:
    """One row: recovery rates, decoy columns that were called high, and whether the gates hold."""
    rates = results.agg(F.avg((F.col("status") == "exact").cast("double")).alias("exact_recovery_rate"), F.avg((F.col("status") != "miss").cast("double")).alias("exact_or_near_recovery_rate"))
    decoys = normalized.agg(F.count_if((F.col("disposition") == HIGH) & F.col("column_type").isin(*EXCLUDED_TYPES[:4])).alias("decoy_high_priority_failures"))
    passed = (F.col("exact_recovery_rate") >= min_exact) & (F.col("exact_or_near_recovery_rate") >= min_near) & (F.col("decoy_high_priority_failures") == 0)
    return rates.crossJoin(decoys).withColumn("passed", passed)  # one row each


_LABEL = r"(?i)(Extended Data Fig\.|ED\s*Fig\.|Fig\.)\s*(\d+)\s*([a-z]?)"


def figure_labels(text: Column) -> Column:
    """All figures that a text names: array of (kind, num, panel)."""
    groups = F.arrays_zip(*[F.regexp_extract_all(text, F.lit(_LABEL), F.lit(i)).alias(n) for i, n in ((1, "k"), (2, "num"), (3, "p"))])
    return F.transform(groups, lambda x: F.struct(F.when(F.lower(x["k"]).rlike("^(extended|ed)"), "ed").otherwise("main").alias("kind"), x["num"].alias("num"), F.lower(x["p"]).alias("panel")))


def score_labels(leads: DataFrame, oracle: DataFrame) -> DataFrame:
    """A row for every label of a known case: found with its panel, with its figure, or missed. leads: with context_rank."""
    blob = F.to_json(F.struct(*[F.col(c) for c in leads.columns]))
    named = leads.select("context_rank", "summary", F.explode(figure_labels(blob)).alias("f")).select("context_rank", "summary", "f.*")
    target = oracle.withColumn("t", F.get(figure_labels(F.col("label")), F.lit(0))).select("id", "label", "problem_family", F.col("t.kind").alias("t_kind"), F.col("t.num").alias("t_num"), F.col("t.panel").alias("t_panel"))
    hits = target.join(named, (F.col("t_kind") == F.col("kind")) & (F.col("t_num") == F.col("num")))
    exact = F.col("panel") == F.col("t_panel")
    best = hits.groupBy(F.col("id").alias("h_id")).agg(F.max(exact).alias("exact"), F.min_by(F.struct("context_rank", "summary"), F.struct(~exact, "context_rank")).alias("first"))
    status = F.when(F.col("exact"), "true_positive").when(F.col("h_id").isNotNull(), "near_miss").otherwise("missed_oracle")
    return target.join(best, F.col("id") == F.col("h_id"), "left").select(F.col("id").alias("oracle_id"), "label", "problem_family", status.alias("status"), F.col("first.context_rank").alias("first_hit_rank"), F.col("first.summary").alias("first_hit_summary"))


def label_rates(results: DataFrame) -> DataFrame:
    return results.agg(F.avg((F.col("status") == "true_positive").cast("double")).alias("recovery_rate"), F.avg((F.col("status") != "missed_oracle").cast("double")).alias("near_miss_or_better_rate"))
