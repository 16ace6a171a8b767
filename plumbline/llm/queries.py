"""The registered corpus queries: ``op<N>_<name>`` with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.classifier_chain import scored
from plumbline.llm.common import work_path
from plumbline.llm.conversation_trie import prefix_trie, sequences, with_shared_heads
from plumbline.llm.decontamination import decontaminate
from plumbline.llm.importance_resampling import resampled
from plumbline.llm.jaccard_join import jaccard_join
from plumbline.llm.kd_sharding import kd_shards
from plumbline.llm.line_dedup import dedup_lines
from plumbline.llm.packing import pack
from plumbline.llm.periodic_runs import periodic_runs, with_repeats
from plumbline.llm.quality_rules import judged
from plumbline.llm.secret_scan import scanned
from plumbline.llm.token_counts import counted
from plumbline.llm.warc import round_trip


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_classifier_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels' categories, in the order of the chain: poor quality, then toxic."""
    categories = {"poor": F.col("quality") == 0, "toxic": F.col("toxic") == 1}
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), categories)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"), k=3, percent=90)


def op3_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op4_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans", "items")


def op5_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = kd_shards(table(spark, sf_dir, "documents"), 24, ["n_chars", "doc_id"], ["lang", "source"])
    return shards.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))


def op8_line_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"))


def op9_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents"))


def op10_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"))


def op11_digest_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a cache that is empty at first: every distinct text is tokenized."""
    return counted(table(spark, sf_dir, "documents"), work_path(spark, "token-counts"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(with_shared_heads(sequences(table(spark, sf_dir, "conversations"))))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the runs and of what collapsing them leaves, and the run of the greatest exponent."""
    found = periodic_runs(with_repeats(table(spark, sf_dir, "documents")))
    ahead = "r.length * b.period > b.length * r.period or (r.length * b.period = b.length * r.period and (r.start < b.start or (r.start = b.start and r.period < b.period)))"
    best = F.expr(f"aggregate(runs, cast(null as struct<start: bigint, length: bigint, period: bigint>), (b, r) -> if(b is null or {ahead}, r, b))")
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
        "n_words",
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_classifier_chain,
        op2_jaccard_join,
        op3_best_two_fit,
        op4_winnowing,
        op5_importance_resampling,
        op6_decision_list,
        op7_kd_sharding,
        op8_line_winnowing,
        op9_markov_secrets,
        op10_warc_segments,
        op11_digest_cache,
        op12_conversation_trie,
        op13_periodic_runs,
    )
}
#: DuckDB SQL where it can express a query.
ORACLE_SQL: dict[str, str] = {}
