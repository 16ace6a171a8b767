"""The corpus pipeline: five stages over documents, each on all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns documents; its result is written as
Parquet in the shared folder and read again as the next one's documents; it goes, with all that a stage stored, when the next is written.

Stages decide by row: a null id is an id like others, the smallest, and rows of one id may have
different texts. Rows of one id and text are decided alike, and of them one goes beyond the n-gram Jaccard join
(all do if they have no shingle).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import stored, work_path
from plumbline.llm.decontamination import decontaminate
from plumbline.llm.importance_resampling import resampled
from plumbline.llm.jaccard_join import jaccard_join
from plumbline.llm.line_dedup import dedup_lines
from plumbline.llm.packing import pack
from plumbline.sources.store import delete, temporary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _told(docs: DataFrame) -> DataFrame:
    """Documents with the hash of their text, t."""
    return docs.withColumn("t", F.xxhash64("text"))


def _joined(docs: DataFrame, told: DataFrame, how: str) -> DataFrame:
    """Documents whose id and hash of the text are (left_semi) or are not (left_anti) in told(doc_id, t)."""
    told = told.select(F.col("doc_id").alias("told_id"), F.col("t").alias("told_t")).distinct()
    return docs.join(told.hint("merge"), F.col("doc_id").eqNullSafe(F.col("told_id")) & (F.xxhash64("text") == F.col("told_t")), how).select(*COLUMNS)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling selects."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _joined(docs, resampled(_told(docs), labels, carry=["t"]).where("selected"), "left_semi")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without runs of lines that came before; those of which nothing is left go."""
    left = dedup_lines(docs, carry=["lang", "source", "n_chars"])
    left = left.where("n_deleted = 0 or text rlike '[^\\\\x20\\\\x09-\\\\x0D]'")
    return left.withColumn("n_chars", F.when(F.col("n_deleted") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each class of near duplicates: five-word shingles, a similarity of 0.8.

    Rows are numbered for the join, as ids may be null or repeated.
    """
    numbered = stored(docs.select(F.monotonically_increasing_id().alias("row"), *COLUMNS), "numbered")
    place = numbered.select("row", F.struct("doc_id", F.xxhash64(*COLUMNS).alias("h"), F.col("row").alias("first")).alias("place"))
    classes = jaccard_join(numbered, k=5, percent=80, id_col="row").select("row", "component_id")
    first = classes.join(place.hint("merge"), "row").groupBy("component_id").agg(F.min("place").alias("p")).select(F.col("p.first").alias("row"))
    return numbered.join(first.hint("merge"), "row", "left_semi").select(*COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of any benchmark item; an item of fewer words is one window."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate(_told(docs), benchmark, least_items=1, carry=["t"])
    return _joined(docs, found.where("contaminated"), "left_anti")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences."""
    return pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", best_fit_packing),
]
#: No SQL expresses tokenization, packing or the sampling; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = work_path(spark, name.replace(" ", "-"))
        with temporary(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
