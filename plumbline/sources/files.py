"""Directories of input files: scan, kinds, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Endings and what they mean; the first that fits counts.
KINDS = {
    "chart_points": [".points.csv", ".points.tsv"],
    "table": [".csv", ".tsv", ".xlsx", ".xls"],
    "array": [".npy", ".npz", ".mat", ".json"],
    "pdf": [".pdf"],
    "image": [".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp"],
}


def file_kind(path: Column) -> Column:
    low = F.lower(path)
    out = None
    for kind, endings in KINDS.items():
        fits = low.rlike("(" + "|".join(e.replace(".", r"\.") for e in endings) + ")$")
        out = F.when(fits, kind) if out is None else out.when(fits, kind)
    return out.otherwise("other")


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """One row per input file under root (or root itself), ordered by path; contents aren't read. Files of other kinds are left out.

    A root that doesn't exist raises Spark's own error.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "modificationTime", "length")
    base = F.lit(root.rstrip("/").split("://")[-1].lstrip("/") + "/")
    plain = F.regexp_replace("path", "^[a-z]+:/+", "")
    relative = F.when(plain.startswith(base), plain.substr(F.length(base) + 1, F.length(plain))).otherwise(F.regexp_extract("path", "([^/]*)$", 1))
    return (
        files.withColumn("kind", file_kind(F.col("path")))
        .where("kind <> 'other'")
        .select("path", relative.alias("relative_path"), "kind", F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)).alias("extension"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"))
        .orderBy("path")
    )


def kind_counts(files: DataFrame) -> DataFrame:
    return files.where("kind <> 'chart_points'").groupBy("kind").agg(F.count("*").alias("files"))


def sidecars(files: DataFrame) -> DataFrame:
    """Images with the digitized points beside them, or none: (path, sidecar)."""
    stem = lambda c: F.regexp_replace(c, r"(\.points\.(csv|tsv)|\.[^./]*)$", "")
    points = files.where("kind = 'chart_points'").select(stem(F.col("path")).alias("stem"), F.col("path").alias("sidecar"))
    return files.where("kind = 'image'").select("path", stem(F.col("path")).alias("stem")).join(points, "stem", "left").drop("stem")
