"""Intermediate tables in storage that driver and executors share, and gapless numbers of sorted rows.

A table written out cuts the plan, outlives lost executors, and is read by as many
parts of a screen as need it. What is stored inside ``temporary`` is deleted at its end, but for what is ``kept``. All that is left goes when the
driver ends: plans that read it end with it.
"""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset, a temporary one, on a local master only (tests)."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or getattr(context, "_plumbline_shared", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir isn't set: intermediate tables need a folder that driver and executors share")
        place = tempfile.mkdtemp(prefix="plumbline-")
        atexit.register(shutil.rmtree, place, ignore_errors=True)
        folder = "file://" + place
        context._plumbline_shared = folder
    return folder.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, which is deleted when the driver ends."""
    path = f"{shared_folder(spark)}/plumbline/{name}-{uuid.uuid4().hex}"
    if not _left:
        atexit.register(_delete_left)
    _left[path] = spark
    return path


_left: dict[str, SparkSession] = {}


def _delete_left() -> None:
    for path, spark in list(_left.items()):
        with suppress(Exception):  # the JVM may have gone before
            delete(spark, path)


_open: list[list[str]] = []


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again, for whoever calls. Its rows are counted by the job that writes them."""
    path, seen = work_path(df.sparkSession, name), Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._plumbline_path, out._plumbline_seen = path, seen
    return out


def rows_in(table: DataFrame) -> int:
    """The number of rows of a ``kept`` table; no job is run."""
    return table._plumbline_seen.get["rows"]


def stored(df: DataFrame, name: str) -> DataFrame:
    """As ``kept``, but goes at the end of the ``temporary`` block that it is made in."""
    path = work_path(df.sparkSession, name)
    if _open:
        _open[-1].append(path)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._plumbline_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jvm.org.apache.hadoop.conf.Configuration() if spark._jsc is None else spark._jsc.hadoopConfiguration()).delete(place, True)
    _left.pop(path, None)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``stored`` returned and that no plan still to be run reads."""
    for t in tables:
        delete(t.sparkSession, t._plumbline_path)


def release(spark: SparkSession) -> None:
    """Lets go of the shuffle files of tables that are written: they stay until the driver collects its garbage, which a large job rarely makes it do."""
    gc.collect()
    spark._jvm.System.gc()


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside are deleted at the end: results have to be ``kept`` (or collected) before."""
    paths: list[str] = []
    _open.append(paths)
    try:
        yield
    finally:
        _open.remove(paths)
        for path in paths:
            delete(spark, path)


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with ``name``: gapless numbers from 1 in the given order. Sorted by ranges: no task has all rows."""
    held = stored(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_at", 33)
    sizes = held.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    # A row for each partition of the sort, whatever the number of rows.
    begins = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_begin"))
    out = held.withColumn("_part", part).join(F.broadcast(begins), "_part")
    return out.withColumn(name, F.col("_begin") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_at", "_part", "_begin")
