"""New cells as they arrive: each micro-batch is screened as a set of tables of its own.

The reference workflow is a batch one; this is an extension for folders that grow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from plumbline.model import CELLS
from plumbline.operators import audits
from plumbline.sources.store import discard, kept, temporary


def watch(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Parquet files of cells that appear in folder give findings in out, once each: a batch's number names its output."""

    def screen(batch: DataFrame, number: int) -> None:
        cells = kept(batch, "batch")
        with temporary(cells.sparkSession):
            audits.audit(cells).write.mode("overwrite").parquet(f"{out}/batch={number}")
        discard(cells)

    cells = spark.readStream.schema(CELLS).parquet(folder)
    return cells.writeStream.foreachBatch(screen).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
