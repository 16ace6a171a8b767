"""What is stored goes: at the end of its block, or with the driver."""

import os
import subprocess
import sys
from pathlib import Path

from plumbline.sources.store import kept, rows_in, stored, temporary

RUN = """
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://" + sys.argv[1]).getOrCreate()
from plumbline.sources.store import kept, stored, temporary
kept(spark.range(3), "kept")
stored(spark.range(3), "stored")
import os
assert len(os.listdir(sys.argv[1] + "/plumbline")) == 2
print("ran")
"""


def test_with_the_driver(tmp_path):
    out = subprocess.run([sys.executable, "-c", RUN, str(tmp_path)], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True, timeout=180)
    assert "ran" in out.stdout, out.stderr[-900:]
    assert os.listdir(tmp_path / "plumbline") == []


def test_with_the_block(spark):
    place = lambda df: df._plumbline_path.removeprefix("file://")
    with temporary(spark):
        a, b = stored(spark.range(3), "a"), kept(spark.range(3), "b")
        assert os.path.exists(place(a))
    assert not os.path.exists(place(a)) and b.count() == 3


def test_rows_are_counted_while_they_are_written(spark):
    a, b = kept(spark.range(0, 1000, 1, 7).where("id % 3 = 0"), "a"), kept(spark.range(0), "b")
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    assert (rows_in(a), rows_in(b)) == (334, 0)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == before
