"""Quality by importance resampling (DSIR; Xie et al. 2023).

Two bags of hashed n-grams (single tokens and pairs; a token is a run of word
characters or of marks) are counted: the target's, from documents labelled
good, and the raw text's, from all documents. A document's importance is the ratio of
the probabilities that the two give its n-grams; the log of it plus Gumbel noise is
its key, and the k documents of the largest keys are a sample without
replacement in proportion to importance.

k is ``sum(min(1, importance))`` over all documents unless it is given: documents
that the target explains as well as the raw text count in full, those it
doesn't explain count as little.

The target is counted on at most ``target_rows`` good rows (those with the
smallest hash of their id; the bound is what lets their ids be
broadcast). All else covers every document: raw counts, importance, and the k-th
largest key, which is found by histograms of the key's bits, not by a sort.
The noise is a hash of the id, so a lost task gives the same keys again.

A null or empty text has importance 1. Rows with a null id draw the noise of null;
repeated rows have equal keys and are kept or rejected together. Labels of ids
that aren't in the documents, and null labels, have no effect. Without any good
label the ratio is 1 for all. Columns named in carry follow, as they are; others are left out.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import exact_cuts, stored
from plumbline.llm.textkernel import Words, runs, words_and_marks

BUCKETS = 1 << 13
#: N-grams that both models have in each bucket beforehand: draws the ratio of rare ones to 1.
PRIOR = 200.0
TARGET_ROWS = 20_000
_KEY_BITS = 62
_KEY_SHIFT, _KEY_SCALE = 64, 1 << 55


def _buckets(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the tokens and of the pairs of a run of texts; which pairs lie within a text."""
    mask = np.uint64(BUCKETS - 1)
    pairs = words.grams(2)
    inside = np.ones(len(pairs), dtype=bool)
    last = words.first[1:][words.first[1:] > words.first[:-1]] - 1
    inside[last] = False
    return (words.hash & mask).astype(np.int64), (pairs & mask).astype(np.int64), inside


def _counts(chosen):
    """(bucket, raw, target) of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = words_and_marks()
        good = chosen.value
        raw, target = np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            ids = batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False)
            is_good = np.zeros(len(ids), dtype=bool)
            if len(good):
                is_good = good[np.minimum(np.searchsorted(good, ids), len(good) - 1)] == ids
            is_good &= ~np.asarray(batch.column(0).is_null())
            for j, data, offsets in runs(batch.column(1)):
                words = Words(data, offsets, classes, lower=False)
                one, two, inside = _buckets(words)
                raw += np.bincount(one, minlength=BUCKETS) + np.bincount(two[inside], minlength=BUCKETS)
                here = is_good[j : j + len(offsets) - 1]
                if here.any():
                    of_good = np.repeat(here, np.diff(words.first))
                    target += np.bincount(one[of_good], minlength=BUCKETS) + np.bincount(two[inside & of_good], minlength=BUCKETS)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])], names=["bucket", "raw", "target"])

    return run


def _weights(ratios):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = words_and_marks()
        log_ratio = ratios.value
        for batch in batches:
            out = []
            for _, data, offsets in runs(batch.column(1)):
                words = Words(data, offsets, classes, lower=False)
                one, two, inside = _buckets(words)
                each = np.concatenate([[0.0], np.cumsum(log_ratio[one] + np.where(inside, log_ratio[two], 0.0))])
                out.append(each[words.first[1:]] - each[words.first[:-1]])
            if out:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out)), *batch.columns[2:]], names=["id", "log_weight", *batch.schema.names[2:]])

    return run


def resampled(
    docs: DataFrame, labels: DataFrame, k: int | None = None, target_rows: int = TARGET_ROWS, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", carry: Sequence[str] = ()
) -> DataFrame:
    """(id, log_weight, gumbel_key, selected) of every document. Columns named in carry follow, as they are."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    good = labels.where(F.col(label_col) == 1).select(F.col(id_col).cast("long").alias("id")).dropna().distinct().orderBy(F.xxhash64("id"), "id").limit(target_rows).collect()
    chosen = spark.sparkContext.broadcast(np.sort(np.array([r["id"] for r in good], dtype=np.int64)))
    counted = texts.mapInArrow(_counts(chosen), "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in counted.collect():  # BUCKETS rows at most
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    log_ratio = np.zeros(BUCKETS)
    if target.sum():
        expected = raw * (target.sum() / raw.sum())
        log_ratio = np.log((target + PRIOR) / (expected + PRIOR))
    ratios = spark.sparkContext.broadcast(log_ratio)
    both = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *[F.col(c).alias(f"carried_{c}") for c in carry])
    weighed = both.mapInArrow(_weights(ratios), ", ".join(["id long, log_weight double", *[f"`{f.name}` {f.dataType.simpleString()}" for f in both.schema[2:]]]))
    uniform = (F.shiftrightunsigned(F.xxhash64("id", F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    weighed = stored(weighed.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(uniform))), "weights")

    rows, expected = weighed.agg(F.count("*"), F.sum(F.exp(F.least(F.lit(0.0), F.col("log_weight"))))).first()
    k = min(rows, round(expected or 0) if k is None else k)
    # Keys of any size, in their order: the resolution is relative, as a double's is.
    key = F.floor((F.asinh("gumbel_key") + float(_KEY_SHIFT)) * float(_KEY_SCALE)).cast("long")
    cut = exact_cuts(weighed.select(F.lit(0).alias("node"), key.alias("key"), F.lit(1).alias("weight")), {0: rows - k}, _KEY_BITS, 12)[0] if rows else 0
    return weighed.select(F.col("id").alias(id_col), "log_weight", "gumbel_key", (key >= F.lit(cut)).alias("selected"), *[F.col(f"carried_{c}").alias(c) for c in carry])
