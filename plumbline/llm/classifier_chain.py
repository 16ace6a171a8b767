"""Toxicity by a classifier chain.

Categories are predicted one after the other: each has a linear (logistic) model of the
text's features and of the probabilities of the categories before it (Read et
al. 2009). A model is trained on out-of-fold probabilities of the earlier ones: those
that models of the other folds give a row, so that it learns how far to trust them
on texts they haven't seen.

Features are hashes of a text's distinct words and of their leading bytes (words of
one stem share these). Which are used is settled first: counts over the rows that a model is trained on
keep the ``FEATURES`` that tell a category best, so a long clean text isn't weighed
down by thousands of words that say nothing. A fold's own rows have no part in choosing what its models see.

It is fitted on at most ``rows`` labelled ids (the smallest hashes of the id): a list
of a bounded size, broadcast. One text of each is stored, and a few features of each come to the driver. Scoring
covers every text and shuffles nothing.

Each category's threshold is the one with the best F1 out of fold. A null or empty text has no features
and gets the base rate. Of labels that disagree the positive one counts, of texts of one labelled id the smallest is learned from. Labels that are null, or of ids that aren't there, have no effect; a
category without positive labels gets probability 0. Repeated rows get equal results, a null id stays
null. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import stored
from plumbline.llm.textkernel import Words, alphanumeric, mix, runs

BUCKETS = 1 << 18
FEATURES = 4096
ROWS = 20_000
FOLDS = 5
PREFIXES = (4, 5, 6)
#: A feature has to occur in so many labelled rows.
LEAST_ROWS = 4


def _features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of each distinct feature of a run of texts."""
    text = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    kinds = [(words.hash, text)]
    for n in PREFIXES:
        longer = words.end - words.begin > n
        kinds.append((mix(words.prefix(n)[longer] + np.uint64(n)), text[longer]))
    every = np.concatenate([t.astype(np.int64) * BUCKETS + (h & np.uint64(BUCKETS - 1)).astype(np.int64) for h, t in kinds])
    every = np.unique(every)
    return every // BUCKETS, every % BUCKETS


def _fold(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64)) % np.uint64(FOLDS)).astype(int)


def _counted(known, categories: int):
    """(bucket, counts) of each task's labelled texts: rows of each fold, then positive rows of each category and fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, truth = known.value
        counts = np.zeros((1 + categories, FOLDS, BUCKETS), dtype=np.int64)
        for batch in batches:
            key = batch.column(0).to_numpy()
            at, fold = np.searchsorted(ids, key), _fold(key)
            for j, data, offsets in runs(batch.column(1)):
                text, bucket = _features(Words(data, offsets, alphanumeric()))
                place = fold[j + text] * BUCKETS + bucket
                counts[0] += np.bincount(place, minlength=FOLDS * BUCKETS).reshape(FOLDS, BUCKETS)
                of = truth[at[j + text]]
                for c in range(categories):
                    counts[1 + c] += np.bincount(place[of[:, c]], minlength=FOLDS * BUCKETS).reshape(FOLDS, BUCKETS)
        some = np.flatnonzero(counts[0].any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(list(counts.reshape(-1, BUCKETS)[:, some].T), pa.list_(pa.int64()))], names=["bucket", "counts"])

    return run


def _chosen(bucket: np.ndarray, n: np.ndarray, positive: np.ndarray, rows: int, truths: np.ndarray) -> np.ndarray:
    """Buckets whose share of positive rows is farthest from the usual one, in standard errors, for one category or another. positive: categories x buckets."""
    out = []
    for of, total in zip(positive, truths, strict=True):
        share = total / max(rows, 1)
        z = np.abs(of - n * share) / np.sqrt(np.maximum(n, 1) * max(share * (1 - share), 1e-9))
        z[n < LEAST_ROWS] = -1
        best = np.lexsort((bucket, -z))[: FEATURES // len(positive)]
        out.append(bucket[best[z[best] >= 0]])
    return np.unique(np.concatenate(out))


def _sparse(chosen):
    """The chosen features of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = chosen.value
        for batch in batches:
            out: list[np.ndarray] = []
            for _, data, offsets in runs(batch.column(1)):
                text, bucket = _features(Words(data, offsets, alphanumeric()))
                used = number[bucket] >= 0
                text, found = text[used], number[bucket[used]]
                edge = np.searchsorted(text, np.arange(len(offsets)))
                out += [found[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], names=["id", "found"])

    return run


@dataclass
class Linear:
    """A logistic model of sparse presence features and of the logits of earlier categories."""

    weights: np.ndarray
    before: np.ndarray
    bias: float

    def logit(self, row: np.ndarray, feature: np.ndarray, n: int, before: np.ndarray) -> np.ndarray:
        out = np.bincount(row, weights=self.weights[feature], minlength=n) + self.bias
        return out + before @ self.before if before.shape[1] else out


def fit(row: np.ndarray, feature: np.ndarray, before: np.ndarray, truth: np.ndarray, features: int, ridge: float = 1e-3, steps: int = 150) -> Linear:
    """Gradient descent with momentum-free adaptive steps; deterministic."""
    n = len(truth)
    model = Linear(np.zeros(features), np.zeros(before.shape[1]), float(np.log((truth.sum() + 0.5) / (n - truth.sum() + 0.5))))
    seen = np.full(features, 1e-8), np.full(before.shape[1], 1e-8)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(model.logit(row, feature, n, before), -30, 30)))
        off = (p - truth) / n
        g = np.bincount(feature, weights=off[row], minlength=features) + ridge * model.weights / n
        seen[0][:] += g * g
        model.weights -= 0.5 * g / np.sqrt(seen[0])
        if before.shape[1]:
            h = before.T @ off
            seen[1][:] += h * h
            model.before -= 0.1 * h / np.sqrt(seen[1])
        model.bias -= 0.5 * off.sum()
    return model


@dataclass
class Chain:
    names: list[str]
    number: np.ndarray
    models: list[Linear]
    thresholds: list[float]
    f1: list[float]


def trained(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> Chain:
    """categories: in the order of the chain, what makes a labelled row positive."""
    spark = docs.sparkSession
    names = list(categories)
    truth_of = [F.max(F.coalesce(c, F.lit(False)).cast("boolean")).alias(f"c{i}") for i, c in enumerate(categories.values())]
    marked = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(*truth_of)
    marked = sorted((tuple(r) for r in marked.orderBy(F.xxhash64("id"), "id").limit(rows).collect()), key=lambda r: r[0])
    ids = np.array([r[0] for r in marked], dtype=np.int64)
    truth = np.array([r[1:] for r in marked], dtype=bool).reshape(len(ids), len(names))
    number = np.full(BUCKETS, -1, dtype=np.int32)
    nothing = Chain(names, number, [Linear(np.zeros(1), np.zeros(i), -30.0) for i in range(len(names))], [0.5] * len(names), [0.0] * len(names))
    if not len(ids):
        return nothing
    # At most ``rows`` ids, so the broadcast has a fixed bound.
    wanted = F.broadcast(spark.createDataFrame([(int(i),) for i in ids], "id long"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(wanted, "id")
    texts = stored(texts.groupBy("id").agg(F.min("text").alias("text")), "labelled")
    known = spark.sparkContext.broadcast((ids, truth))
    counted = texts.mapInArrow(_counted(known, len(names)), "bucket long, counts array<long>")
    width = (1 + len(names)) * FOLDS
    sums = counted.groupBy("bucket").agg(*[F.sum(F.get("counts", F.lit(i))).alias(f"s{i}") for i in range(width)])
    some = sums.where(sum((F.col(f"s{i}") for i in range(FOLDS)), F.lit(0)) >= LEAST_ROWS).toArrow()  # BUCKETS rows at most
    if not some.num_rows:
        return nothing
    bucket = some["bucket"].to_numpy()
    counts = np.stack([some[f"s{i}"].to_numpy() for i in range(width)]).reshape(1 + len(names), FOLDS, -1)
    present = np.sort(texts.select("id").toArrow()["id"].to_numpy())  # rows at most
    here, in_fold = truth[np.searchsorted(ids, present)], _fold(present)
    sets = []
    for k in range(FOLDS + 1):  # the last one is for the models that score: all folds
        used = np.arange(FOLDS) != k
        train = in_fold != k
        sets.append(_chosen(bucket, counts[0, used].sum(axis=0), counts[1:, used].sum(axis=1), int(train.sum()), here[train].sum(axis=0)))
    best = np.unique(np.concatenate(sets))
    number[best] = np.arange(len(best))
    allowed = np.zeros((FOLDS + 1, len(best)), dtype=bool)
    for k, found in enumerate(sets):
        allowed[k, number[found]] = True
    if not len(best):
        return nothing
    chosen = spark.sparkContext.broadcast(number)
    del some, counts
    # As arrays, not as lists of numbers, each of which would be an object of the driver.
    got = texts.mapInArrow(_sparse(chosen), "id long, found array<int>").toArrow().sort_by("id")
    n, key = got.num_rows, got["id"].to_numpy()
    row = np.repeat(np.arange(n), pc.list_value_length(got["found"]).to_numpy())
    feature = pc.list_flatten(got["found"]).to_numpy().astype(np.int64)
    del got
    truth = truth[np.searchsorted(ids, key)]
    fold = _fold(key)
    before = np.zeros((n, 0))
    models, thresholds, scores = [], [], []
    for c in range(len(names)):
        out = np.zeros(n)
        for k in range(FOLDS):
            train, held = fold != k, fold == k
            place = np.cumsum(train) - 1
            inside = train[row] & allowed[k, feature]
            model = fit(place[row[inside]], feature[inside], before[train], truth[train, c], len(best))
            place = np.cumsum(held) - 1
            inside = held[row] & allowed[k, feature]
            out[held] = model.logit(place[row[inside]], feature[inside], int(held.sum()), before[held])
        inside = allowed[FOLDS, feature]
        models.append(fit(row[inside], feature[inside], before, truth[:, c], len(best)))
        order = np.argsort(-out)
        hit = np.cumsum(truth[order, c])
        f1 = 2 * hit / (np.arange(1, n + 1) + max(1, truth[:, c].sum()))
        at = int(f1.argmax())
        # Halfway to the next lower one, in logits.
        cut = out[order[at]] if at + 1 >= n else (out[order[at]] + out[order[at + 1]]) / 2
        thresholds.append(float(1 / (1 + np.exp(-cut))))
        scores.append(float(f1[at]))
        before = np.column_stack([before, np.clip(out, -8, 8)])
    return Chain(names, number, models, thresholds, scores)


def _scores(told):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain: Chain = told.value
        for batch in batches:
            out: list[np.ndarray] = []
            for _, data, offsets in runs(batch.column(1)):
                n = len(offsets) - 1
                text, bucket = _features(Words(data, offsets, alphanumeric()))
                used = chain.number[bucket] >= 0
                text, found = text[used], chain.number[bucket[used]]
                before = np.zeros((n, 0))
                for model in chain.models:
                    logit = model.logit(text, found, n, before)
                    before = np.column_stack([before, np.clip(logit, -8, 8)])
                    out.append(1 / (1 + np.exp(-np.clip(logit, -30, 30))))
            k = len(chain.models)
            columns = [pa.array(np.concatenate(out[c::k])) for c in range(k)] if out else [pa.array([], pa.float64()) for _ in range(k)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", *[f"p{c}" for c in range(k)]])

    return run


def scored(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, p_<category> and <category> for each category) of every row."""
    chain = trained(docs, labels, categories, rows, id_col, text_col)
    told = docs.sparkSession.sparkContext.broadcast(chain)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    probabilities = texts.mapInArrow(_scores(told), "id long, " + ", ".join(f"p{c} double" for c in range(len(chain.names))))
    columns = [F.col("id").alias(id_col)]
    for c, (name, threshold) in enumerate(zip(chain.names, chain.thresholds, strict=True)):
        columns += [F.col(f"p{c}").alias(f"p_{name}"), (F.col(f"p{c}") >= threshold).alias(name)]
    return probabilities.select(*columns)
