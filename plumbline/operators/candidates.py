"""Pairs of panels worth scoring: the best ``max_pairs`` by a score of four features, without meeting all pairs.

A pair's score falls short of the most by its *distance*: bits of the perceptual hash, 0.75 for each bit of the difference hash, 40 (1 - cosine of the
edge histograms) and 12 (1 - ratio of the areas). Each part alone bounds the distance, so pairs within a radius meet by equality:

1.  Panels of equal features form a class, which travels as one row; of its ids the first ``max_pairs`` + 1 can matter.
2.  Within a radius r the two hashes together differ in at most r / 0.75 bits. Cut into that many bands and one more (two more), one band (two bands) are
    equal. The same holds for each hash alone. Which of these keys is used is measured: the number of pairs that each would make is counted from its groups, so a
    hash that all panels share, or one of few values, is left to the others.
3.  The radius grows until ``max_pairs`` pairs lie within it: no other pair can score as much. Candidates are checked exactly.
4.  Where no key would meet fewer than a quarter of all pairs (bits that are random beyond a radius of about 12 give no better index), all classes are
    held against all in blocks: a task has two blocks, scores them by matrix products and keeps its own best ``max_pairs``. The result is the same.

So work is below the square of the panels when ``max_pairs`` near pairs exist, as they do where reuse is searched for, and a
blocked product, with no row for a pair that isn't kept, where they don't.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.sources.store import stored

#: Up to so many panels all pairs are candidates; then only those that one of these limits lets through.
EXHAUSTIVE = 80
NEAR_BITS, NEAR_EDGES, UNLIKE_AREA = 18, 0.55, 0.65
MAX_PAIRS = 5000
# What a bit of either hash, the edges and the areas count in the score.
PHASH, DHASH, EDGES, AREA = 1.0, 0.75, 40.0, 12.0
MOST = 64 * PHASH + 64 * DHASH + EDGES + AREA
#: Radii that are tried, and classes of a block.
RADII = (3.0, 6.0, 9.0, 12.0, 16.0, 20.0)
BLOCK = 1024
#: What sums of floating point in another order may differ by.
SLACK = 1e-6


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.greatest(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(1e-9))


def recall_score() -> Column:
    return (64 - F.col("phash_distance")) + 0.75 * (64 - F.col("dhash_distance")) + 40 * F.col("edge_hist_corr") + 12 * F.col("area_ratio")


def _measured(pairs: DataFrame, every: bool) -> DataFrame:
    """Pairs of classes with their distances and score; those that no limit lets through go, unless every pair is asked for."""
    area = lambda s: F.col(f"width_{s}").cast("double") * F.col(f"height_{s}")
    pairs = pairs.select(
        "class_a", "class_b", "first_a", "first_b", "size_a", "size_b",
        hamming(F.col("phash_a"), F.col("phash_b")).alias("phash_distance"), hamming(F.col("dhash_a"), F.col("dhash_b")).alias("dhash_distance"),
        cosine(F.col("edge_hist_a"), F.col("edge_hist_b")).alias("edge_hist_corr"), (F.least(area("a"), area("b")) / F.greatest(area("a"), area("b"))).alias("area_ratio"),
    )
    if not every:
        pairs = pairs.where((F.col("phash_distance") <= NEAR_BITS) | (F.col("dhash_distance") <= NEAR_BITS) | (F.col("edge_hist_corr") >= NEAR_EDGES) | (F.col("area_ratio") < UNLIKE_AREA))
    return pairs.withColumn("recall_score", recall_score())


def _band(hashes: list[Column], begin: int, end: int) -> Column:
    """Bits begin to end (exclusive) of 64-bit hashes one after the other."""
    parts = []
    for i, h in enumerate(hashes):
        a, b = max(begin - 64 * i, 0), min(end - 64 * i, 64)
        if a < b:
            part = F.shiftrightunsigned(h, a)
            parts.append(part if b - a == 64 else part.bitwiseAND((1 << (b - a)) - 1))
    return F.struct(*[p.alias(f"p{i}") for i, p in enumerate(parts)]) if len(parts) > 1 else parts[0]


def band_keys(hashes: list[Column], differ: int, equal: int) -> Column | None:
    """Keys of which hashes that differ in at most ``differ`` bits share one: ``equal`` bands of ``differ + equal``."""
    bits, n = 64 * len(hashes), differ + equal
    if n > bits:
        return None
    edges = [bits * i // n for i in range(n + 1)]
    bands = [F.xxhash64(F.lit(i), _band(hashes, a, b)) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
    return F.array(*[F.xxhash64(*[bands[i] for i in some]) for some in combinations(range(n), equal)])


def _indexed(classes: DataFrame, radius: float, total: int) -> tuple[int, DataFrame] | None:
    """(pairs that meet, keyed classes) by the key that makes the fewest pairs within a radius."""
    phash, dhash = F.col("phash"), F.col("dhash")
    best = None
    for hashes, weight in (([phash, dhash], DHASH), ([phash], PHASH), ([dhash], DHASH)):
        differ = int(radius / weight)
        for equal in (1, 2):
            keys = band_keys(hashes, differ, equal)
            if keys is None or equal == 2 and (differ + 2) * (differ + 1) // 2 > max(16, total // 64):
                continue
            keyed = classes.select("class", F.explode(keys).alias("key"))
            met = keyed.groupBy("key").agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] or 0
            if best is None or met < best[0]:
                best = int(met), keyed
    return best


_SIDE = "phash", "dhash", "edge_hist", "width", "height", "first", "size"


def _sides(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    for s in ("a", "b"):
        pairs = pairs.join(classes.select(F.col("class").alias(f"class_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in _SIDE]), f"class_{s}")
    return pairs


def _block_pairs(max_pairs: int, every: bool):
    """The best pairs of two blocks, as pairs of classes; a little more than ``max_pairs`` of them where the last ones nearly tie."""

    def scored(held: pd.DataFrame) -> pd.DataFrame:
        one, two = held[held["side"] == held["i"]], held[held["side"] == held["j"]]
        bits = lambda x: np.unpackbits(np.array(x, dtype="<i8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32) * 2 - 1
        apart = lambda c: (64 - bits(one[c]) @ bits(two[c]).T) / 2
        edges = [np.stack(x["edge_hist"].to_numpy()).astype(np.float64) for x in (one, two)]
        norms = [np.sqrt((e * e).sum(axis=1)) for e in edges]
        cos = edges[0] @ edges[1].T / np.maximum(np.outer(*norms), 1e-9)
        area = [x["width"].to_numpy().astype(np.float64) * x["height"].to_numpy() for x in (one, two)]
        ratio = np.minimum.outer(*area) / np.maximum.outer(*area)
        ph, dh = apart("phash"), apart("dhash")
        score = (64 - ph) + DHASH * (64 - dh) + EDGES * cos + AREA * ratio
        ids = [x["class"].to_numpy() for x in (one, two)]
        good = np.less.outer(*ids) if held["i"].iloc[0] == held["j"].iloc[0] else np.ones(score.shape, dtype=bool)
        if not every:
            good &= (ph <= NEAR_BITS) | (dh <= NEAR_BITS) | (cos >= NEAR_EDGES - SLACK) | (ratio < UNLIKE_AREA + SLACK)
        score = np.where(good, score, -np.inf)
        least = np.partition(score.ravel(), -max_pairs)[-max_pairs] if score.size > max_pairs else -np.inf
        a, b = np.nonzero(good & (score >= least - SLACK))
        return pd.DataFrame({"class_a": ids[0][a], "class_b": ids[1][b]})

    def run(held: pd.DataFrame) -> pd.DataFrame:
        if {*held["side"]} != {held["i"].iloc[0], held["j"].iloc[0]}:
            return pd.DataFrame({"class_a": [], "class_b": []}, dtype="int64")
        return scored(held)

    return run


def _by_blocks(classes: DataFrame, total: int, max_pairs: int, every: bool) -> DataFrame:
    blocks = max(1, -(-total // BLOCK))
    sided = classes.withColumn("side", F.pmod(F.xxhash64("class"), F.lit(blocks)))
    spread = sided.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    dealt = spread.select(F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "class", "phash", "dhash", "edge_hist", "width", "height")
    return dealt.groupBy("i", "j").applyInPandas(_block_pairs(max_pairs, every), "class_a long, class_b long")


def _expanded(best: DataFrame, classes: DataFrame, max_pairs: int) -> DataFrame:
    """Pairs of panels of the best pairs of classes: of a class pair the i-th and j-th panels can only matter if i * j <= max_pairs."""
    # Both windows are over max_pairs rows.
    before = F.sum("pairs").over(Window.orderBy(F.desc("recall_score")).rangeBetween(Window.unboundedPreceding, Window.currentRow)) - F.sum("pairs").over(Window.partitionBy("recall_score"))
    asked = best.withColumn("before", before).where(F.col("before") < max_pairs).drop("before", "pairs", "first_a", "first_b", "size_a", "size_b")
    members = classes.select("class", F.posexplode("ids").alias("nth", "panel_id"))
    one = members.select(F.col("class").alias("class_a"), F.col("nth").alias("nth_a"), F.col("panel_id").alias("p"))
    two = members.select(F.col("class").alias("class_b"), F.col("nth").alias("nth_b"), F.col("panel_id").alias("q"))
    within = (F.col("nth_a") + 1) * (F.col("nth_b") + 1) <= 2 * max_pairs
    pairs = asked.join(one, "class_a").join(two, "class_b").where(within & ((F.col("class_a") != F.col("class_b")) | (F.col("p") < F.col("q"))))
    return pairs.select(F.least("p", "q").alias("panel_id_a"), F.greatest("p", "q").alias("panel_id_b"), "phash_distance", "dhash_distance", "edge_hist_corr", "area_ratio", "recall_score")


def candidate_pairs(found: DataFrame, max_pairs: int = MAX_PAIRS) -> DataFrame:
    """Pairs of panels worth scoring, best first (ties by ids).

    Beyond ``EXHAUSTIVE`` panels a pair has to be near in one of four ways.
    """
    features = found.select("panel_id", "phash", "dhash", "edge_hist", "width", "height")
    classes = features.groupBy("phash", "dhash", "edge_hist", "width", "height").agg(F.count("*").alias("size"), F.min("panel_id").alias("first"))
    classes = stored(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    sums = classes.agg(F.sum("size").alias("panels"), F.count("*").alias("classes")).first()
    panels, total = sums["panels"] or 0, sums["classes"]
    every = panels <= EXHAUSTIVE
    own = classes.where("size > 1").select(F.col("class").alias("class_a"), F.col("class").alias("class_b"))
    chosen = None
    if not every:
        for radius in RADII:
            index = _indexed(classes, radius, total)
            if index is None or index[0] > max(total * total / 8, 1000):
                break
            keyed = stored(index[1], "keyed")
            met = keyed.select(F.col("class").alias("class_a"), "key").join(keyed.select(F.col("class").alias("class_b"), "key"), "key").where("class_a < class_b").select("class_a", "class_b").distinct()
            near = stored(_measured(_sides(met.unionByName(own), classes), every).where(F.col("recall_score") >= MOST - radius), "near")
            pairs = near.agg(F.sum(_pairs()).alias("n")).first()["n"] or 0
            if pairs >= max_pairs:
                chosen = near
                break
    if chosen is None:
        chosen = _measured(_sides(_by_blocks(classes, total, max_pairs, every).unionByName(own), classes), every)
    firsts = F.least("first_a", "first_b"), F.greatest("first_a", "first_b")
    # One more, as a class paired with itself begins with its second panel and not with its first.
    best = stored(chosen.withColumn("pairs", _pairs()).orderBy(F.desc("recall_score"), *firsts).limit(max_pairs + 1), "best")
    asked = best.select(F.explode(F.array("class_a", "class_b")).alias("class")).distinct()
    keys = ["phash", "dhash", "edge_hist", "width", "height"]
    members = features.join(classes.join(asked, "class").select("class", *keys), keys).select("class", "panel_id")
    ids = members.repartitionByRange("class", "panel_id").sortWithinPartitions("class", "panel_id")
    return _expanded(best, _first_ids(ids, max_pairs + 1), max_pairs).orderBy(F.desc("recall_score"), "panel_id_a", "panel_id_b").limit(max_pairs)


def _pairs() -> Column:
    """Pairs of panels that a pair of classes stands for."""
    return F.when(F.col("class_a") == F.col("class_b"), F.col("size_a") * (F.col("size_a") - 1) / 2).otherwise(F.col("size_a") * F.col("size_b")).cast("double")


def _first_ids(members: DataFrame, most: int) -> DataFrame:
    """(class, ids): the first ``most`` ids of each class. Each sorted part passes on no more than that of a class."""

    def firsts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, n = None, 0
        for batch in batches:
            keep = []
            for c in batch["class"].tolist():
                n = n + 1 if c == now else 1
                now = c
                keep.append(n <= most)
            yield batch[keep]

    few = members.mapInPandas(firsts, "class long, panel_id string")
    return few.groupBy("class").agg(F.slice(F.array_sort(F.collect_list("panel_id")), 1, most).alias("ids"))
