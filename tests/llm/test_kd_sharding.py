import math
import random
import struct
import zlib
from os.path import commonprefix

import pytest
import xxhash
from cases import documents, empty, texts

from plumbline.llm.common import exact_cuts, salted_rank
from plumbline.llm.kd_sharding import kd_shards
from pyspark.sql import functions as F


NUMBERS, TEXTS = ["n_chars", "doc_id"], ["lang", "source"]


def shards(spark, docs, n=6):
    return kd_shards(docs, n, NUMBERS, TEXTS).collect()


def brute(rows, n):
    """The tree, node by node, over rows (id, text, numbers and texts): {id: shard}."""
    items = []
    for i, text, *values in rows:
        raw = (text or "").encode()
        crc = zlib.crc32(raw)
        h = xxhash.xxh64(struct.pack("<q", crc), seed=xxhash.xxh64(struct.pack("<q", i), seed=42).intdigest()).intdigest()
        items.append((i, len(raw) + 8, (crc >> 16 << 16) | (h & 0xFFFF), [float(v) if not isinstance(v, str) else v for v in values]))
    for d in range(len(items[0][3])):
        column = [x[3][d] for x in items]
        if isinstance(column[0], str):
            skip = len(commonprefix([min(column), max(column)]))
            column = [float(int.from_bytes(v[skip : skip + 6].encode()[:6].ljust(6, b"\0"))) for v in column]
        low, high = min(column), max(column)
        for x, v in zip(items, column):
            x[3][d] = math.floor((v - low) / (high - low) * ((1 << 30) - 1)) if high > low else 0
    out = {}

    def split(part, first, many):
        if many == 1:
            out.update((x[0], first) for x in part)
            return
        extent = [max(x[3][d] for x in part) - min(x[3][d] for x in part) for d in range(len(part[0][3]))]
        d = extent.index(max(extent))
        target, below, cut = sum(x[1] for x in part) * (many // 2) / many, 0, None
        weights = {}
        for x in part:
            key = (x[3][d] << 32) | x[2]
            weights[key] = weights.get(key, 0) + x[1]
        for key in sorted(weights):
            if below + weights[key] >= target:
                cut = key + (below + weights[key] - target < target - below)
                break
            below += weights[key]
        split([x for x in part if ((x[3][d] << 32) | x[2]) < cut], first, many // 2)
        split([x for x in part if ((x[3][d] << 32) | x[2]) >= cut], first + many // 2, many - many // 2)

    split(items, 0, n)
    return out


@pytest.mark.parametrize("n", [2, 7, 24])
def test_against_a_tree_split_node_by_node(spark, n):
    rng = random.Random(n)
    rows = [(i, "x" * rng.randrange(300), rng.randrange(1000), rng.choice(["en", "de", "fr"]), "https://host/" + rng.choice("abcdefgh") + str(i % 5)) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, lang string, source string").repartition(4)
    got = {r.doc_id: r.shard for r in kd_shards(docs, n, ["n_chars", "doc_id"], ["lang", "source"]).collect()}
    assert got == brute([(i, t, c, i, lang, source) for i, t, c, lang, source in rows], n)


def test_shards_of_target_bytes_and_very_many(spark):
    docs = spark.createDataFrame([(i, "y" * 92, "en", "s", i % 9) for i in range(3_000)], "doc_id long, text string, lang string, source string, n_chars long")
    sizes: dict[int, int] = {}
    for r in kd_shards(docs, None, NUMBERS, TEXTS, target_bytes=300).collect():
        sizes[r.shard] = sizes.get(r.shard, 0) + r.size
    assert len(sizes) == 1_000 and max(sizes.values()) <= 400


def test_every_row_once_and_sizes_near_equal(spark):
    found = texts(n=900)
    found[8] = "x"
    got = shards(spark, documents(spark, found))
    assert sorted(r.doc_id for r in got) == list(range(len(found)))
    by: dict[int, list] = {}
    for r in got:
        raw = (found[r.doc_id] or "").encode()
        assert r.size == len(raw) + 8 and r.text_crc32 == zlib.crc32(raw)
        by.setdefault(r.shard, []).append(r)
    assert sorted(by) == list(range(6))
    sizes = [sum(r.size for r in rows) for rows in by.values()]
    assert max(sizes) - min(sizes) < 3 * max(r.size for r in got)
    for rows in by.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))


def test_one_text_in_every_row(spark):
    docs = spark.createDataFrame([(i, "same text", "en", "s", 9) for i in range(600)], "doc_id long, text string, lang string, source string, n_chars long")
    sizes: dict[int, int] = {}
    for r in shards(spark, docs, 24):
        sizes[r.shard] = sizes.get(r.shard, 0) + 1
    assert len(sizes) == 24 and max(sizes.values()) - min(sizes.values()) <= 2


def test_nulls_and_repeats_and_nothing(spark):
    assert shards(spark, empty(spark)) == []
    rows = [(None, None, None, None, None), (1, "a", "en", "s", 1.0), (1, "a", "en", "s", 1.0), (2, None, None, "s", float("nan"))]
    got = shards(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars double"), 2)
    assert len(got) == 4 and len({(r.shard, r.slot) for r in got}) == 4


@pytest.mark.parametrize("step", [3, 10])
def test_exact_cuts(spark, step):
    rows = [(0, (i * 37) % 1000, i % 5 + 1) for i in range(400)] + [(1, 5, 1)] * 10
    df = spark.createDataFrame(rows, "node int, key long, weight long")
    total = sum(w for n, _, w in rows if n == 0)
    cuts = exact_cuts(df, {0: total / 3, 1: 5.0, 2: 1.0}, bits=20, step=step)
    below = sum(w for n, k, w in rows if n == 0 and k < cuts[0])
    assert abs(below - total / 3) <= 2.5
    assert cuts[1] in (5, 6)


def test_salted_rank(spark):
    df = spark.range(1000).withColumn("g", F.when(F.col("id") < 900, 0).otherwise(F.col("id") % 3))
    got = salted_rank(df, ["g"], F.pmod(F.xxhash64("id"), F.lit(7)), ["id"], "rank").collect()
    by: dict[int, list] = {}
    for r in got:
        by.setdefault(r.g, []).append(r["rank"])
    assert all(sorted(x) == list(range(len(x))) for x in by.values()) and sum(map(len, by.values())) == 1000
