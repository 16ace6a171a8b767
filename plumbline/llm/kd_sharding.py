"""K-d tree sharding: shards of near-equal bytes whose documents are alike in their metadata.

A node is a set of documents that will make some number of shards. It is split
along its widest metadata dimension (the largest extent, in shares of the whole
table's), at the weighted median, or, for an odd number of shards, at the
weight that the lower part should have. All nodes of a level are split at
once. Leaves have one shard: the target is the table's bytes over the shards.

The median is exact and needs no sort: a histogram of the key's leading bits
is summed on the executors, the bucket that holds the median is opened at the next
bits, and so on (``exact_cuts``): the driver sees counts, never rows. A key is the
dimension's value, then the text's checksum, then a hash of the id: where values
tie, a third of all rows with one value or text too, the cut goes between two rows, and equal
texts stay next to each other. A string counts by its first six bytes after those that all values of its column begin with.

Only built-in column functions are used. A null text has no bytes, null metadata
count as 0, a null id is put like any other. Repeated rows are rows of their own, each with
its slot. An empty table gives no rows. Columns other than those named are left
out.
"""

from __future__ import annotations

from collections.abc import Sequence
from os.path import commonprefix

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import by_node, exact_cuts, salted_rank, stored

#: Bytes that every document weighs besides its text.
ROW_BYTES = 8
#: A cut needn't be nearer to its target than this share of a shard.
CLOSE = 1e-4
#: Rows that one task numbers within a shard.
RANKED_ROWS = 20_000
_VALUE_BITS = 30
_TIE_BITS = 32


def text_order(name: str, common: str = "") -> Column:
    """A number by which strings sort, roughly: their first six bytes after the beginning that all have in common."""
    rest = F.col(name).cast("string").substr(F.lit(len(common) + 1), F.lit(6))
    first = F.substring(F.rpad(F.hex(rest), 12, "0"), 1, 12)
    return F.coalesce(F.conv(first, 16, 10).cast("double"), F.lit(0.0))


def number(name: str) -> Column:
    value = F.col(name).cast("double")
    return F.when(value.isNull() | F.isnan(value), 0.0).otherwise(value)


def kd_shards(docs: DataFrame, shards: int | None, numbers: Sequence[str], texts: Sequence[str], target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot) of every document.

    numbers, texts: columns of metadata to split by. shards: how many, or as many as ``target_bytes`` asks for.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    ranges = docs.agg(F.lit(0), *[f(F.col(c).cast("string")) for c in texts for f in (F.min, F.max)]).first()
    common = [commonprefix([x or "" for x in ranges[1 + 2 * i : 3 + 2 * i]]) for i in range(len(texts))]
    dimensions = [number(c) for c in numbers] + [text_order(c, p) for c, p in zip(texts, common, strict=True)]
    names = [f"x{i}" for i in range(len(dimensions))]
    rows = stored(
        docs.select(
            F.col(id_col).alias("id"), (F.octet_length(text).cast("long") + ROW_BYTES).alias("size"), F.crc32(text).alias("text_crc32"), *[c.cast("double").alias(n) for n, c in zip(names, dimensions, strict=True)]
        ),
        "sizes",
    )
    ends = rows.agg(F.count("*").alias("rows"), F.sum("size").alias("size"), *[f(n).alias(f"{f.__name__}_{n}") for n in names for f in (F.min, F.max)]).first()
    if shards is None:
        shards = max(1, -(-(ends["size"] or 0) // target_bytes))
    leaf = (ends["size"] or 0) / shards
    scale = (1 << _VALUE_BITS) - 1
    tie = F.shiftleft(F.shiftright("text_crc32", 16), 16).bitwiseOR(F.xxhash64("id", "text_crc32").bitwiseAND(0xFFFF))
    values = {}
    for n in names:
        low, high = ends[f"min_{n}"], ends[f"max_{n}"]
        share = (F.col(n) - F.lit(low)) / F.lit(high - low) if ends["rows"] and high > low else F.lit(0.0)
        values[n] = F.floor(share * scale).cast("long")

    def key(n: str) -> Column:
        return F.shiftleft(values[n], _TIE_BITS).bitwiseOR(tie)

    tree: dict[int, tuple[int, int]] = {1: (0, shards)}  # node: first shard, shards
    splits: dict[int, tuple[int, int]] = {}  # node: number of the dimension, cut
    keys = F.array(*[key(n) for n in names])

    def at_node(keys: Column, depth: int) -> Column:
        """The node that a row has come to."""
        if not splits:
            return F.lit(1)
        last = max(splits) + 1
        along, cuts = (F.lit([splits[n][i] if n in splits else -1 for n in range(last)]).cast("array<bigint>") for i in (0, 1))
        step = lambda node, _: F.when(F.coalesce(F.get(along, node), F.lit(-1)) < 0, node).otherwise(2 * node + (F.get(keys, F.get(along, node).cast("int")) >= F.get(cuts, node)).cast("int"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(1), step)

    depth = 0
    while ends["rows"]:
        wide = [n for n, (_, many) in tree.items() if many > 1 and n not in splits]
        if not wide:
            break
        placed = rows.select("*", keys.alias("keys")).withColumn("node", at_node(F.col("keys"), max(depth, 1))).where(F.col("node").isin(wide))
        extent = [(F.max(values[n]) - F.min(values[n])).alias(n) for n in names]
        found = {r["node"]: r for r in placed.groupBy("node").agg(F.sum("size").alias("size"), *extent).collect()}
        widest = {n: max(range(len(names)), key=lambda x, r=found.get(n): r[names[x]] if r else 0) for n in wide}
        along = F.get("keys", by_node(widest).cast("int"))
        targets = {n: (found[n]["size"] if n in found else 0) * (tree[n][1] // 2) / tree[n][1] for n in wide}
        cuts = exact_cuts(placed.select("node", along.alias("key"), F.col("size").alias("weight")), targets, _VALUE_BITS + _TIE_BITS, close=CLOSE * leaf)
        for n in wide:
            first, many = tree[n]
            splits[n] = (widest[n], cuts[n])
            tree[2 * n], tree[2 * n + 1] = (first, many // 2), (first + many // 2, many - many // 2)
        depth += 1
    shard = by_node({n: first for n, (first, many) in tree.items() if many == 1})
    placed = rows.select("*", keys.alias("keys")).withColumn("node", at_node(F.col("keys"), max(depth, 1))).select("id", "size", "text_crc32", shard.cast("int").alias("shard"))
    salts = (ends["rows"] or 0) // (shards * RANKED_ROWS) + 1
    ranked = salted_rank(placed, ["shard"], F.pmod(F.xxhash64("id", "text_crc32"), F.lit(salts)), ["id", "text_crc32"], "slot")
    return ranked.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", F.col("slot").cast("long"))
