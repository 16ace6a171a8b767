"""Prefix tries of conversations: which turns many conversations begin with, and what computing each shared prefix once saves.

1.  ``sequences``: a conversation is its turns' digests (SHA-256 of role and text) in order, and its texts' lengths. Texts go no further.
2.  Conversations of one sequence form a class with a weight, so that copies, however many, are one row from here on. Their ids are
    hashed in order from strings of at most ``IDS`` ids, in a stream.
3.  Classes are partitioned by the hash of their first turn. A first turn whose subtrie is ``oversized`` is
    repartitioned by the next turn at which its classes part (the end of their common prefix), and again, until no part is: each round is a few shuffles
    of those parts alone. The turns before a parting are a *stem*.
4.  ``applyInPandas`` builds the tries of a bucket of parts: a dictionary of
    pointers for each node, summed up in an iterative postorder. A task holds some ``BUCKET`` turns.
5.  Stems are summed up from the last round to the first, from their parts' tops, with partial sums before each shuffle.

A node is a distinct prefix; its row gives depth, the smallest member, the parent's smallest member, numbers of members and children, leaves and
saved code points in its subtree (it included), and the digest of the ids of those that end there.

Defined results: turns of null number come first, turns of one number in the order of their digests; null role and text are empty;
rows without a conversation id belong to none and are left out; a repeated row is a turn like others; an empty table has no node (not even a
root, as there is no member); other columns are left out. One conversation is one row of 36 bytes a turn and isn't cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import discard, stored

#: Turns of a subtrie beyond which it is repartitioned, and about how many a task builds tries of.
OVERSIZED, BUCKET = 2_000, 20_000
#: Ids of a class that come together in one string.
IDS = 1_000
NONE = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def _chained(start: Column, digests: Column) -> Column:
    """The digest of a prefix, from that of a shorter one and the turns after it."""
    return F.aggregate(digests, start, lambda so_far, turn: F.unhex(F.sha2(F.concat(so_far, turn), 256)))


def sequences(conversations: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(conv_id, digests of its turns in order, code points of their texts)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    said = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    turn = F.struct(F.col("turn").alias("t"), F.unhex(F.sha2(said.cast("binary"), 256)).alias("d"), F.length(text).alias("n"))
    turns = conversations.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv_id"), turn.alias("turn"))
    turns = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return turns.select("conv_id", F.col("turns.d").alias("digests"), F.col("turns.n").alias("sizes"))


def with_shared_heads(found: DataFrame) -> DataFrame:
    """Conversations whose first h turns are those of conversation c - c % 100, h being the crc32 of c's digits modulo 6."""
    heads = found.where("conv_id % 100 = 0").select(F.col("conv_id").alias("base"), *(F.slice(c, 1, 5).alias(f"head_{c}") for c in ("digests", "sizes")))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("int")
    joined = found.withColumn("base", F.col("conv_id") - F.col("conv_id") % 100).join(heads, "base", "left").withColumn("h", h)

    def spliced(c: str, kind: str) -> Column:
        head = F.slice(F.coalesce(F.col(f"head_{c}"), F.array().cast(kind)), F.lit(1), F.col("h"))
        return F.concat(head, F.slice(F.col(c), F.col("h") + 1, F.size(c))).alias(c)

    return joined.select("conv_id", spliced("digests", "array<binary>"), spliced("sizes", "array<int>"))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of classes from their strings of ids, which come in order; a class's strings are never held together."""
    now, state = None, None
    for batch in batches:
        out = []
        for key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if key == now:
                state.update(b",")
            else:
                if now is not None:
                    out.append((now, state.hexdigest()))
                now, state = key, hashlib.sha256()
            state.update(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.binary()), pa.array([d for _, d in out], pa.string())], names=["class", "ends"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.hexdigest()])], names=["class", "ends"])


def _ends(members: DataFrame) -> DataFrame:
    """(class, digest of its members' ids in order, comma-joined) of members(class, conv_id)."""
    block = F.col("conv_id") - F.pmod("conv_id", F.lit(IDS))
    strings = members.groupBy("class", block.alias("block")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    return strings.repartition("class").sortWithinPartitions("class", "block").select("class", "ids").mapInArrow(_hashed, "class binary, ends string")


def _classes(found: DataFrame) -> DataFrame:
    """(class, digests, sizes, n, least, ends) of the distinct sequences."""
    told = stored(found.withColumn("class", _chained(F.lit(b""), F.col("digests"))), "sequences")
    classes = told.groupBy("class").agg(F.count("*").alias("n"), F.min("conv_id").alias("least"), F.first("digests").alias("digests"), F.first("sizes").alias("sizes"))
    out = stored(classes.join(_ends(told.select("class", "conv_id")), "class"), "classes")
    discard(told)
    return out


def _tries(bucket: pd.DataFrame) -> pd.DataFrame:
    """The nodes of the tries of a bucket's parts. A part's top is the turn that it was partitioned by."""
    kids: list[dict[bytes, int]] = []
    depths, sizes, counts, least, ends, of = [], [], [], [], [], []
    tops: dict[bytes, int] = {}

    def node(depth: int, size: int, part: int) -> int:
        kids.append({})
        for values, x in ((depths, depth), (sizes, size), (counts, 0), (least, None), (ends, None), (of, part)):
            values.append(x)
        return len(kids) - 1

    parts = []
    for part, parent, level, cut, digests, lengths, n, first, end in bucket[["part", "parent", "level", "cut", "digests", "sizes", "n", "least", "ends"]].itertuples(index=False):
        at = tops.get(part)
        if at is None:
            at = tops[part] = node(cut, int(lengths[cut - 1]), len(parts))
            parts.append((part, parent, level, at))
        for depth in range(cut, len(digests) + 1):
            if depth > cut:
                turn = digests[depth - 1]
                after = kids[at].get(turn)
                if after is None:
                    after = kids[at][turn] = node(depth, int(lengths[depth - 1]), of[at])
                at = after
            counts[at] += n
            least[at] = first if least[at] is None or first < least[at] else least[at]
        ends[at] = end
    above, leaves, saved = [-1] * len(kids), [0] * len(kids), [0] * len(kids)
    for _, _, _, top in parts:
        order, waiting = [], [top]
        while waiting:
            at = waiting.pop()
            order.append(at)
            waiting.extend(kids[at].values())
        for at in reversed(order):  # children before their parents
            below = kids[at].values()
            leaves[at] = sum(leaves[x] for x in below) or 1
            saved[at] = (counts[at] - 1) * sizes[at] + sum(saved[x] for x in below)
            for x in below:
                above[x] = at
    return pd.DataFrame(
        {
            "conv_id": least,
            "depth": depths,
            "parent_conv_id": pd.array([None if x < 0 else least[x] for x in above], "Int64"),
            "n_convs": counts,
            "n_children": [len(x) for x in kids],
            "n_leaves": leaves,
            "saved_tokens": saved,
            "ends_sha256": [x or NONE for x in ends],
            "part": [parts[x][0] for x in of],
            "parent": [parts[x][1] for x in of],
            "level": [parts[x][2] for x in of],
            "top": [x < 0 for x in above],
        }
    )


_PART = "part", "parent", "level", "n_convs", "conv_id", "n_leaves", "saved_tokens"


def _stems(parts: DataFrame, oversized: int, level: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame] | None:
    """(stems, classes that end at them, other parts, the next round's parts); None if no part is oversized."""
    weights = parts.groupBy("part").agg(F.sum(F.size("digests") - F.col("cut") + 1).alias("turns"), F.count("*").alias("classes"))
    large = stored(weights.where((F.col("turns") > oversized) & (F.col("classes") > 1)).select("part"), "oversized")
    if large.isEmpty():
        discard(large)
        return None
    opened = parts.join(large, "part")
    spans = opened.groupBy("part", "parent", "cut").agg(F.min(F.struct("digests", "sizes")).alias("low"), F.max("digests").alias("high"))
    low, high = F.col("low.digests"), F.col("high")
    shorter = F.least(F.size(low), F.size(high))
    parting = F.array_position(F.transform(F.sequence(F.lit(1), shorter), lambda i: F.element_at(low, i) != F.element_at(high, i)), True)
    stems = stored(spans.withColumn("fork", F.when(parting > 0, parting - 1).otherwise(shorter).cast("int")).withColumn("sizes", F.slice(F.col("low.sizes"), F.col("cut"), F.col("fork") - F.col("cut") + 1)).drop("low", "high"), "stems")
    split = opened.join(stems.select("part", "fork"), "part")
    ending = stored(split.where(F.size("digests") == F.col("fork")).select("part", F.col("n").alias("end_n"), F.col("least").alias("end_least"), "ends"), "ending")
    further = F.slice(F.col("digests"), F.col("cut") + 1, F.col("fork") + 1 - F.col("cut"))
    after = split.where(F.size("digests") > F.col("fork")).select(
        _chained(F.col("part"), further).alias("part"), F.col("part").alias("parent"), F.lit(level + 1).alias("level"), (F.col("fork") + 1).alias("cut"), "digests", "sizes", "n", "least", "ends"
    )
    rest = stored(parts.join(large, "part", "left_anti"), "parts")
    after = stored(after, "parts")
    discard(large)
    return stems, ending, rest, after


def prefix_trie(found: DataFrame, oversized: int = OVERSIZED, bucket: int = BUCKET) -> DataFrame:
    """The nodes of the trie of sequences(conv_id, digests, sizes)."""
    spark = found.sparkSession
    classes = _classes(found)
    total = classes.agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.sum(F.size("digests")).alias("turns")).first()
    if total["n"] is None:
        return spark.createDataFrame([], NODE)
    first = F.slice("digests", 1, 1)
    parts = classes.where(F.size("digests") > 0).select(_chained(F.lit(b""), first).alias("part"), F.lit(None).cast("binary").alias("parent"), F.lit(0).alias("level"), F.lit(1).alias("cut"), "digests", "sizes", "n", "least", "ends")
    whole, opened = [], []
    while (got := _stems(parts, oversized, len(opened))) is not None:
        stems, ending, rest, after = got
        opened.append((stems, ending))
        whole.append(rest)
        if len(opened) > 1:
            discard(parts)
        parts = after
    whole.append(parts)
    together = whole[0]
    for x in whole[1:]:
        together = together.unionByName(x)
    # Buckets follow the number of turns; there are no fewer than the session's tasks after a shuffle.
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total["turns"] // bucket))
    nodes = together.groupBy(F.pmod(F.xxhash64("part"), F.lit(buckets)).alias("bucket")).applyInPandas(_tries, NODE + ", part binary, parent binary, level int, top boolean")
    nodes = stored(nodes, "tries")
    discard(*(x for x in whole if x is not parts or len(opened)))
    tops = nodes.where("top").select(*_PART)
    inner = []
    for level in reversed(range(len(opened))):
        stems, ending = opened[level]
        below = tops.where(F.col("level") == level + 1).groupBy(F.col("parent").alias("part")).agg(
            F.sum("n_convs").alias("n"), F.min("conv_id").alias("least"), F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("below")
        )
        joined = stems.join(below, "part").join(ending, "part", "left")
        n = F.col("n") + F.coalesce("end_n", F.lit(0))
        joined = stored(joined.withColumn("n", n).withColumn("least", F.least("least", "end_least")), "stem-sums")

        def saved(sizes: Column) -> Column:
            return F.col("below") + (F.col("n") - 1) * F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + x)

        tops = tops.unionByName(joined.select("part", "parent", F.lit(level).alias("level"), F.col("n").alias("n_convs"), F.col("least").alias("conv_id"), F.col("leaves").alias("n_leaves"), saved(F.col("sizes")).alias("saved_tokens")))
        depth, at_fork = F.col("depth"), F.col("depth") == F.col("fork")
        inner.append(
            joined.withColumn("depth", F.explode(F.sequence("cut", "fork"))).select(
                F.col("least").alias("conv_id"),
                depth.cast("long").alias("depth"),
                F.when(depth > F.col("cut"), F.col("least")).alias("parent_conv_id"),
                F.col("n").alias("n_convs"),
                F.when(at_fork, F.col("children")).otherwise(1).alias("n_children"),
                F.col("leaves").alias("n_leaves"),
                saved(F.slice(F.col("sizes"), depth - F.col("cut") + 1, F.col("fork") - depth + 1)).alias("saved_tokens"),
                F.coalesce(F.when(at_fork, F.col("ends")), F.lit(NONE)).alias("ends_sha256"),
                "part",
                "parent",
                (depth == F.col("cut")).alias("top"),
            )
        )
    columns = NODE.replace(" long", "").replace(" string", "").split(", ")
    every = nodes.drop("level")
    for x in inner:
        every = every.unionByName(x)
    top = every.where("top")
    # A part's top gets its parent's smallest member: the root's, or its stem's.
    fork = tops.select(F.col("part").alias("parent"), F.col("conv_id").alias("above")) if opened else None
    of_root = top.where("parent is null").withColumn("parent_conv_id", F.lit(total["least"]))
    roots = tops.where("level = 0").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")).first()
    alone = classes.where(F.size("digests") == 0).select("ends").first()
    root = spark.createDataFrame([(total["least"], 0, None, total["n"], roots["n_children"], roots["leaves"] or 1, roots["saved"] or 0, alone["ends"] if alone else NONE)], NODE)
    out = root.unionByName(every.where("not top").select(columns)).unionByName(of_root.select(columns))
    if fork is not None:
        out = out.unionByName(top.where("parent is not null").join(fork, "parent").withColumn("parent_conv_id", F.col("above")).select(columns))
    return out
