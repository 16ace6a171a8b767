"""What several corpus operators share: durable intermediate tables, components, exact cuts and ranks.

Nothing here collects rows: what reaches the driver is histograms and
counts whose size doesn't depend on the number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.sources.store import discard, release, shared_folder, stored, work_path

__all__ = ["by_node", "components", "discard", "exact_cuts", "release", "row_key", "salted_rank", "shared_folder", "stored", "work_path"]


def row_key(*told: Column) -> Column:
    """128 bits that tell rows by their values: two hashes, of which the second begins with other values."""
    return F.unhex(F.concat(*(F.lpad(F.hex(F.xxhash64(F.lit(seed), *told)), 16, "0") for seed in (1, 2))))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of edges(a, b): root is the smallest node that it reaches.

    Alternates large-star and small-star rounds (Kiveris et al. 2014): O(log n)
    rounds, each linear in the edges. A hub costs no task of its own: minima are
    combined before the shuffle and its join splits as any skewed join does.
    """
    spark = edges.sparkSession
    edges = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    state = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.*")
        )
        before, edges = edges, stored(small.where("u <> v").distinct(), "edges")
        discard(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == now:
            break
        state = now
    else:
        raise RuntimeError(f"components: not settled after {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def by_node(values: dict[int, int]) -> Column:
    """values[node], looked up in an array: as fast for thousands of nodes as for one. Null for others."""
    return F.get(F.lit([values.get(n, -1) for n in range(max(values, default=0) + 1)]).cast("array<bigint>"), F.col("node"))


def exact_cuts(
    rows: DataFrame, targets: dict[int, float], bits: int = 62, step: int = 10, close: float = 0.0
) -> dict[int, int]:
    """For rows(node, key, weight) and a weight for each node, the key below which the node's rows weigh nearest to it.

    Keys are longs in [0, 2**bits). A histogram of the next ``step`` bits for
    each node comes to the driver (2**step counts a node, however many rows),
    and the bucket that holds the target is opened next, until one key is left
    or the bucket weighs less than ``close``.
    """
    at = {n: [0, 0.0] for n in targets}  # node: bits so far, weight below them
    cuts: dict[int, int] = {}
    shift = bits
    while at:
        width = min(step, shift)
        shift -= width
        opened = by_node({n: prefix for n, (prefix, _) in at.items()})
        here = rows.where(F.col("node").isin(list(at)))
        if shift + width < bits:
            here = here.where(F.shiftright("key", shift + width) == opened)
        found: dict[int, list] = {n: [] for n in at}
        bucket = F.shiftright("key", shift).bitwiseAND((1 << width) - 1)
        for r in here.groupBy("node", bucket.alias("b")).agg(F.sum("weight").alias("w"), F.count("*").alias("n")).collect():
            found[r["node"]].append((r["b"], r["w"], r["n"]))
        for n in list(at):
            prefix, below = at[n]
            got = sorted(found[n])
            if not got:
                cuts[n] = prefix << (shift + width)
                del at[n]
                continue
            for b, w, count in got:
                if below + w >= targets[n] or b == got[-1][0]:
                    here_prefix = (prefix << width) | b
                    if count == 1 or shift == 0 or w <= close:
                        over = below + w - targets[n] < targets[n] - below
                        cuts[n] = (here_prefix + over) << shift
                        del at[n]
                    else:
                        at[n] = [here_prefix, below]
                    break
                below += w
    return cuts


def salted_rank(df: DataFrame, groups: Sequence[str], salt: Column, order: Sequence[str], name: str) -> DataFrame:
    """df with ``name``: gapless numbers from 0 within each group, by salt, then order.

    A group of any size is numbered in as many tasks as it has salts: each part
    numbers its own rows and begins where the parts before it end.
    """
    df = df.withColumn("_salt", salt)
    sizes = df.groupBy(*groups, "_salt").agg(F.count("*").alias("_n"))
    begin = F.sum("_n").over(Window.partitionBy(*groups).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))
    begins = sizes.select(*groups, "_salt", F.coalesce(begin, F.lit(0)).alias("_begin"))
    within = F.row_number().over(Window.partitionBy(*groups, "_salt").orderBy(*order))
    numbered = df.withColumn("_row", within)
    return numbered.join(begins, [*groups, "_salt"]).withColumn(name, F.col("_begin") + F.col("_row") - 1).drop("_salt", "_row", "_begin")
