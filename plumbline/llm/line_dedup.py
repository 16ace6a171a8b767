"""Line dedup by winnowing: delete runs of lines that came before, here or in an earlier document.

A unit is a line with at least one word. From every unit a window reaches over as
few units as have ``min_words`` words. Winnowing (Schleimer, Wilkerson, Aiken 2003): a window's smallest line hash (the last of equal ones) is a
fingerprint, posted once with its position however many windows it is the minimum of. Two runs that are equal over ``min_words``
words have a window in common, and so a fingerprint at the same place of both.

1.  Fingerprints are counted. One of at most ``few`` positions is joined with its earlier positions, and each match is extended both ways, line
    by line, over up to ``min_words`` units: further on, the run has its next fingerprint. The stretch goes if it has ``min_words`` words.
2.  A fingerprint of more positions (a stock line, or a passage of many copies) would be all pairs. There the hash of the whole window is
    joined in its place, with its first position only, the smallest (id, line): places of one such key lie in windows that are equal throughout, so it
    doesn't matter which, and a passage that a third of all documents have gives one row for each of them. So that these windows
    cover a run to its end, those that reach back from a unit over as few units as have ``min_words`` words are posted too.

Spans that touch are merged, so each run of ``min_words`` words or more that equals one that begins earlier goes, wherever
its first copy is. What is deleted equals earlier lines, and the first of them stay, so
nothing disappears altogether.

Only built-in column functions are used. A null text stays null, and a text
without such runs stays as it is. If all lines go, the text is empty. Rows of one id and
text are one document: repeated rows get the same result. A null id comes before all others.
The result has the id, the text that is left and counts; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.tokens import let
from plumbline.llm.common import discard, stored

#: Positions of a fingerprint up to which each is held against all earlier ones.
FEW = 4
_WORD = "[^\\x20\\x09-\\x0D]++"


def n_words(line: Column) -> Column:
    """Runs of other characters than white space."""
    return F.regexp_count(line, F.lit(_WORD))


def repeated_runs(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text", few: int = FEW) -> DataFrame:
    """(id, hash of the text, lines): the numbers, from 0, of the lines to delete, for documents that have any."""
    text = F.col(text_col).cast("string")
    lines = F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(i.alias("at"), F.xxhash64(x).alias("h"), n_words(x).alias("w")))
    units = stored(
        docs.where(text.isNotNull())
        .select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("d"), F.xxhash64(text).alias("t"), F.filter(lines, lambda u: u["w"] > 0).alias("units"))
        .where(F.size("units") > 0)
        .dropDuplicates(["d", "t"]),
        "units",
    )
    rows = units.select("d", "t", F.posexplode("units").alias("i", "u")).select("d", "t", "i", "u.h", "u.w")
    of_doc = Window.partitionBy("d", "t")
    placed = rows.withColumn("end", F.sum("w").over(of_doc.orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    placed = placed.withColumn("begin", F.col("end") - F.col("w")).withColumn("ahead", F.sum("w").over(of_doc) - F.col("begin"))
    ahead, back = of_doc.orderBy("begin").rangeBetween(0, min_words - 1), of_doc.orderBy("end").rangeBetween(1 - min_words, 0)
    placed = placed.withColumn("least", F.min(F.struct("h", (-F.col("i")).alias("i"))).over(ahead)).withColumn("on", F.count("*").over(ahead))
    placed = placed.withColumns({"off": F.count("*").over(back), "behind": F.sum("w").over(back), "before": F.first("least").over(back)})
    forward = F.when(F.col("ahead") >= min_words, F.struct(F.col("i").alias("q"), F.col("on").alias("n"), F.col("least.h").alias("h"), (-F.col("least.i")).alias("i")))
    # A window back that is no longer without its last unit is also a window ahead. It goes with the fingerprint of the one ahead from its begin.
    backward = F.when(F.col("behind") - F.col("w") >= min_words, F.struct((F.col("i") - F.col("off") + 1).alias("q"), F.col("off").alias("n"), F.col("before.h").alias("h"), F.lit(-1).alias("i")))
    windows = stored(placed.select("d", "t", F.explode(F.array_compact(F.array(forward, backward))).alias("p")).select("d", "t", "p.*"), "windows")

    prints = windows.where("i >= 0").select("d", "t", "h", "i").distinct()
    counts = stored(prints.groupBy("h").agg(F.count("*").alias("places")).where("places > 1"), "fingerprints")
    near = _extended(prints.join(counts.where(F.col("places") <= few), "h"), units, min_words)
    stock = windows.join(counts.where(F.col("places") > few), "h", "left_semi").select("d", "t", "q", "n")
    spans = stored(near.unionByName(_equal_windows(stock, units)), "spans")
    discard(windows, counts)
    spans = spans.groupBy("d", "t").agg(F.array_sort(F.collect_set(F.struct("b", "e"))).alias("spans"))
    at = F.flatten(F.transform(merged_spans("spans"), lambda r: F.transform(F.slice("units", r["b"] + 1, r["e"] - r["b"] + 1), lambda u: u["at"])))
    return spans.join(units, ["d", "t"]).select("d", "t", at.alias("lines"))


def _extended(prints: DataFrame, units: DataFrame, min_words: int) -> DataFrame:
    """Stretches (d, t, b, e) of min_words words about fingerprints that equal one about an earlier position of the same fingerprint."""
    i = F.col("i")
    before = F.reverse(F.slice("units", F.greatest(i - min_words, F.lit(0)) + 1, F.least(i, F.lit(min_words))))
    told = prints.join(units, ["d", "t"]).select("h", "d", "t", "i", before.alias("before"), F.slice("units", i + 1, min_words + 1).alias("after"))
    hashes = lambda c: F.transform(c, lambda u: u["h"])
    first = told.select("h", F.struct("d", "t", "i").alias("place0"), hashes("before").alias("before0"), hashes("after").alias("after0"))

    def common(one: str, two: str) -> Column:
        same = F.zip_with(hashes(one), F.col(two), lambda x, y: F.coalesce(x == y, F.lit(False)))
        end = F.array_position(same, False)
        return F.when(end > 0, end - 1).otherwise(F.size(same)).cast("int")

    words = lambda c, n: F.aggregate(F.slice(c, F.lit(1), F.col(n)), F.lit(0), lambda a, u: a + u["w"])
    pairs = told.join(first, "h").where(F.struct("d", "t", "i") > F.col("place0"))
    met = pairs.withColumns({"back": common("before", "before0"), "on": common("after", "after0")})
    long = met.where(words("before", "back") + words("after", "on") >= min_words)
    return long.select("d", "t", (i - F.col("back")).cast("int").alias("b"), (i + F.col("on") - 1).cast("int").alias("e"))


def _equal_windows(windows: DataFrame, units: DataFrame) -> DataFrame:
    """Windows (d, t, b, e) that equal an earlier one; windows: (d, t, q first unit, n units)."""
    inside = F.transform(F.slice("units", F.col("q") + 1, F.col("n").cast("int")), lambda u: u["h"])
    keyed = windows.join(units, ["d", "t"]).select("d", "t", "q", "n", F.xxhash64(inside).alias("h"), F.xxhash64(F.lit(1), F.reverse(inside)).alias("h2"))
    keyed = stored(keyed, "stock")
    first = keyed.groupBy("h", "h2").agg(F.min(F.struct("d", "t", "q")).alias("f"), F.count("*").alias("places")).where("places > 1").select("h", "h2", F.col("f.d").alias("d0"), F.col("f.t").alias("t0"), F.col("f.q").alias("q0"))
    # Written, so that the join reads both sides as they are dealt, and a passage of very many copies can be split.
    first = stored(first, "firsts")
    later = keyed.join(first, ["h", "h2"]).where("not (d = d0 and t = t0 and q = q0)")
    return later.select("d", "t", F.col("q").cast("int").alias("b"), (F.col("q") + F.col("n") - 1).cast("int").alias("e"))


_SPANS = "cast(array() as array<struct<b:int,e:int>>)"


def merged_spans(spans: str) -> Column:
    """Sorted spans (b, e; both included) with those that touch or overlap made one."""
    state = lambda b, e, out: F.struct(b.cast("int").alias("b"), e.cast("int").alias("e"), out.alias("out"))
    closed = lambda acc: F.when(acc["b"] >= 0, F.array_append(acc["out"], F.struct(acc["b"].alias("b"), acc["e"].alias("e")))).otherwise(acc["out"])
    return F.aggregate(
        spans,
        state(F.lit(-2), F.lit(-2), F.expr(_SPANS)),
        lambda acc, x: F.when(x["b"] <= acc["e"] + 1, state(acc["b"], F.greatest(acc["e"], x["e"]), acc["out"])).otherwise(state(x["b"], x["e"], closed(acc))),
        closed,
    )


def dedup_lines(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = (), few: int = FEW) -> DataFrame:
    """(id, text, n_lines, n_deleted, deleted) of every row: the text without its repeated runs. Columns named in carry follow, as they are."""
    gone = stored(repeated_runs(docs, min_words, id_col, text_col, few), "deleted").withColumnRenamed("lines", "deleted")
    text = F.col(text_col).cast("string")
    carried = F.struct(F.lit(0).alias("_"), *carry)
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), carried.alias("carried"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("d"), F.xxhash64(text).alias("t"))
    lines = F.split("text", "\n", -1)
    kept = lambda all_lines: F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col("deleted"))
    left = let(lines, lambda x: F.array_join(F.transform(kept(x), lambda i: F.get(x, i)), "\n"))
    # The plan is the same at any size: texts are dealt by id once, whatever the other side weighs.
    return rows.join(gone.hint("merge"), ["d", "t"], "left").select(
        F.col("id").alias(id_col),
        F.when(F.col("deleted").isNull(), F.col("text")).otherwise(left).alias(text_col),
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("deleted"), F.lit(0)).cast("long").alias("n_deleted"),
        F.coalesce(F.array_sort("deleted"), F.expr("cast(array() as array<int>)")).alias("deleted"),
        *[F.col(f"carried.{c}").alias(c) for c in carry],
    )
