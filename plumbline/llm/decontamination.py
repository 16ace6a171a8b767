"""Benchmark decontamination by winnowing.

A window is ``window`` consecutive words of a benchmark item; an item of fewer
words is one window. A document's word is hit if it lies inside any occurrence
of any window.

Winnowing (Schleimer, Wilkerson, Aiken 2003): of the hashes of all ``gram``-word
grams of a text, the smallest in each run of ``window - gram + 1`` is kept, the
last one of equals. Two texts that share ``window`` words share such a run, and so
keep the same gram of it: every shared window leaves a shared fingerprint.
Fingerprints of documents and items are joined; each match is extended word by
word to the whole shared stretch, and stretches of at least a window count.
Items with fewer words than a window are matched whole, against the documents'
grams of their length.

A benchmark of up to ``BLOCK_BYTES`` of text (its size is taken first) is broadcast with its fingerprints, and the documents aren't
shuffled at all. A larger one is joined: fingerprints of documents and items (and, for the lengths of
short items, the documents' grams) meet by hash, each pair of a document and an item that meet is extended
in a row of its own, and the stretches come together by document. Both ways give the same rows.

Null or empty texts have no words, no hits, no items. Items with a null id or
without words match nothing; texts of an id that occurs again are all windows of that
item. Every row of the documents gives a row, repeated ones too.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import row_key, stored
from plumbline.llm.line_dedup import merged_spans
from plumbline.llm.textkernel import Words, alphanumeric, runs

#: Text of a benchmark that is broadcast.
BLOCK_BYTES = 16 << 20


def winnowed(grams: np.ndarray, first: np.ndarray, gram: int, window: int) -> np.ndarray:
    """Positions kept of a run of texts; first: the first word of each text, and the end."""
    span = window - gram + 1
    n = len(grams)
    if n < window:
        return np.empty(0, dtype=np.int64)
    starts = n - window + 1
    # the last of equals: compared from the end of the run to its begin
    best = grams[span - 1 : span - 1 + starts].copy()
    at = np.arange(span - 1, span - 1 + starts)
    for j in range(span - 2, -1, -1):
        less = grams[j : j + starts] < best
        best[less] = grams[j : j + starts][less]
        at[less] = np.flatnonzero(less) + j
    inside = np.zeros(n, dtype=bool)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= window:
            inside[a : b - window + 1] = True
    return np.unique(at[inside[:starts]])


class Items:
    """Fingerprints of a block of items."""

    def __init__(self, rows: list[tuple[str, str]], window: int, gram: int):
        self.window, self.gram = window, gram
        self.names = [r[0] for r in rows]
        texts = pa.array([r[1] for r in rows], pa.large_string())
        self.words: list[np.ndarray] = []
        prints, whole = [], {}
        for _, data, offsets in runs(texts):
            words = Words(data, offsets, alphanumeric())
            kept = winnowed(words.grams(gram), words.first, gram, window)
            grams = words.grams(gram)
            text = np.searchsorted(words.first, kept, side="right") - 1
            base = len(self.words)
            prints += [(int(grams[p]), base + int(t), int(p - words.first[t])) for p, t in zip(kept, text, strict=True)]
            for j in range(len(offsets) - 1):
                a, b = int(words.first[j]), int(words.first[j + 1])
                self.words.append(words.hash[a:b].copy())
                if 0 < b - a < window:
                    whole.setdefault(b - a, []).append((int(words.whole(j)[0]), base + j))
        prints.sort()
        self.prints = np.array([p[0] for p in prints], dtype=np.uint64)
        self.item = np.array([p[1] for p in prints], dtype=np.int64)
        self.at = np.array([p[2] for p in prints], dtype=np.int64)
        #: length: sorted hashes of whole short items, and which
        self.whole = {n: (np.array(sorted(h for h, _ in x), dtype=np.uint64), [i for _, i in sorted(x)]) for n, x in whole.items()}

    def hits(self, words: Words) -> Iterator[tuple[int, int, int, int]]:
        """(text, begin, end, item): stretches of words of texts that are shared with items."""
        if len(self.prints):
            grams = words.grams(self.gram)
            kept = winnowed(grams, words.first, self.gram, self.window)
            have = grams[kept]
            low = np.searchsorted(self.prints, have)
            high = np.searchsorted(self.prints, have, side="right")
            found = np.flatnonzero(high > low)
            seen: dict[tuple[int, int, int], int] = {}
            for f in found.tolist():
                p = int(kept[f])
                text = int(np.searchsorted(words.first, p, side="right")) - 1
                a, b = int(words.first[text]), int(words.first[text + 1])
                for i in range(int(low[f]), int(high[f])):
                    item, q = int(self.item[i]), int(self.at[i])
                    key = (text, item, p - q)
                    if seen.get(key, -1) > p:  # within the stretch that the fingerprint before has led to
                        continue
                    theirs = self.words[item]
                    back = min(p - a, q)
                    ahead = min(b - p, len(theirs) - q)
                    same = words.hash[p - back : p + ahead] == theirs[q - back : q + ahead]
                    wrong = np.flatnonzero(~same)
                    before = int(np.searchsorted(wrong, back))
                    begin = int(wrong[before - 1]) + 1 if before else 0
                    end = int(wrong[before]) if before < len(wrong) else len(same)
                    seen[key] = p - back + end
                    if end - begin >= self.window:
                        yield text, p - back + begin - a, p - back + end - a, item
        for n, (hashes, items) in self.whole.items():
            grams = words.grams(n)
            low = np.searchsorted(hashes, grams)
            for p in np.flatnonzero(hashes[np.minimum(low, len(hashes) - 1)] == grams).tolist():
                text = int(np.searchsorted(words.first, p, side="right")) - 1
                a, b = int(words.first[text]), int(words.first[text + 1])
                i = int(low[p])
                while p + n <= b and i < len(hashes) and hashes[i] == grams[p]:
                    yield text, p - a, p - a + n, items[i]
                    i += 1


_SPAN = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))


def _merged_pairs(found: list[tuple[int, int]]) -> list[dict[str, int]]:
    merged: list[dict[str, int]] = []
    for begin, end in sorted(found):
        if merged and begin <= merged[-1]["end"]:
            merged[-1]["end"] = max(merged[-1]["end"], end)
        else:
            merged.append({"begin": begin, "end": end})
    return merged


def _matched(told):
    """(key, n_words, spans, items) of each text; spans: merged stretches of hit words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_bytes = alphanumeric()
        block: Items = told.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1_000):
                part = batch.slice(at, 1_000)
                found: dict[int, list] = {}
                n_words = []
                for base, data, offsets in runs(part.column(1)):
                    words = Words(data, offsets, word_bytes)
                    n_words.append(np.diff(words.first))
                    for text, begin, end, item in block.hits(words):
                        found.setdefault(base + text, []).append((begin, end, block.names[item]))
                spans = [_merged_pairs([x[:2] for x in found.get(j, ())]) for j in range(part.num_rows)]
                names = [sorted({x[2] for x in found.get(j, ())}) for j in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.concatenate(n_words).astype(np.int64)), pa.array(spans, _SPAN), pa.array(names, pa.list_(pa.string())), *part.columns[2:]],
                    names=["id", "n_words", "spans", "items", *part.schema.names[2:]],
                )

    return run


def _prints(window: int, gram: int, lengths: list[int], items: bool):
    """(key, n_words, prints): distinct fingerprints of each text, and grams of the lengths of short items (for items: of short ones the whole)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_bytes = alphanumeric()
        for batch in batches:
            n_words, prints = [], []
            for _, data, offsets in runs(batch.column(1)):
                words = Words(data, offsets, word_bytes)
                grams = words.grams(gram)
                kept = winnowed(grams, words.first, gram, window)
                edge = np.searchsorted(kept, words.first)
                n_words.append(np.diff(words.first))
                short = {n: words.grams(n) for n in lengths}
                for j in range(len(offsets) - 1):
                    a, b = int(words.first[j]), int(words.first[j + 1])
                    found = [grams[kept[edge[j] : edge[j + 1]]]]
                    if not items:
                        found += [short[n][a : max(a, b - n + 1)] for n in lengths]
                    elif 0 < b - a < window:
                        found.append(words.whole(j))
                    prints.append(np.unique(np.concatenate(found)).view(np.int64))
            counts = np.concatenate(n_words).astype(np.int64) if n_words else np.empty(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), pa.array(prints, pa.list_(pa.int64())), *batch.columns[2:]], names=["key", "n_words", "prints", *batch.schema.names[2:]])

    return run


def _extended(window: int, gram: int):
    """(key, item, spans) of pairs of a text and an item that share a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_bytes = alphanumeric()
        for batch in batches:
            out = []
            for j, (key, name, text) in enumerate(zip(batch.column("row").to_pylist(), batch.column("item").to_pylist(), batch.column("item_text").to_pylist(), strict=True)):
                for _, data, offsets in runs(batch.column("text").slice(j, 1)):
                    found = [(begin, end) for _, begin, end, _ in Items([(name, text)], window, gram).hits(Words(data, offsets, word_bytes))]
                    if found:
                        out.append((key, name, _merged_pairs(found)))
            columns = list(zip(*out, strict=True)) if out else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.string()), pa.array(columns[2], _SPAN)], names=["row", "item", "spans"])

    return run


def _by_join(texts: DataFrame, asked: DataFrame, window: int, gram: int) -> DataFrame:
    """What _matched gives, for a benchmark of any size. Rows of one id and text are told alike."""
    asked = stored(asked.groupBy("item", "text").agg(row_key(F.col("item"), F.col("text")).alias("key")), "items")
    prints = stored(asked.select("key", "text").mapInArrow(_prints(window, gram, [], True), "key binary, n_words long, prints array<long>"), "item-prints")
    lengths = sorted(r["n_words"] for r in prints.where(f"n_words between 1 and {window - 1}").select("n_words").distinct().collect())  # window - 1 at most
    texts = texts.withColumn("row", row_key(F.col("id"), F.col("text")))
    extra = [c for c in texts.columns if c not in ("id", "text", "row")]
    kinds = ", ".join(["key binary, n_words long, prints array<long>, id long", *[f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema if f.name in extra]])
    read = stored(texts.select("row", "text", "id", *extra).mapInArrow(_prints(window, gram, lengths, False), kinds).withColumnRenamed("key", "row"), "prints")
    theirs = prints.select(F.col("key").alias("item_key"), F.explode("prints").alias("print"))
    pairs = read.select("row", F.explode("prints").alias("print")).join(theirs, "print").select("row", "item_key").distinct()
    named = asked.select(F.col("key").alias("item_key"), "item", F.col("text").alias("item_text"))
    found = texts.select("row", "text").join(pairs, "row").join(named, "item_key").select("row", "text", "item", "item_text").mapInArrow(_extended(window, gram), "row binary, item string, spans array<struct<begin:int,end:int>>")
    inclusive = F.transform("spans", lambda x: F.struct(x["begin"].alias("b"), (x["end"] - 1).alias("e")))
    found = found.groupBy("row").agg(F.array_sort(F.flatten(F.collect_list(inclusive))).alias("spans"), F.array_sort(F.collect_set("item")).alias("items"))
    found = found.select("row", F.transform(merged_spans("spans"), lambda x: F.struct(x["b"].alias("begin"), (x["e"] + 1).alias("end"))).alias("spans"), "items")
    none = lambda kind: F.expr(f"cast(array() as {kind})")
    spans, items = F.coalesce("spans", none("array<struct<begin:int,end:int>>")), F.coalesce("items", none("array<string>"))
    return read.drop("prints").join(found, "row", "left").select("id", "n_words", spans.alias("spans"), items.alias("items"), *extra)


def matched(
    docs: DataFrame, benchmark: DataFrame, window: int = 8, gram: int = 5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", carry: Sequence[str] = ()
) -> DataFrame:
    """(id, n_words, spans, items) of every document. Columns named in carry follow as carried_<name>."""
    spark = docs.sparkSession
    asked = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("string").alias("text")).dropna()
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *[F.col(c).alias(f"carried_{c}") for c in carry])
    total = asked.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    if total > BLOCK_BYTES:
        return _by_join(texts, asked, window, gram)
    told = spark.sparkContext.broadcast(Items([tuple(r) for r in asked.collect()], window, gram))  # BLOCK_BYTES at most
    return texts.mapInArrow(_matched(told), ", ".join(["id long, n_words long, spans array<struct<begin:int,end:int>>, items array<string>", *[f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema[2:]]]))


def decontaminate(docs: DataFrame, benchmark: DataFrame, least_items: int = 2, id_col: str = "doc_id", carry: Sequence[str] = (), **options) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated, spans, items) of every document. Columns named in carry follow, as they are."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + (x["end"] - x["begin"]).cast("long"))
    return matched(docs, benchmark, id_col=id_col, carry=carry, **options).select(
        F.col("id").alias(id_col),
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("items") >= least_items).alias("contaminated"),
        "spans",
        "items",
        *[F.col(f"carried_{c}").alias(c) for c in carry],
    )
