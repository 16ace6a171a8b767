"""N-gram Jaccard join by T-occurrence search (DivideSkip), with exact links.

Two documents link when ``100 * |A & B| >= percent * |A | B|`` for their sets
of word shingles. The result has a row for every document: the size of its
set, the class it belongs to (smallest id that it reaches through links), and
the number of documents it links with.

How the work is split
---------------------
1.  One pass makes a 128-bit digest of every set. Documents with equal sets
    form a class of copies, which has a number; one of its rows stands for it from here on, so a
    group of copies of any size costs one document.
2.  Inverted lists. A partner shares at least ``T = ceil(percent * n / 100)`` of
    the n shingles of a document, so it is on one at least of the
    ``n - T + 1`` shortest of the document's lists, and on ``extra + 1`` of the
    ``n - T + 1 + extra`` shortest. Shingles are ordered by their frequency
    (frequent ones last; ties by hash), and only this head of each document is posted. Frequent ones are those that come twice in a batch of the
    first pass. In a larger table ever more shingles are on long lists and yet in no batch twice, so the posted lists are counted, those that
    are long go to the end of the order, and heads are made anew (``RECOUNTS`` times, or until no list is long).
3.  Short posted lists (up to ``short_list`` documents) are merged: pairs on
    them count their common lists, and those under ``extra + 1``, or under the T of the larger set
    where that is less, go. A document on a longer list would have too many
    pairs there: it posts signatures instead (see ``signatures``), each a hash of a fixed part of
    its set. Sets that link differ in few shingles, so some part has none of the differences, whereas those that merely have a
    frequent shingle in common share no whole part. Documents of a signature that more than ``few``
    have are joined with the first of them; the others are pairs like those of the short lists.
    Each pair is then held against the documents' sketches (see ``sketch``), which rule out those whose sets differ in too much.
    Without that, pairs that merely share a passage chain ever more of a growing table into one block.
4.  The components of these candidates are blocks: all links lie within blocks. Each
    document goes to its block once with its full set. A block of over
    ``chunk`` documents is split by hash, and each pair of its chunks is a task
    of its own: no task holds more than two chunks, whatever the block.
5.  In a task, DivideSkip (Li, Lu, Lu 2008) answers each document against the
    task's inverted lists: the short ones are merged by a heap with the threshold
    ``T - L``; candidates that reach it are looked up in the L long ones by binary search. Links
    are exact. A task returns a count of links for each document and one edge
    that joins it to its class within the task, never the pairs.
6.  Components of those edges give the classes.

Nulls, empty texts and texts without words have no shingles and link with
nothing. Rows are told by their id and text: rows of one id may have different texts, each of which has its own links, and
a row with a null id links as any other, but is never the smallest of its class (whose component is null if all its ids are). Repeated rows
get the same result and count as copies. Other columns are left out, so that clashing names
cannot matter.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import components, discard, release, row_key, stored
from plumbline.llm.textkernel import mix, shingle_sets, space_separated

#: Frequent shingles that are told to all tasks, at most: 16 bytes each.
MOST_FREQUENT = 500_000
#: A shingle is noted as frequent when so many documents of one batch have it.
NOTED = 2
#: Times that posted lists are counted before they are joined.
RECOUNTS = 2
#: Weight of a look-up against a merge step in DivideSkip's choice of L. Look-ups take a whole array of candidates at
#: once, steps of the heap one posting each, some hundred times as long.
MU = 0.002
#: Bits of a sketch, at most: beyond twice as many shingles it rules little out.
MOST_BITS = 1 << 13


def least_size(percent: int) -> int:
    """Sets below this size link only with equal ones."""
    return -(-percent // (100 - percent)) if percent < 100 else 1 << 62


def _digests(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_bytes = space_separated()
        for batch in batches:
            size, one, two, kept = [], [], [], []
            for s in shingle_sets(batch.column(2), k, word_bytes):
                size.append(len(s))
                one.append(int(s.sum(dtype=np.uint64)) if len(s) else 0)
                two.append(int(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)) if len(s) else 0)
                kept.append(s)
            n = len(size)
            if not n:
                continue
            every = np.sort(np.concatenate(kept))
            edge = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.empty(0, dtype=int)
            count = np.diff(np.append(edge, len(every)))
            often = count >= NOTED
            m = int(often.sum())
            longs = lambda x: pa.array(np.asarray(x, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([batch.column(0), pa.nulls(m, pa.int64())]),
                    pa.concat_arrays([batch.column(1), pa.nulls(m, pa.binary())]),
                    pa.array(np.concatenate([np.array(size, dtype=np.int64), count[often].astype(np.int64)])),
                    longs(np.concatenate([np.array(one, dtype=np.uint64), every[edge[often]] if m else np.empty(0, dtype=np.uint64)])),
                    longs(np.concatenate([np.array(two, dtype=np.uint64), np.zeros(m, dtype=np.uint64)])),
                    pa.array(np.concatenate([np.zeros(n, dtype=bool), np.ones(m, dtype=bool)])),
                ],
                names=["id", "row", "n", "d1", "d2", "noted"],
            )

    return run


def most_frequent(tokens: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingles in their order and how frequent each is, by the largest of its counts; the ``MOST_FREQUENT`` ones."""
    order = np.lexsort((-counts, tokens))
    tokens, counts = tokens[order], counts[order]
    first = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1])[: len(tokens)])
    tokens, counts = tokens[first], counts[first]
    most = np.sort(np.argsort(-counts, kind="stable")[:MOST_FREQUENT])
    return tokens[most], counts[most]


def sketch(s: np.ndarray) -> bytes:
    """A bit for each remainder of shingles: whether an odd number of them has it. As many bits as the set has shingles or more, a power of two.

    A shingle that only one of two sets has flips one bit, one that both have none, so the sketches differ in no more
    bits than the sets differ in shingles. The halves of a sketch, one xor the other, are the sketch of half the size.
    """
    bits = min(MOST_BITS, max(64, 1 << (len(s) - 1).bit_length()))
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def apart(one: bytes, two: bytes) -> int:
    """Bits in which two sketches differ, the larger one halved to the size of the other."""
    x, y = int.from_bytes(one, "little"), int.from_bytes(two, "little")
    n, m = len(one), len(two)
    if n < m:
        x, y, n, m = y, x, m, n
    while n > m:
        n //= 2
        x = (x >> 8 * n) ^ (x & ((1 << 8 * n) - 1))
    return (x ^ y).bit_count()


def _near(percent: int):
    """Pairs whose sketches don't rule out that they link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(x).to_pylist() for x in ("n", "n2", "s", "s2")]
            good = [(100 + percent) * apart(s, s2) <= (100 - percent) * (n + n2) for n, n2, s, s2 in zip(*columns, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _heads(k: int, percent: int, extra: int, frequent):
    """The head of each document, its n - T + 1 + extra least frequent shingles, and its sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_bytes = space_separated()
        tokens, counts = frequent.value
        least = least_size(percent)
        for batch in batches:
            heads: list = []
            sizes: list = []
            sketches: list = []
            for s in shingle_sets(batch.column(1), k, word_bytes):
                n = len(s)
                sizes.append(n)
                if n < least:
                    heads.append(None)
                    sketches.append(None)
                    continue
                sketches.append(sketch(s))
                take = min(n, n + (-percent * n // 100) + 1 + extra)
                if len(tokens):
                    at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
                    often = np.where(tokens[at] == s, counts[at], 0)
                    s = s[np.lexsort((s, often))[:take]]
                else:
                    s = s[:take]
                heads.append(s.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(sizes, dtype=np.int64)), pa.array(heads, type=pa.list_(pa.int64())), pa.array(sketches, type=pa.binary())],
                names=["row", "n", "head", "s"],
            )

    return run


def bands(percent: int, largest: int) -> np.ndarray:
    """Least sizes of bands of sizes, from 1: sets that link are of one band or of neighbouring ones."""
    out = [1]
    while out[-1] <= largest:
        out.append(out[-1] * 100 // percent + 1)
    return np.array(out, dtype=np.int64)


def parts_of(percent: int, limits: np.ndarray, band: int) -> tuple[int, int]:
    """(parts, slack) for pairs whose smaller set is of a band.

    Two such sets that link differ in at most h shingles, so of h + 1 + slack parts at least 1 + slack are equal in both.
    """
    smaller = int(limits[band + 1]) - 1
    h = (smaller + smaller * 100 // percent) * (100 - percent) // (100 + percent)
    slack = 1 + -(-h // 20)
    return h + 1 + slack, slack


def signatures(s: np.ndarray, percent: int, limits: np.ndarray) -> np.ndarray:
    """Hashes of parts of a set, for pairs where it is the smaller one and where it is the larger one.

    The shingles are dealt to the parts by hash; a part's signature is a hash of all its shingles. Equal
    parts may both be empty, which says nothing: of a set with no more empty parts than there is slack, one equal part has shingles, and only such
    parts are posted; a set with more of them posts the empty ones too. So a pair that links has a signature in common.
    """
    band = int(np.searchsorted(limits, len(s), side="right")) - 1
    found = []
    for of in (band - 1, band):
        if of < 0:
            continue
        parts, slack = parts_of(percent, limits, of)
        part = (mix(s ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        part = part[order]
        edge = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        sums = np.add.reduceat(mix(s[order] + np.uint64(of)), edge)
        place = part[edge].astype(np.uint64)
        if parts - len(edge) > slack:
            empty = np.setdiff1d(np.arange(parts), part[edge]).astype(np.uint64)
            place, sums = np.concatenate([place, empty]), np.concatenate([sums, np.zeros(len(empty), dtype=np.uint64)])
        found.append(mix(sums ^ mix(place + np.uint64(of << 32) + np.uint64(1))))
    return np.concatenate(found)


def _signed(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_bytes, limits = space_separated(), bands(percent, 1)
        for batch in batches:
            found = []
            for s in shingle_sets(batch.column(1), k, word_bytes):
                if len(s) >= limits[-1]:
                    limits = bands(percent, 2 * len(s))
                found.append(signatures(s, percent, limits).view(np.int64) if len(s) else s.view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, type=pa.list_(pa.int64()))], names=["node", "signatures"])

    return run


def _with_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_bytes = space_separated()
        for batch in batches:
            sets = pa.array([s.tobytes() for s in shingle_sets(batch.column("text"), k, word_bytes)], type=pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(x) for x in ("block", "c", "chunks", "copies", "id")] + [sets], names=["block", "c", "chunks", "copies", "id", "s"])

    return run


class Index:
    """Inverted lists of some documents' shingles, documents in the order of their size."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(len(sets), dtype=np.int64), self.n)
        every = np.concatenate(sets) if sets else np.empty(0, dtype=np.uint64)
        order = np.argsort(every, kind="stable")
        every = every[order]
        self.docs = owner[order]
        edge = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.empty(0, dtype=int)
        self.tokens = every[edge]
        self.begin = np.append(edge, len(every))

    def search(self, s: np.ndarray, after: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents numbered over ``after`` (none is smaller than s) that share enough of s: numbers, sizes of the overlap."""
        none = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        n = len(s)
        most = n * 100 // percent
        last = int(np.searchsorted(self.n, most, side="right"))
        if not len(self.tokens) or last <= after + 1:
            return none
        need = -(-2 * percent * n // (100 + percent))
        at = np.minimum(np.searchsorted(self.tokens, s), len(self.tokens) - 1)
        at = at[self.tokens[at] == s]
        lists = []
        for b, e in zip(self.begin[at].tolist(), self.begin[at + 1].tolist(), strict=True):
            docs = self.docs[b:e]
            if docs[0] <= after or docs[-1] >= last:
                docs = docs[np.searchsorted(docs, after, side="right") : np.searchsorted(docs, last)]
            if len(docs):
                lists.append(docs)
        if len(lists) < need:
            return none
        lists.sort(key=len)
        longest = len(lists[-1])
        long = min(need - 1, int(need / (MU * np.log2(longest + 1) + 1)))
        short, long_lists = lists[: len(lists) - long], lists[len(lists) - long :]
        docs, counts = merged(short, need - long)
        for i, one in enumerate(long_lists):
            if not len(docs):
                break
            counts = counts + (one[np.minimum(np.searchsorted(one, docs), len(one) - 1)] == docs)
            if i % 16 == 15:
                still = counts + (len(long_lists) - i - 1) >= need
                docs, counts = docs[still], counts[still]
        good = 100 * counts >= percent * (n + self.n[docs] - counts)
        return docs[good], counts[good]


def merged(lists: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Those on ``least`` of the sorted lists or more, and on how many: a heap holds the head of each list."""
    docs, counts, last, n = [], [], -1, 0
    for d in heapq.merge(*[x.tolist() for x in lists]):
        if d == last:
            n += 1
            continue
        if n >= least and last >= 0:
            docs.append(last)
            counts.append(n)
        last, n = d, 1
    if n >= least and last >= 0:
        docs.append(last)
        counts.append(n)
    return np.array(docs, dtype=np.int64), np.array(counts, dtype=np.int64)


def _join_block(ids: np.ndarray, copies: np.ndarray, part: np.ndarray, sets: list[np.ndarray], percent: int, crossing: bool):
    """Links within the documents of a task: (id, smallest id of its class here, documents that it links with)."""
    m = len(ids)
    order = np.lexsort((ids, [len(s) for s in sets]))
    ids, copies, part, sets = ids[order], copies[order], part[order], [sets[i] for i in order]
    index = Index(sets)
    root = list(range(m))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    links = np.zeros(m, dtype=np.int64)
    for q in range(m):
        found, _ = index.search(sets[q], q, percent)
        if crossing:
            found = found[part[found] != part[q]]
        if not len(found):
            continue
        links[q] += copies[found].sum()
        links[found] += copies[q]
        for r in found.tolist():
            a, b = find(q), find(r)
            if a != b:
                root[a] = b
    tops = [find(x) for x in range(m)]
    low: dict[int, int] = {}
    for x, t in enumerate(tops):
        low[t] = min(low.get(t, ids[x]), ids[x])
    for x in range(m):
        if links[x]:
            yield int(ids[x]), int(low[tops[x]]), int(links[x])


def _blocks(percent: int):
    """Over rows sorted by task: joins each task's documents, one task in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out = None, {}, []

        def finish():
            if len(held) > 1:
                rows = list(held.items())
                yield from _join_block(
                    np.array([k for k, _ in rows]),
                    np.array([v[1] for _, v in rows]),
                    np.array([v[0] for _, v in rows]),
                    [np.frombuffer(v[2], dtype=np.uint64) for _, v in rows],
                    percent,
                    now[1] != now[2],
                )

        def packed():
            return pa.RecordBatch.from_arrays([pa.array(x, type=pa.int64()) for x in zip(*out, strict=True)], names=["id", "low", "links"])

        for batch in batches:
            columns = [batch.column(x).to_pylist() for x in ("block", "i", "j", "c", "copies", "id", "s")]
            for block, i, j, c, copies, key, s in zip(*columns, strict=True):
                if (block, i, j) != now:
                    out.extend(finish())
                    now, held = (block, i, j), {}
                    if len(out) > 10_000:
                        yield packed()
                        out = []
                held[key] = (c, copies, s)
        out.extend(finish())
        if out:
            yield packed()

    return run


def jaccard_join(
    docs: DataFrame,
    k: int = 5,
    percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
    extra: int = 2,
    short_list: int = 32,
    chunk: int = 512,
    few: int = 4,
) -> DataFrame:
    """(id, n_shingles, component_id, n_links) of every document; see the module."""
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), row_key(F.col(id_col).cast("long"), text).alias("row"), text.alias("text"))

    first = stored(texts.mapInArrow(_digests(k), "id long, row binary, n long, d1 long, d2 long, noted boolean"), "digests")
    sets = first.where("not noted").drop("noted")
    told = lambda of: (of["token"].to_numpy().view(np.uint64), of["n"].to_numpy())
    often = told(first.where("noted").groupBy(F.col("d1").alias("token")).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(MOST_FREQUENT).toArrow())

    # A class of equal sets: its smallest id, the row that stands for it, its number.
    same = sets.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("id").alias("low"), F.min("row").alias("row"), F.count("*").alias("copies"))
    same = stored(same.withColumn("node", F.monotonically_increasing_id()), "classes")
    reps = same.where(f"n >= {least_size(percent)}").select("row", "node", "copies")

    def headed() -> DataFrame:
        frequent = spark.sparkContext.broadcast(most_frequent(*often))
        made = texts.select("row", "text").mapInArrow(_heads(k, percent, extra, frequent), "row binary, n long, head array<long>, s binary")
        return made.where("head is not null").dropDuplicates(["row"]).join(reps.select("row", "node"), "row").select("node", "n", "head", "s")

    for _ in range(RECOUNTS):
        counts = headed().select(F.explode("head").alias("token")).groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") > short_list)
        long = told(counts.orderBy(F.desc("n"), "token").limit(MOST_FREQUENT).toArrow())
        release(spark)
        if not len(long[0]):
            break
        often = tuple(np.concatenate(x) for x in zip(often, long, strict=True))
    heads = stored(headed(), "heads")
    posted = heads.select("node", "n", F.explode("head").alias("token"))
    lists = posted.groupBy("token").agg(F.count("*").alias("docs")).where("docs > 1")
    kept = stored(posted.join(lists, "token"), "lists")
    sketches = stored(heads.select("node", "n", "s"), "sketches")
    discard(heads)
    release(spark)
    one = kept.where(F.col("docs") <= short_list).select("token", "node", "n")
    two = one.select("token", F.col("node").alias("node2"), F.col("n").alias("n2"))
    pairs = (
        one.join(two, "token")
        .where((F.col("node") < F.col("node2")) & (100 * F.least("n", "n2") >= percent * F.greatest("n", "n2")))
        .groupBy("node", "node2")
        .agg(F.count("*").alias("common"), F.max(F.greatest("n", "n2")).alias("larger"))
        .where(f"common >= least({extra} + 1, ({percent} * larger + 99) div 100)")
        .select(F.col("node").alias("a"), F.col("node2").alias("b"))
    )
    on_long = kept.where(F.col("docs") > short_list).select("node").distinct().join(reps, "node").select("row", "node")
    signed = texts.select("row", "text").join(on_long, "row").select("node", "text").mapInArrow(_signed(k, percent), "node long, signatures array<long>")
    signed = stored(signed.select("node", F.explode("signatures").alias("signature")).distinct(), "signatures")
    shared = signed.groupBy("signature").agg(F.min("node").alias("b"), F.count("*").alias("m")).where("m > 1")
    stars = signed.join(shared.where(F.col("m") > few).drop("m"), "signature").where("node <> b").select(F.col("node").alias("a"), "b")
    a_few = signed.join(shared.where(F.col("m") <= few).select("signature"), "signature")
    met = a_few.join(a_few.select("signature", F.col("node").alias("b")), "signature").where("node < b").select(F.col("node").alias("a"), "b").distinct()
    near = (
        pairs.unionByName(met)
        .join(sketches.select(F.col("node").alias("a"), "n", "s"), "a")
        .join(sketches.select(F.col("node").alias("b"), F.col("n").alias("n2"), F.col("s").alias("s2")), "b")
        .mapInArrow(_near(percent), "a long, b long")
    )
    blocks = stored(components(stars.unionByName(near)), "blocks")
    discard(kept, signed, sketches)
    release(spark)

    sizes = blocks.groupBy("root").agg(F.ceil(F.count("*") / chunk).cast("long").alias("chunks"))
    members = (
        blocks.join(sizes, "root")
        .join(reps, "node")
        .select("row", F.col("root").alias("block"), F.pmod(F.xxhash64("node"), F.col("chunks")).alias("c"), "chunks", "copies", F.col("node").alias("id"))
    )
    spread = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))
    dealt = (
        texts.select("row", "text").join(members, "row")
        .select("block", "c", "chunks", "copies", "id", "text")
        .mapInArrow(_with_sets(k), "block long, c long, chunks long, copies long, id long, s binary")
        .select("*", spread.alias("other"))
        .select("block", F.least("c", "other").alias("i"), F.greatest("c", "other").alias("j"), "c", "copies", "id", "s")
    )
    linked = stored(
        dealt.repartition("block", "i", "j").sortWithinPartitions("block", "i", "j").mapInArrow(_blocks(percent), "id long, low long, links long"),
        "linked",
    )
    release(spark)
    degrees = linked.groupBy(F.col("id").alias("node")).agg(F.sum("links").alias("links"))
    roots = components(linked.select(F.col("id").alias("a"), F.col("low").alias("b")))
    lows = roots.join(same.select("node", "low"), "node").groupBy("root").agg(F.min("low").alias("least"))
    joined = (
        same.join(degrees, "node", "left").join(roots, "node", "left").join(lows, "root", "left")
        .select("n", "d1", "d2", F.coalesce("least", "low").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    )
    return sets.join(joined, ["n", "d1", "d2"], "left").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.coalesce("component", "id").alias("component_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
    )
