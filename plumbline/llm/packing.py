"""Best-two-fit packing of tokenized documents into sequences of a fixed length.

Best two fit (Friesen and Langston 1991): a bin is filled greedily, largest
document first; then its smallest document gives way to two unpacked documents
if they fill the widened gap more tightly.

Only lengths matter to this, so it runs on the histogram of lengths:
``capacity`` counts, however many documents. A bin's make-up is found once and
used as often as the counts allow (the next greedy bin would be the same one),
so the driver's work depends on the capacity and not on the number of rows. It
leaves a list of runs: "of the pieces of length l, ranks r0 to r1 go to
sequences s, s + 1, ... at this offset". Ranks within a length come from a salted
rank, so a length that a third of all rows have is numbered in many tasks.

Documents of more than ``capacity`` tokens are cut into pieces of it; nothing
else is cut. A null or empty text has the end token alone. Repeated rows are
packed as often as they occur, a null id stays null. Other columns are left out.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import salted_rank, stored

#: Words whose ids a worker remembers, at most.
REMEMBERED = 500_000
#: Texts are worked on in parts of about so many bytes, and words put together so many at a time.
PART_BYTES = 8 << 20
ASSEMBLED_WORDS = 1 << 18
#: Rows that one task numbers within a length.
RANKED_ROWS = 1_000
_RANK_BITS = 44


class WordIds:
    """Ids of texts, word by word (unsigned 32 bit).

    This vocabulary's tokens never cross white space, so a text's ids are those of
    its words, in order. Arrow splits a batch of texts and numbers its words, so that Python looks each word up once a batch;
    ids are remembered over batches, and put together with numpy. Texts are
    cut at space and line feed only, and what else counts as white space stays
    with the tokenizer. Nor do tokens cross from letters to marks: a word of letters with marks after it is made of both.
    New words of letters that are as the tokenizer would normalize them are encoded in one run, without its patterns: each ends with a
    token that says so, and if as many do as there are words, the run is cut there.

    When too many words are remembered, those that never came again are forgotten.
    """

    _marks = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        tokenizer = Tokenizer.from_file(path)
        self.encode = tokenizer.encode_batch_fast
        words = Tokenizer(tokenizer.model)
        words.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        self.encode_words = words.encode_batch_fast
        self.remembered = remembered
        self.known: dict[str, bytes] = {"": b""}
        self.again: set[str] = set()
        vocabulary = tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _together(self, words: list[str]) -> None:
        ids = np.array(self.encode_words([" ".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
        cut = np.flatnonzero(self.ends[ids]) + 1
        if len(cut) == len(words) and cut[-1] == len(ids):
            raw = ids.tobytes()
            at = (4 * cut).tolist()
            self.known.update(zip(words, [raw[a:b] for a, b in zip([0, *at], at)]))
        else:
            self._apart(words)

    def _apart(self, words: list[str]) -> None:
        for w, found in zip(words, self.encode(words, add_special_tokens=False), strict=True):
            self.known[w] = np.array(found.ids, dtype="<u4").tobytes()

    def learn(self, words: list[str]) -> None:
        known, marks = self.known, self._marks
        cores = [w.rstrip(marks) for w in words]
        letters = list({c for c in cores if c not in known and c.isalpha() and (c.isascii() or unicodedata.is_normalized("NFC", c)) and c == c.lower()})
        for at in range(0, len(letters), 1_000):
            self._together(letters[at : at + 1_000])
        two = [(w, c) for w, c in zip(words, cores) if len(w) > len(c) and c in known and c.isalpha()]
        made = {w for w, _ in two}
        ends = {w[len(c) :] for w, c in two}
        self._apart([w for w in {*words, *ends} if w not in known and w not in made])
        known.update([(w, known[c] + known[w[len(c) :]]) for w, c in two])

    def of_words(self, words: list[str]) -> list[bytes]:
        """The ids of different words."""
        got = list(map(self.known.get, words))
        new = [w for w, g in zip(words, got) if g is None]
        if not new:
            return got
        if len(self.known) + len(new) > self.remembered:
            self.known = {w: self.known[w] for w in self.again if w in self.known} | {"": b""}
            self.again = set()
            new = [w for w in words if w not in self.known]
        if 4 * len(self.known) > 3 * self.remembered:
            self.again.update(set(words).difference(new))
        self.learn(new)
        return list(map(self.known.__getitem__, words))

    def of_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's begin, and the end)."""
        # A copy: ascii_lower goes wrong on a slice of an array.
        texts = texts.cast(pa.large_string()).fill_null("").take(pa.array(np.arange(len(texts))))
        # A special token's name in capitals would become the token in small letters.
        lower = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        split = pc.split_pattern(pc.replace_substring(lower, "\n", " "), " ")
        words = split.flatten().dictionary_encode()
        found = self.of_words(words.dictionary.to_pylist())
        size = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        begin = np.cumsum(size) - size
        every = np.frombuffer(b"".join(found), dtype="<u4")
        code = words.indices.to_numpy()
        parts, ends = [], [np.zeros(1, dtype=np.int64)]
        for at in range(0, len(code), ASSEMBLED_WORDS):
            c = code[at : at + ASSEMBLED_WORDS]
            n = size[c]
            end = np.cumsum(n)
            parts.append(every[np.arange(end[-1]) + np.repeat(begin[c] - end + n, n)])
            ends.append(end + ends[-1][-1])
        ids = np.concatenate(parts) if parts else np.empty(0, dtype="<u4")
        first = split.offsets.to_numpy() - split.offsets[0].as_py()
        return ids, np.concatenate(ends)[first]

    def __call__(self, texts: list[str | None]) -> Iterator[bytes]:
        ids, at = self.of_texts(pa.array(texts, pa.string()))
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            yield ids[a:b].tobytes()


_tokenizers: dict[str, WordIds] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _cut(part: pa.RecordBatch, ids: WordIds, capacity: int, end_id: int, with_ids: bool) -> pa.RecordBatch:
    """The pieces of some documents."""
    found, at = ids.of_texts(part.column(1))
    n = part.num_rows
    length = np.diff(at) + 1
    begin = np.cumsum(length) - length
    every = np.empty(len(found) + n, dtype="<u4")
    last = begin + length - 1
    inside = np.ones(len(every), dtype=bool)
    inside[last] = False
    every[last], every[inside] = end_id, found
    pieces = -(-length // capacity)
    of = np.repeat(np.arange(n), pieces)
    piece = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = piece * capacity
    cut = np.minimum(length[of] - start, capacity)
    place = begin[of] + start
    raw = memoryview(every).cast("B")
    crc = [zlib.crc32(raw[4 * a : 4 * (a + c)]) for a, c in zip(place.tolist(), cut.tolist(), strict=True)]
    columns = [part.column(0).take(pa.array(of)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(cut), pa.array(crc, pa.int64())]
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    if with_ids:
        columns.append(pa.array([bytes(raw[4 * a : 4 * (a + c)]) for a, c in zip(place.tolist(), cut.tolist(), strict=True)], pa.binary()))
        names.append("ids")
    return pa.RecordBatch.from_arrays(columns, names=names)


def _pieces(path: str | None, capacity: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = path or default_tokenizer()
        if place not in _tokenizers:
            _tokenizers[place] = WordIds(place)
        ids = _tokenizers[place]
        for batch in batches:
            size = pc.coalesce(pc.binary_length(batch.column(1)), 0).to_numpy()
            part_of = (np.cumsum(size, dtype=np.int64) - size) // PART_BYTES
            edges = [0, *(np.flatnonzero(np.diff(part_of)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:], strict=False):
                if a < b:
                    cut = _cut(batch.slice(a, b - a), ids, capacity, end_id, with_ids)
                    # Workers serve later stages too: what Arrow keeps of a part's words would count against them.
                    pa.default_memory_pool().release_unused()
                    yield cut

    return run


def tokenized(
    docs: DataFrame, capacity: int = 4096, end_id: int = 1, tokenizer: str | None = None, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """A row for every piece; with_ids adds its ids as little-endian unsigned 32-bit binary."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    texts = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return texts.mapInArrow(_pieces(tokenizer, capacity, end_id, with_ids), schema)


def best_two_fit(counts: np.ndarray, capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, ranks, first sequence, sequences, offset) for counts[length] pieces of each length.

    Rank first + i lies in sequence first + i % sequences, at offset + length * (i // sequences).
    """
    counts = np.asarray(counts, dtype=np.int64).copy()
    sizes = np.arange(capacity + 1)
    used = np.zeros(capacity + 1, dtype=np.int64)
    runs, sequence = [], 0
    floor = np.maximum.accumulate(np.where(counts > 0, sizes, 0))
    while floor[capacity]:
        gap, bin_ = capacity, []
        x = int(floor[gap])
        while x:
            n = min(int(counts[x]), gap // x)
            bin_.append([x, n])
            gap -= n * x
            x = int(floor[min(gap, x - 1)])
        need = dict(map(tuple, bin_))
        if gap:
            smallest = bin_[-1][0]
            room = gap + smallest
            left = counts[: room + 1].copy()
            for x, n in bin_:
                if x <= room:
                    left[x] -= n
            free = np.where(left > 0, sizes[: room + 1], 0)
            below = np.maximum.accumulate(free)
            first = np.flatnonzero(free)
            if len(first):
                second = below[np.minimum(room - first, first)]  # the second is no larger than the first
                twice = (second == first) & (left[first] < 2)
                second = np.where(twice, below[np.maximum(second - 1, 0)], second)
                both = np.where(second > 0, first + second, 0)
                best = int(both.argmax())
                if both[best] > smallest:
                    a, b = int(first[best]), int(second[best])
                    bin_[-1][1] -= 1
                    for x in (a, b):
                        need[x] = need.get(x, 0) + 1
                        bin_.append([x, 1])
        times = min(int(counts[x]) // n for x, n in need.items())
        offset = 0
        for x, n in bin_:
            if n:
                runs.append((x, int(used[x]), n * times, sequence, times, offset))
                used[x] += n * times
                counts[x] -= n * times
                offset += n * x
        sequence += times
        if any(not counts[x] for x, _ in bin_):
            floor = np.maximum.accumulate(np.where(counts > 0, sizes, 0))
    return runs


def _place(runs):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, sequence, times, offset = runs.value
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            at = np.searchsorted(key, (length << _RANK_BITS) + rank, side="right") - 1
            i = rank - first[at]
            keep = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in keep] + [pa.array(sequence[at] + i % times[at]), pa.array(offset[at] + length * (i // times[at]))],
                names=[*keep, "sequence_id", "offset"],
            )

    return run


def pack(
    docs: DataFrame, capacity: int = 4096, end_id: int = 1, tokenizer: str | None = None, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset) of every piece of every document."""
    spark = docs.sparkSession
    pieces = stored(tokenized(docs, capacity, end_id, tokenizer, with_ids, id_col, text_col), "pieces")
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect():  # capacity rows at most
        counts[r["length"]] = r["n"]
    runs = sorted(best_two_fit(counts, capacity))
    length, first, _, sequence, times, offset = (np.array(x, dtype=np.int64) for x in (zip(*runs, strict=True) if runs else [()] * 6))
    told = spark.sparkContext.broadcast(((length << _RANK_BITS) + first, first, sequence, times, offset))
    salts = F.get(F.lit((counts // RANKED_ROWS + 1).tolist()), F.col("length").cast("int"))
    ranked = salted_rank(pieces, ["length"], F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), salts), ["doc_id", "piece", "ids_crc32"], "rank")
    ranked = ranked.select(*pieces.columns, F.col("rank").cast("long"))
    schema = ", ".join(f"{n} {t}" for n, t in pieces.dtypes) + ", sequence_id long, offset long"
    return ranked.mapInArrow(_place(told), schema)
