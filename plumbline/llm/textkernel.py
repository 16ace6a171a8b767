"""Vectorised word and shingle hashing over Arrow string batches.

The operators on words need one thing many times: a 64-bit hash for every word
of every text, without a Python object per word. A batch's UTF-8 buffer is
read in place, a word as lanes of eight bytes from its begin. Each lane goes through a mixing that depends on its number, and
the mixed lanes are summed with the length: no arithmetic of the letters is left on which crafted words could collide. Grams mix word
by word in the same way. Hashes depend on the word alone: not on
the batch, the process or Python's hash seed.

Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_STEP = np.uint64(0xD6E8FEB86659FD93)
_LENGTH = np.uint64(0x9E3779B97F4A7C15)
#: Texts are worked on in runs of about so many bytes; one text is never cut.
RUN_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: The first n bytes of a lane.
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def space_separated() -> np.ndarray:
    """Word bytes of ``[^\\x20\\x09-\\x0D]+``."""
    word = np.ones(256, dtype=bool)
    word[[0x20, *range(0x09, 0x0E)]] = False
    return word


def alphanumeric() -> np.ndarray:
    """Word bytes of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` once A-Z are lower."""
    word = np.zeros(256, dtype=bool)
    word[0x30:0x3A] = word[0x41:0x5B] = word[0x61:0x7B] = word[0x80:] = True
    return word


def words_and_marks() -> np.ndarray:
    """Two classes of tokens: runs of word characters (1), and of marks (2)."""
    classes = space_separated().astype(np.uint8) * 2
    classes[alphanumeric() | (np.arange(256) == 0x5F)] = 1
    return classes


def byte_ranges(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each range of bytes. data: followed by eight bytes that no range has."""
    lanes = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    length = end - begin
    out = mix((lanes[begin] & _MASKS[np.minimum(length, 8)]) ^ _LENGTH)
    long = np.flatnonzero(length > 8)
    if len(long):
        n = (length[long] - 1) // 8  # lanes after the first
        edge = np.cumsum(n) - n
        nth = np.arange(1, int(n.sum()) + 1) - np.repeat(edge, n)
        at = np.repeat(begin[long], n) + 8 * nth
        lane = lanes[at] & _MASKS[np.minimum(np.repeat(end[long], n) - at, 8)]
        out[long] += np.add.reduceat(mix(lane ^ mix((nth.astype(np.uint64) + np.uint64(1)) * _LENGTH)), edge)
    return mix(out + length.astype(np.uint64) * _LENGTH)


def _chained(so_far: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a gram with one word more."""
    out = (so_far + word) * _STEP
    out ^= out >> np.uint64(29)
    return out


class Words:
    """The words of a run of texts: hashes, byte ranges, and first word of each text.

    classes: for each byte 0 (no word's) or the class of words that it is of; a word is a run of one class.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, classes: np.ndarray, lower: bool = True):
        n = len(data)
        of = classes[data]
        edge = np.empty(n + 1, dtype=bool)
        np.not_equal(of[1:], of[:-1], out=edge[1:-1])
        edge[offsets] = edge[0] = edge[-1] = True
        begin = np.flatnonzero(edge[:-1] & (of != 0))
        end = np.flatnonzero(edge[1:] & (of != 0)) + 1
        self._data = np.zeros(n + 8, dtype=np.uint8)
        self._data[:n] = _LOWER[data] if lower else data
        self.hash = byte_ranges(self._data, begin, end)
        self.begin, self.end = begin, end
        #: self.first[j] to self.first[j + 1]: the words of text j
        self.first = np.searchsorted(begin, offsets)

    def prefix(self, n: int) -> np.ndarray:
        """The hash of each word's first n bytes, or of all of a shorter one."""
        return byte_ranges(self._data, self.begin, np.minimum(self.begin + n, self.end))

    def grams(self, k: int) -> np.ndarray:
        """The hash of the k words that begin at each word; those that leave their text mean nothing."""
        n = len(self.hash)
        out = np.zeros(n, dtype=np.uint64)
        if n >= k:
            m = n - k + 1
            for j in range(k):
                out[:m] = _chained(out[:m], self.hash[j : j + m])
        return mix(out + np.uint64(k))

    def whole(self, j: int) -> np.ndarray:
        """The hash of all words of text j, as one gram."""
        out = np.zeros(1, dtype=np.uint64)
        words = self.hash[self.first[j] : self.first[j + 1]]
        for h in words:
            out = _chained(out, h)
        return mix(out + np.uint64(len(words)))


def runs(texts: pa.Array, run_bytes: int = RUN_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, bytes, offsets) of runs of whole texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, at, data = texts.buffers()
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(at, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    j = 0
    while j < n:
        k = max(j + 1, int(np.searchsorted(offsets, offsets[j] + run_bytes, side="right")) - 1)
        yield j, raw[offsets[j] : offsets[k]], offsets[j : k + 1] - offsets[j]
        j = k


def shingle_sets(texts: pa.Array, k: int, word_bytes: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted distinct k-word shingles of each text; the whole of a shorter one; none of one without words."""
    for _, data, offsets in runs(texts):
        words = Words(data, offsets, word_bytes)
        grams = words.grams(k)
        for j in range(len(offsets) - 1):
            a, b = words.first[j], words.first[j + 1]
            if b - a >= k:
                found = np.sort(grams[a : b - k + 1])
                keep = np.empty(len(found), dtype=bool)
                keep[0] = True
                np.not_equal(found[1:], found[:-1], out=keep[1:])
                yield found[keep]
            elif b > a:
                yield words.whole(j)
            else:
                yield grams[:0]
