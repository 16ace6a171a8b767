"""Periodic runs of words: maximal stretches that repeat a period three times or more.

Crochemore's partition refinement (1981). Positions whose factors of length l
are equal form a class. The classes of length l + 1 come from those of length l: a class is split by the classes
of its members' next positions, and only positions before a *small* part of a
class that was just split have to move (of the parts of a class, all but one largest are
small). A position moves at most log2(n) times. Members of a class are linked in the order of their places; where neighbours lie at a
distance equal to the length, a square begins. Squares at places in a row
make one run: its period is that length and can't be made of a smaller one, as no member lies between.

A batch's texts are refined together, a numpy step for each length, so a step's
cost is that of the positions that move in it. Words are told apart by themselves, not by hashes. Work ends for a text at a
third of its words, as no longer period can occur three times, and for all when every class has one member.

A run counts from ``least`` words and ``times`` periods. ``collapsed`` is the
text's words without those that some run contains after its first period, joined by a space.

Defined results: a null or empty text has no words, no runs and the empty collapsed text; repeated rows and ids, and
null ids, are rows like others, each with its own result; a text is never cut, whatever its length; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts are refined in parts of about so many bytes; one text is never cut.
PART_BYTES = 4 << 20
#: Up to so many places are moved one by one; more by numpy, whose calls would cost more than few places do.
FEW = 48
SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


class Partition:
    """Classes of the positions of some sequences: where equal factors of ``length`` begin.

    symbols: one array of all sequences, each with an extra place of its own symbol after it, and one before the first.
    furthest: for each place, the length up to which its sequence is refined (0 for the extra places).
    """

    def __init__(self, symbols: np.ndarray, furthest: np.ndarray):
        n = len(symbols)
        self.n, self.length, self.furthest = n, 1, furthest
        order = np.argsort(symbols, kind="stable")
        begins = np.empty(n, dtype=bool)
        begins[0] = True
        np.not_equal(symbols[order][1:], symbols[order][:-1], out=begins[1:])
        of = np.cumsum(begins) - 1
        self.order = order
        self.slot = np.empty(n, dtype=np.int64)
        self.slot[order] = np.arange(n)
        self.of = np.empty(n, dtype=np.int64)
        self.of[order] = of
        self.classes = int(of[-1]) + 1
        self.start = np.empty(n, dtype=np.int64)
        self.start[: self.classes] = np.flatnonzero(begins)
        self.size = np.zeros(n, dtype=np.int64)
        self.size[: self.classes] = np.diff(self.start[: self.classes], append=n)
        self.after = np.full(n, -1, dtype=np.int64)
        self.before = np.full(n, -1, dtype=np.int64)
        inner = ~begins[1:]
        self.after[order[:-1][inner]] = order[1:][inner]
        self.before[order[1:][inner]] = order[:-1][inner]
        self.marked = np.zeros(n, dtype=bool)
        self.views = [memoryview(x) for x in (self.of, self.size, self.start, self.order, self.slot, self.after, self.before, self.furthest)]
        self.moving = np.arange(n)  # members of small classes
        self.changed = np.empty(0, dtype=np.int64)  # places whose neighbour in the class is new

    def refine(self) -> bool:
        """From ``length`` to ``length`` + 1; False when nothing can move any more."""
        if len(self.moving) <= FEW:
            return self._refine_few(self.moving.tolist() if isinstance(self.moving, np.ndarray) else self.moving)
        if isinstance(self.moving, list):
            self.moving = np.array(self.moving, dtype=np.int64)
        m = self.moving[self.moving > 0] - 1
        m = m[(self.size[self.of[m]] > 1) & (self.furthest[m] > self.length)]
        self.length += 1
        if not len(m):
            self.moving = self.changed = m
            return False
        m.sort()
        m = m[np.argsort(self.of[m], kind="stable")]
        parent = self.of[m]
        unlinked = self._unlink(m)
        # Groups of those that move: by the class left, then by the next position's class.
        by = parent * self.n + self.of[m + 1]
        sorting = np.argsort(by, kind="stable")
        m, by = m[sorting], by[sorting]
        first = np.empty(len(m), dtype=bool)
        first[0] = True
        np.not_equal(by[1:], by[:-1], out=first[1:])
        together = ~first[1:]
        self.after[m] = self.before[m] = -1
        self.after[m[:-1][together]] = m[1:][together]
        self.before[m[1:][together]] = m[:-1][together]
        self.changed = np.concatenate([unlinked, m[:-1][together]])
        self._split(m, parent, np.flatnonzero(first))
        return True

    def _refine_few(self, moving: list[int]) -> bool:
        """As ``refine``, for few places."""
        of, size, start, order, slot, after, before, furthest = self.views
        length = self.length
        self.length += 1
        split: dict[int, dict[int, list[int]]] = {}
        for i in sorted(moving):
            i -= 1
            if i >= 0 and furthest[i] > length and size[c := of[i]] > 1:
                split.setdefault(c, {}).setdefault(of[i + 1], []).append(i)
        changed: list[int] = []
        parts: list[int] = []
        for c, groups in split.items():
            for group in groups.values():
                for i in group:
                    left, right = before[i], after[i]
                    if left >= 0:
                        after[left] = right
                        if right >= 0:
                            changed.append(left)
                    if right >= 0:
                        before[right] = left
                    size[c] -= 1
                    last = start[c] + size[c]
                    other, held = order[last], slot[i]
                    order[held], slot[other] = other, held
                    order[last], slot[i] = i, last
            rest = size[c]
            at = start[c] + rest
            largest = max(groups.values(), key=len)
            for group in groups.values():
                number = self.classes
                if group is largest and not rest:
                    number = c
                else:
                    self.classes += 1
                size[number], start[number] = len(group), at
                previous = -1
                for i in group:
                    of[i], order[at], slot[i] = number, i, at
                    before[i], after[i] = previous, -1
                    if previous >= 0:
                        after[previous] = i
                        changed.append(previous)
                    previous = i
                    at += 1
                if group is not largest or len(group) <= rest:
                    parts += group
            if 0 < rest < len(largest):
                parts += order[start[c] : start[c] + rest].tolist()
        self.moving, self.changed = parts, changed
        return bool(split)

    def _unlink(self, m: np.ndarray) -> np.ndarray:
        """Takes m (by class, then place) out of their classes' links; the places that got another neighbour."""
        cut = self.after[m[:-1]] != m[1:]
        left = self.before[m[np.concatenate([[True], cut])]]
        right = self.after[m[np.concatenate([cut, [True]])]]
        both = (left >= 0) & (right >= 0)
        self.after[left[left >= 0]] = right[left >= 0]
        self.before[right[right >= 0]] = left[right >= 0]
        return left[both]

    def _split(self, m: np.ndarray, parent: np.ndarray, at: np.ndarray) -> None:
        """Makes classes of the groups of m that begin at ``at``, and finds the small ones of each split class."""
        size = np.diff(at, append=len(m))
        left = parent[at]  # the class that each group leaves
        new_parent = np.empty(len(at), dtype=bool)
        new_parent[0] = True
        np.not_equal(left[1:], left[:-1], out=new_parent[1:])
        head = np.flatnonzero(new_parent)
        old = left[head]
        moved = np.add.reduceat(size, head)
        rest = self.size[old] - moved
        # Those that move take their class's last slots; those that stay there go to the slots left in front.
        begin = self.start[old] + rest
        ends = np.cumsum(moved)
        tail = np.arange(len(m)) + np.repeat(begin - (ends - moved), moved)
        held = self.slot[m]
        front = held[held < np.repeat(begin, moved)]
        self.marked[held] = True
        stay = self.order[tail[~self.marked[tail]]]
        self.marked[held] = False
        self.order[front] = stay
        self.slot[stay] = front
        self.order[tail] = m
        self.slot[m] = tail
        # The largest group takes the number of a class of which nothing is left.
        nth = np.repeat(np.arange(len(head)), np.diff(head, append=len(at)))
        largest = np.maximum.reduceat(size, head)
        candidates = np.flatnonzero(size == largest[nth])
        _, one = np.unique(nth[candidates], return_index=True)
        top = candidates[one]  # one largest group of each class
        emptied = rest == 0
        number = np.empty(len(at), dtype=np.int64)
        fresh = np.ones(len(at), dtype=bool)
        fresh[top[emptied]] = False
        number[fresh] = self.classes + np.arange(fresh.sum())
        number[top[emptied]] = old[emptied]
        self.classes += int(fresh.sum())
        self.size[old] = rest
        self.size[number] = size
        self.start[number] = tail[at]
        self.of[m] = np.repeat(number, size)
        # Small: all parts but one largest.
        group_is_largest = largest > rest
        small = np.ones(len(at), dtype=bool)
        small[top[group_is_largest]] = False
        parts = m[np.repeat(small, size)]
        stayed = old[group_is_largest & (rest > 0)]
        if len(stayed):
            n = self.size[stayed]
            slots = np.arange(n.sum()) + np.repeat(self.start[stayed] - (np.cumsum(n) - n), n)
            parts = np.concatenate([parts, self.order[slots]])
        self.moving = parts


def squares(p: Partition) -> Iterator[tuple[int, np.ndarray]]:
    """(length, places in order at which a square of that period begins), while the partition is refined.

    Distances of neighbours are looked through when the length doubles; between, those that change are noted.
    """
    horizon, known, at, noted = 1, np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), {}
    furthest = int(p.furthest.max(initial=0))
    while p.length <= furthest:
        length = p.length
        if length == horizon:
            horizon *= 2
            places = np.flatnonzero(p.after >= 0)
            distance = p.after[places] - places
            near = (distance >= length) & (distance < horizon)
            places, distance = places[near], distance[near]
            sorting = np.argsort(distance, kind="stable")
            known, at, noted = places[sorting], np.searchsorted(distance[sorting], np.arange(length, horizon + 1)), {}
            base = length
        elif isinstance(p.changed, list):
            for i in p.changed:
                if length <= p.after[i] - i < horizon:
                    noted.setdefault(int(p.after[i]) - i, []).append([i])
        elif len(p.changed):
            distance = p.after[p.changed] - p.changed
            near = (distance >= length) & (distance < horizon)
            if near.any():
                places, distance = p.changed[near], distance[near]
                if len(places) > 1:
                    sorting = np.argsort(distance, kind="stable")
                    places, distance = places[sorting], distance[sorting]
                cuts = [0, *(np.flatnonzero(np.diff(distance)) + 1).tolist(), len(places)]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    noted.setdefault(int(distance[a]), []).append(places[a:b])
        found = known[at[length - base] : at[length - base + 1]]
        if length in noted:
            found = np.unique(np.concatenate([found, *noted.pop(length)]))
        if len(found):
            found = found[(p.after[found] - found == length) & (p.furthest[found] >= length)]
            if len(found):
                yield length, found
        if not p.refine():
            return


def runs_of(codes: np.ndarray, sizes: np.ndarray, least: int = 24, times: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, start, length, period) of all runs, in that order.

    codes: the symbols, numbers from 0, of sequences of the given sizes, one after the other.
    """
    n, total = len(sizes), len(codes)
    empty = np.empty(0, dtype=np.int64)
    if not total:
        return empty, empty, empty, empty
    of = np.repeat(np.arange(n), sizes)
    place = np.arange(total) + of + 1
    kinds = int(codes.max()) + 1
    symbols = np.empty(total + n + 1, dtype=np.int64)
    ends = np.cumsum(sizes + 1)
    symbols[0] = n * kinds
    symbols[ends] = n * kinds + 1 + np.arange(n)
    symbols[place] = of * kinds + codes
    furthest = np.zeros(len(symbols), dtype=np.int64)
    furthest[place] = np.where(sizes >= least, sizes // times, 0)[of]
    got = [(empty, empty, empty)]
    for period, found in squares(Partition(symbols, furthest)):
        edge = np.flatnonzero(np.diff(found) > 1)
        begin, end = found[np.concatenate([[0], edge + 1])], found[np.concatenate([edge, [len(found) - 1]])]
        length = end - begin + 2 * period
        good = length >= max(least, times * period)
        if good.any():
            got.append((begin[good], length[good], np.full(int(good.sum()), period)))
    begin, length, period = (np.concatenate(x) for x in zip(*got, strict=True))
    sequence = np.searchsorted(ends, begin, side="left")
    start = begin - (ends[sequence] - sizes[sequence]) if n else begin
    sorting = np.lexsort((period, start, sequence))
    return sequence[sorting], start[sorting], length[sorting], period[sorting]


def _part(ids: pa.Array, texts: list[bytes | None], least: int, times: int) -> pa.RecordBatch:
    words = [(t or b"").split() for t in texts]
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    every = [w for ws in words for w in ws]
    numbers = {w: i for i, w in enumerate(dict.fromkeys(every))}
    codes = np.fromiter(map(numbers.__getitem__, every), dtype=np.int64, count=len(every))
    sequence, start, length, period = runs_of(codes, sizes, least, times)
    for j in np.unique(sequence).tolist():
        keep = np.ones(int(sizes[j]), dtype=bool)
        mine = slice(*np.searchsorted(sequence, [j, j + 1]))
        for s, n, p in zip(start[mine].tolist(), length[mine].tolist(), period[mine].tolist(), strict=True):
            keep[s + p : s + n] = False
        words[j] = [w for w, k in zip(words[j], keep.tolist(), strict=True) if k]
    offsets = np.searchsorted(sequence, np.arange(len(texts) + 1)).astype(np.int32)
    runs = pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], names=["start", "length", "period"])
    collapsed = pa.array([b" ".join(w) for w in words], pa.binary()).cast(pa.string())
    columns = [ids, pa.array(sizes), pa.ListArray.from_arrays(pa.array(offsets), runs), collapsed]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed"])


def _found(least: int, times: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.coalesce(pc.binary_length(batch.column(1)), 0).to_numpy()
            part_of = (np.cumsum(size, dtype=np.int64) - size) // PART_BYTES
            edges = [0, *(np.flatnonzero(np.diff(part_of)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:], strict=False):
                if a < b:
                    part = batch.slice(a, b - a)
                    yield _part(part.column(0), part.column(1).cast(pa.binary()).to_pylist(), least, times)

    return run


def periodic_runs(docs: DataFrame, least: int = 24, times: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs in order of start and period, collapsed text) of every document."""
    texts = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return texts.mapInArrow(_found(least, times), SCHEMA)


def with_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text), where a tenth of the documents, told by a hash of the id, repeat a stretch of their own words to the end.

    With h = crc32 of the id's digits and g = h div 10, texts of h divisible by 10 repeat from word a = g mod n on the period of
    1 + (n - a) div (3 + g mod 8) words. Others, and those of a null id, stay as they are.
    """
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    n, g = F.col("words_n"), F.col("words_g")
    start = (g % n).cast("int")
    period = (1 + F.floor((n - start) / (3 + g % 8))).cast("int")
    tail = F.slice(F.col("words_w"), start + 1, period)
    repeated = F.slice(F.flatten(F.array_repeat(tail, F.ceil((n - start) / period).cast("int"))), F.lit(1), (n - start).cast("int"))
    changed = F.array_join(F.concat(F.slice(F.col("words_w"), F.lit(1), start), repeated), " ")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), h.alias("words_h"))
    chosen = F.coalesce(F.col("words_h") % 10 == 0, F.lit(False))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    texts = texts.withColumn("words_w", F.when(chosen, words))
    texts = texts.withColumn("words_n", F.size("words_w")).withColumn("words_g", F.floor(F.col("words_h") / 10))
    return texts.select("doc_id", F.when(chosen & (n > 0), changed).otherwise(F.col("text")).alias("text"))
