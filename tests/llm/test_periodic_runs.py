"""Periodic runs against brute force on sequences, and the query against plain Python on whole small tables."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from plumbline.llm import periodic_runs as K
from plumbline.llm.queries import op13_periodic_runs
from tests.llm import cases


def brute(words, least=24, times=3):
    n, out = len(words), []
    for p in range(1, n // times + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            length, s = j + p - i, words[i : j + p]
            if length >= max(least, times * p) and not any(s[q:] == s[:-q] for q in range(1, p)):
                out.append((i, length, p))
            i = j
    return sorted(out)


def sequences(rng):
    for _ in range(rng.randrange(1, 6)):
        kinds, n = rng.randrange(1, 4), rng.randrange(0, 70)
        s = [rng.randrange(kinds) for _ in range(n)]
        if n and rng.random() < 0.5:
            a = rng.randrange(n)
            p = rng.randrange(1, n - a + 1)
            s = [s[i] if i < a else s[a + (i - a) % p] for i in range(n)]
        yield s


@pytest.mark.parametrize("few", [0, 3, 48])
def test_runs_of_sequences(few, monkeypatch):
    monkeypatch.setattr(K, "FEW", few)
    rng = random.Random(few)
    for _ in range(400):
        found = list(sequences(rng))
        least, times = rng.choice([(24, 3), (1, 2), (6, 2), (5, 3)])
        sizes, codes = np.array([len(s) for s in found]), np.array([x for s in found for x in s], dtype=np.int64)
        got = [[] for _ in found]
        for j, *run in zip(*(x.tolist() for x in K.runs_of(codes, sizes, least, times)), strict=True):
            got[j].append(tuple(run))
        assert got == [brute(s, least, times) for s in found]


def test_long_periods_take_time_in_proportion():
    """A text that repeats a third of itself, and one word over and over."""
    once = np.arange(20_000)
    for codes, run in ((np.tile(once, 3), (0, 60_000, 20_000)), (np.zeros(60_000, dtype=np.int64), (0, 60_000, 1))):
        assert [x.tolist() for x in K.runs_of(codes, np.array([len(codes)]))] == [[0], *([x] for x in run)]


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    keep = [not any(s + p <= i < s + length for s, length, p in runs) for i in range(n)]
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    exponent = (1000 * best[1] // best[2],) if best else (None,)
    return (doc_id, len(runs), *(best or (None,) * 3), *exponent, sha("".join(f"{s},{length},{p}\n" for s, length, p in runs)), sha(" ".join(w for w, k in zip(words, keep, strict=True) if k)), n)


def sort_key(r):
    return tuple((x is not None, x) for x in r)


def awkward():
    found = [*cases.texts(), "la " * 40, "a b " * 30 + "c " * 30, "x y z z \u0085 " * 12, "ü\x0bö\x0c" * 20, "one two three " * 3000]
    ids = [*range(len(found) - 4), None, None, 7, -3]
    return [(i, *r[1:]) for i, r in zip(ids, cases.rows(found), strict=True)]


def test_query_on_awkward_rows(spark, tmp_path):
    rows = awkward()
    rows += rows[:3] + [(h, "w v u t s " * 9, *rows[0][2:]) for h in range(1000, 1100)]
    spark.createDataFrame(rows, cases.SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in op13_periodic_runs(spark, str(tmp_path)).collect()), key=sort_key)
    assert got == sorted((expected(r[0], r[1]) for r in rows), key=sort_key)
    assert sum(r[1] > 0 for r in got) > 5


def test_query_on_whole_table(spark):
    place = "/root/testdata/sf0.001"
    got = sorted(tuple(r) for r in op13_periodic_runs(spark, place).collect())
    texts = spark.read.parquet(f"{place}/documents.parquet").select("doc_id", "text").collect()
    assert got == sorted(expected(*r) for r in texts)


def test_empty_table(spark):
    assert K.periodic_runs(K.with_repeats(cases.empty(spark))).collect() == []
