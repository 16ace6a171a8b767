import random
import re
from itertools import combinations

import numpy as np
import pytest
from cases import documents, empty, texts

from plumbline.llm import jaccard_join as J


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set())


def brute(found, k, percent):
    sets = [shingles(t, k) for t in found]
    root = list(range(len(found)))
    links = [0] * len(found)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(found)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            links[a] += 1
            links[b] += 1
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return [(i, len(sets[i]), find(i), links[i]) for i in range(len(found))]


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80), (2, 60)])
def test_against_brute_force(spark, k, percent):
    found = texts()
    got = J.jaccard_join(documents(spark, found), k, percent).collect()
    assert sorted(map(tuple, got)) == brute(found, k, percent)


def test_long_lists_and_split_blocks(spark):
    """Every list counts as long, and blocks are split into pairs of small chunks."""
    found = texts(seed=5, n=50)
    got = J.jaccard_join(documents(spark, found), 3, 80, short_list=1, chunk=3).collect()
    assert sorted(map(tuple, got)) == brute(found, 3, 80)


def test_small_sets_at_low_similarities(spark):
    """Linked sets that overlap in one or two shingles only."""
    found = [" ".join(sorted(x)) for n in (1, 2, 3, 4) for x in combinations("abcdef", n)]
    found = found[::3] + ["p q", "p q r", "s t", "t u v w"]
    for percent in (34, 60, 66):
        got = J.jaccard_join(documents(spark, found), 1, percent).collect()
        assert sorted(map(tuple, got)) == brute(found, 1, percent)
    pair = J.jaccard_join(documents(spark, ["p q", "p q r"]), 1, 60).collect()
    assert sorted(map(tuple, pair)) == [(0, 2, 0, 1), (1, 3, 0, 1)]


def test_empty_and_repeated_and_null_ids(spark):
    assert J.jaccard_join(empty(spark), 3, 90).collect() == []
    rows = [(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (None, None), (2, "z")]
    got = J.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, 2, 1, 2), (1, 2, 1, 2), (None, 2, 1, 2), (None, 0, None, 0), (2, 1, 2, 0)], key=str)


def test_rows_of_one_id_and_null_ids_keep_their_links(spark):
    rng = random.Random(4)
    a, b = ([rng.choice("abcdefghijklmnop") + str(rng.randrange(99)) for _ in range(60)] for _ in range(2))
    near = lambda words, i: " ".join([*words[:i], "x", *words[i + 1 :]])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a, 3)), (3, near(b, 50)), (None, near(a, 58)), (None, near(b, 59))]
    got = J.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), 1, 80).collect()
    assert sorted((r.doc_id or 0, r.component_id, r.n_links) for r in got) == [(0, 1, 2), (0, 1, 2), (1, 1, 2), (1, 1, 2), (2, 1, 2), (3, 1, 2)]


@pytest.mark.parametrize("percent", [60, 80, 90, 95])
def test_sets_that_link_share_a_signature(percent):
    rng = np.random.default_rng(percent)
    limits = J.bands(percent, 4000)
    for n in [*range(1, 40), 100, 500, 1500]:
        for _ in range(20):
            s = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
            low, high = s.copy(), s
            while True:  # shingles are taken from one and added to the other while they still link
                more = np.unique(np.append(high, rng.integers(0, 1 << 62, 1).astype(np.uint64))) if rng.random() < 0.5 else high
                less = np.delete(low, rng.integers(0, len(low))) if more is high else low
                both = len(np.intersect1d(less, more))
                if not both or 100 * both < percent * (len(less) + len(more) - both):
                    break
                low, high = less, more
            assert np.intersect1d(J.signatures(low, percent, limits), J.signatures(high, percent, limits)).size


def test_stock_passages_make_no_large_block(spark):
    """Documents made of frequent passages, a few of many each, share lists but no signatures."""
    rng = random.Random(9)
    stock = [" ".join(f"s{i}w{j}" for j in range(40)) for i in range(30)]
    found = [" ".join(rng.sample(stock, 5)) for _ in range(90)]
    got = J.jaccard_join(documents(spark, found), 3, 80, short_list=2).collect()
    assert sorted(map(tuple, got)) == brute(found, 3, 80)


@pytest.mark.parametrize("percent", [60, 80, 90, 95])
def test_sketches_rule_out_no_link(percent):
    rng = np.random.default_rng(percent)
    for n in [*range(1, 40), 64, 65, 100, 500, 20_000]:
        s = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        for lost in range(0, n * (100 - percent) // 100 + 1, max(1, n // 20)):
            most = len(s) - lost
            for more in {0, most * 100 // percent - len(s)}:  # as many as still link
                if more < 0:
                    continue
                other = np.unique(np.append(s[lost:], rng.integers(0, 1 << 62, more).astype(np.uint64)))
                both = len(np.intersect1d(s, other))
                if 100 * both >= percent * (len(s) + len(other) - both):
                    assert (100 + percent) * J.apart(J.sketch(s), J.sketch(other)) <= (100 - percent) * (len(s) + len(other))
    a, b = (np.unique(rng.integers(0, 1 << 62, 200).astype(np.uint64)) for _ in range(2))
    assert (100 + percent) * J.apart(J.sketch(a), J.sketch(np.append(a[:60], b))) > (100 - percent) * 460


def test_shared_passages_chain_no_block(spark, monkeypatch):
    """Each document shares a passage with the one before and another with the one after; a few are near copies."""
    rng = random.Random(11)
    words = lambda n: [f"{rng.choice('abcdefgh')}{rng.randrange(10**6)}" for _ in range(n)]
    passages = [words(30) for _ in range(61)]
    found = [" ".join([*passages[i], *words(30), *passages[i + 1]]) for i in range(60)]
    found += [" ".join([*found[i].split()[:-2], "two", "edits"]) for i in (3, 30, 59)]
    held, store = {}, J.stored
    monkeypatch.setattr(J, "stored", lambda df, name: held.setdefault(name, store(df, name)))
    got = J.jaccard_join(documents(spark, found), 3, 80).collect()
    assert sorted(map(tuple, got)) == brute(found, 3, 80)
    assert held["blocks"].groupBy("root").count().agg({"count": "max"}).first()[0] == 2


def test_merge_equals_counting():
    """Lists of a few and of many thousands of postings, at every threshold."""
    rng = np.random.default_rng(3)
    for docs_most, length in ((50, 30), (3_000, 2_000)):
        lists = [np.unique(rng.integers(0, docs_most, length)) for _ in range(9)]
        want = np.bincount(np.concatenate(lists))
        for least in range(1, 10):
            docs, counts = J.merged(lists, least)
            assert docs.tolist() == np.flatnonzero(want >= least).tolist() and counts.tolist() == want[want >= least].tolist()
    assert [x.tolist() for x in J.merged([], 1)] == [[], []]


def test_crafted_words_do_not_link(spark):
    """Words on which a polynomial hash modulo 2**64 agrees, alone and in the middle of equal texts."""
    from test_kernel import thue_morse

    pairs = [thue_morse(n) for n in (10, 12, 16)]
    found = [w for p in pairs for w in p] + [f"a b {w} c d" for p in pairs for w in p]
    got = sorted(map(tuple, J.jaccard_join(documents(spark, found), 3, 90).collect()))
    assert got == brute(found, 3, 90) and all(r[3] == 0 for r in got)


def test_a_passage_that_no_batch_holds_twice_goes_to_the_end_of_the_order(spark, monkeypatch):
    shared = [f"s{i}" for i in range(8)]
    texts = [" ".join([f"w{d}x{i}" for i in range(40)] + shared) for d in range(60)]
    texts.append(texts[7] + " more")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows, real = {}, J.stored

    def stored(df, name):
        out = real(df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(J, "stored", stored)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        got = {r.doc_id: (r.component_id, r.n_links) for r in J.jaccard_join(docs, short_list=8).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == {d: (7, 1) if d in (7, 60) else (d, 0) for d in range(61)}
    assert rows["signatures"] == 0  # each document has enough shingles of its own
