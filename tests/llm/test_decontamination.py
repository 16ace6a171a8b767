import hashlib
import re

import pytest
from cases import documents, empty, texts

from plumbline.llm import decontamination as D


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(found, items):
    windows: dict[tuple, set] = {}
    for name, text in items:
        w = words(text)
        if text is None or name is None or not w:
            continue
        for i in range(max(1, len(w) - 7)):
            windows.setdefault(tuple(w[i : i + 8]), set()).add(str(name))
    out = []
    for i, text in enumerate(found):
        w, hit, names = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for j in range(len(w) - n + 1):
                if (key := tuple(w[j : j + n])) in windows:
                    hit.update(range(j, j + n))
                    names |= windows[key]
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), len(names) >= 2))
    return out


def benchmark(spark, found):
    long = [t for t in found if t and len(words(t)) > 20]
    items = [(i, " ".join(words(t)[3:25])) for i, t in enumerate(long[:6])] + [(10, "one"), (11, "Two  WORDS"), (12, ""), (13, None), (None, long[7]), (14, "of the"), (14, "a-b_c d e f"), (15, long[8].upper()), (9, "one")]
    return items, spark.createDataFrame(items, "item_id long, text string")


def result(spark, found, table, **options):
    got = D.decontaminate(documents(spark, found), table, **options).collect()
    return sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got)


def test_against_brute_force(spark):
    found = texts()
    items, table = benchmark(spark, found)
    assert result(spark, found, table) == brute(found, items)


def test_blocks_of_the_benchmark(spark, monkeypatch):
    found = texts(seed=3)
    items, table = benchmark(spark, found)
    monkeypatch.setattr(D, "BLOCK_BYTES", 300)
    assert result(spark, found, table) == brute(found, items)


def test_nothing_to_find(spark):
    _, table = benchmark(spark, texts())
    assert D.decontaminate(empty(spark), table).collect() == []
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r[2] for r in result(spark, texts(), none))


def test_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h")] * 2 + [(None, None)], "doc_id long, text string")
    got = D.decontaminate(docs, spark.createDataFrame([(1, "x a b c d e f g h")], "item_id long, text string")).collect()
    assert sorted((r.n_words, r.n_hit) for r in got) == [(0, 0), (8, 8), (8, 8)]


@pytest.mark.parametrize("block", [1 << 24, 100])
def test_crafted_words_are_not_hits(spark, monkeypatch, block):
    """An item of a word, and one of a window, that only a polynomial hash modulo 2**64 finds in the documents."""
    from test_kernel import thue_morse

    monkeypatch.setattr(D, "BLOCK_BYTES", block)
    a, b = thue_morse(11)
    rest = "one two three four five six seven"
    table = spark.createDataFrame([(1, a), (2, f"{a} {rest}"), (3, f"{rest} {a}")], "item_id long, text string")
    found = [b, f"{b} {rest}", f"{rest} {b} {rest}", a]
    got = result(spark, found, table)
    assert got == brute(found, [(1, a), (2, f"{a} {rest}"), (3, f"{rest} {a}")]) and [r[2] for r in got] == [0, 0, 0, 1]
