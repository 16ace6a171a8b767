"""The trie's nodes against a plain dictionary of prefixes, at sizes that split subtries often and never."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from plumbline.llm.conversation_trie import prefix_trie, sequences, with_shared_heads
from plumbline.llm.queries import op12_conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string, id string, part string, n long, level long, class string"


def rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(x)] for c, x in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    return out


def brute(found):
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every prefix."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in found.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0) + sum(saved[k] for k in kids[p])
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(kids[p]), leaves[p], saved[p], sha(ends[p])) for p, m in members.items())


def collected(df):
    return sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in df.collect())


def conversations():
    """Copies, shared first turns, one conversation of many turns, nulls, and every id's digits giving another head."""
    rows = []
    for c in range(260):
        if c % 100 == 50:
            continue
        for t in range(1 + c % 7):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"turn {t} of {c % (3 if c % 2 else 40)}" + "ü" * (t % 3)))
    rows += [(c, t, "user", "the same " * t) for c in range(700, 730) for t in range(8)]
    rows += [(800, t, "user", f"long {t}") for t in range(300)] + [(801, t, "user", f"long {t}") for t in range(299)]
    rows += [(c, t, "user", f"shared {t}" if t < 40 else f"own {c} {t}") for c in range(900, 905) for t in range(45)]
    rows += [(1001, None, None, "first"), (1001, 0, "user", None), (1001, 3, "", ""), (None, 1, "user", "nobody's"), (1002, 1, "a", "bc"), (1003, 1, "ab", "c")]
    rows += [(1004, 0, "user", "again")] * 3 + [(c, 0, "u", "x" * 50_000) for c in (2001, 2002)]
    return [(*r, "x", "y", 1, 2, "z") for r in rows]


@pytest.mark.parametrize("oversized, bucket", [(3, 10), (40, 500), (1_000_000, 20_000)])
def test_nodes(spark, oversized, bucket):
    rows = conversations()
    found = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = prefix_trie(with_shared_heads(sequences(found)), oversized, bucket)
    assert collected(got) == brute(rebuilt(rows))


def test_query_on_whole_table(spark):
    place = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{place}/conversations.parquet").collect()
    assert collected(op12_conversation_trie(spark, place)) == brute(rebuilt([tuple(r) for r in rows]))


def test_turnless_and_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert prefix_trie(sequences(none)).collect() == []
    # Conversations of fewer turns than their heads have, without the one that lends them.
    rows = [(c, 0, "user", "hello", "", "", 0, 0, "") for c in range(101, 140)]
    got = prefix_trie(with_shared_heads(sequences(spark.createDataFrame(rows, SCHEMA))))
    assert collected(got) == brute(rebuilt(rows))
    rows = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 6]
    got = prefix_trie(with_shared_heads(sequences(spark.createDataFrame(rows, SCHEMA))))
    assert collected(got) == brute(rebuilt(rows)) and got.count() == 1


def test_a_class_of_many_members(spark):
    """Ids of a class come from many strings, in the order of numbers."""
    found = spark.range(-1500, 4000, 1, 7).select(F.col("id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("u").alias("role"), F.lit("t").alias("text"))
    ids = ",".join(map(str, range(-1500, 4000)))
    got = {r["depth"]: r for r in prefix_trie(sequences(found)).collect()}
    assert got[1]["ends_sha256"] == hashlib.sha256(ids.encode()).hexdigest() and got[1]["n_convs"] == 5500
