"""The bounded search for pairs against all pairs, on 2,000 panels' features."""

import numpy as np
import pytest

from plumbline.operators import candidates as C

SCHEMA = "panel_id string, phash bigint, dhash bigint, edge_hist array<float>, width int, height int, page int, key string, n long"


def features(n, seed, near=0, **fixed):
    """Random features, and ``near`` panels whose features are near those of earlier ones."""
    rng = np.random.default_rng(seed)
    bits = lambda: int(rng.integers(-(1 << 63), (1 << 63) - 1))
    rows = []
    for i in range(n):
        if i >= n - near and rows:
            _, ph, dh, edges, w, h, *_ = rows[int(rng.integers(0, n - near))]
            turn = lambda x: int(np.int64(x) ^ np.int64(sum(1 << int(b) for b in rng.choice(62, int(rng.integers(0, 3)), replace=False))))
            row = {"phash": turn(ph), "dhash": turn(dh), "edge_hist": edges if rng.random() < 0.5 else np.abs(np.array(edges) + rng.normal(0, 0.01, len(edges))).tolist(), "width": w + int(rng.integers(0, 2)), "height": h}
        else:
            row = {"phash": bits(), "dhash": bits(), "edge_hist": np.abs(rng.normal(0, 1, 12)).astype(np.float32).tolist(), "width": int(rng.integers(60, 400)), "height": int(rng.integers(60, 400))}
        row |= fixed
        rows.append((f"p{i:05d}", row["phash"], row["dhash"], row["edge_hist"], row["width"], row["height"], 1, "x", 2))
    return rows


def brute(rows, max_pairs, every=False):
    ph, dh = (np.array([r[c] for r in rows], dtype=np.int64).view(np.uint64) for c in (1, 2))
    edges = np.array([r[3] for r in rows], dtype=np.float32).astype(np.float64)
    area = np.array([float(r[4]) * r[5] for r in rows])
    a, b = np.triu_indices(len(rows), 1)
    p, d = np.bitwise_count(ph[a] ^ ph[b]).astype(int), np.bitwise_count(dh[a] ^ dh[b]).astype(int)
    norm = np.sqrt((edges**2).sum(axis=1))
    cos = (edges[a] * edges[b]).sum(axis=1) / np.maximum(norm[a] * norm[b], 1e-9)
    ratio = np.minimum(area[a], area[b]) / np.maximum(area[a], area[b])
    score = (64 - p) + 0.75 * (64 - d) + 40 * cos + 12 * ratio
    good = np.flatnonzero(every | (p <= 18) | (d <= 18) | (cos >= 0.55) | (ratio < 0.65))
    good = good[np.lexsort((b[good], a[good], -np.round(score[good], 7)))][:max_pairs]
    return [(rows[i][0], rows[j][0], int(x), int(y)) for i, j, x, y in zip(a[good], b[good], p[good], d[good], strict=True)]


def found(spark, rows, max_pairs):
    got = C.candidate_pairs(spark.createDataFrame(rows, SCHEMA).repartition(3), max_pairs).collect()
    assert [r.recall_score for r in got] == sorted((r.recall_score for r in got), reverse=True)
    return [(r.panel_id_a, r.panel_id_b, r.phash_distance, r.dhash_distance) for r in got]


@pytest.fixture
def no_blocks(monkeypatch):
    def never(*_):
        raise AssertionError("all pairs were asked for")

    monkeypatch.setattr(C, "_by_blocks", never)


@pytest.mark.parametrize("fixed", [{}, {"phash": 5}, {"dhash": 7}, {"edge_hist": [1.0, 2.0] * 6, "width": 100, "height": 80}], ids=["none", "phash", "dhash", "edges and area"])
def test_near_pairs_without_all_pairs(spark, no_blocks, fixed):
    """One feature may have the same value in all panels."""
    rows = features(2_000, 1, near=700, **fixed)
    assert found(spark, rows, 300) == brute(rows, 300)


def test_far_pairs_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 300)
    rows = features(700, 2, near=40)
    assert sorted(found(spark, rows, 2_000)) == sorted(brute(rows, 2_000))


def test_equal_features(spark, no_blocks):
    """All panels alike: the first pairs by id, of 400 panels; and three groups of copies."""
    same = [(f"p{i:05d}", 1, 2, [1.0, 0.0], 9, 9, 1, "x", 2) for i in range(400)]
    assert found(spark, same, 500) == brute(same, 500)
    groups = [(f"p{i:05d}", 1 << (i % 3), 2, [1.0, 0.0], 9, 9, 1, "x", 2) for i in range(150)]
    assert found(spark, groups, 6_000) == brute(groups, 6_000)


def test_few_or_none(spark):
    rows = features(40, 3)
    assert sorted(found(spark, rows, 5_000)) == sorted(brute(rows, 5_000, every=True))
    assert found(spark, [], 10) == [] and found(spark, rows[:1], 10) == []
