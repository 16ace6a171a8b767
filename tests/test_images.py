import numpy as np
import pytest

from plumbline.functions import keypoints as K
from plumbline.functions import pixels as P
from plumbline.operators import candidates as C
from plumbline.operators import images as I
from plumbline.plans import report


def scene(seed, h=200, w=240):
    rng = np.random.default_rng(seed)
    base = P.resize(rng.integers(0, 230, (h // 8, w // 8)).astype(np.uint8), w // 4, h // 4)
    return np.clip(np.kron(base, np.ones((4, 4))), 0, 230).astype(np.uint8)[:h, :w]


def test_hashes_and_metrics():
    a, b = scene(1), scene(2)
    assert P.dhash(a) == P.dhash(a.copy()) and P.phash(a) != P.phash(b)
    assert P.ncc(a, a) == pytest.approx(1) and P.ssim(a, a) == pytest.approx(1) and P.ssim(a, b) < 0.5
    assert P.whole(a, a[:, ::-1])[2] == "flip_horizontal" and P.whole(a, a[::-1, ::-1])[2] == "flip_both"
    assert np.allclose(P.dct_basis(8) @ P.dct_basis(8).T, np.eye(8))
    assert abs(np.linalg.norm(P.edge_histogram(a)) - 1) < 1e-5 and P.edge_histogram(np.full((50, 50), 7, np.uint8)).sum() == 0


def test_template_finds_a_crop():
    a = scene(3)
    found = P.template(a, a[40:140, 60:180])
    assert found["ncc"] > 0.99 and found["bbox"] == [60, 40, 180, 140] and found["direction"] == "b_in_a"
    brute = np.corrcoef(a[10:50, 20:60].ravel(), a[40:80, 60:100].ravel())[0, 1]
    assert P.correlations(a, a[40:80, 60:100])[10, 20] == pytest.approx(brute, abs=1e-6)


def test_local_clone_and_boxes():
    a = scene(4, 256, 320)
    a[144:208, 192:256] = a[0:64, 0:64]
    assert P.local_clone(a)["boxes"] == [[0, 0, 64, 64], [192, 144, 256, 208]]
    assert P.local_clone(np.full((200, 200), 50, np.uint8)) is None
    page = np.full((600, 800), 255, np.uint8)
    page[50:250, 60:300] = 90
    page[300:500, 400:700] = 90
    page[560:570, 10:20] = 0
    assert P.component_boxes(page, 12000, 80) == [(52, 42, 308, 258), (392, 292, 708, 508)]
    assert P.content_box(np.full((9, 9), 255, np.uint8)) == (0, 0, 9, 9)


@pytest.fixture(scope="module")
def found(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("figures")
    a = scene(5)
    cloned = scene(8, 256, 320)
    cloned[144:208, 192:256] = cloned[0:64, 0:64]
    for name, pixels in {"a": a, "flipped": a[:, ::-1], "crop": a[20:150, 30:190], "other": scene(6), "cloned": cloned, "flat": np.full((100, 100), 255, np.uint8)}.items():
        (root / f"{name}.png").write_bytes(report.png(np.ascontiguousarray(pixels)))
    (root / "broken.png").write_bytes(b"no")
    return I.panels(I.register_images(spark, str(root))).persist()


def test_panels_and_findings(spark, found, tmp_path):
    name = {r.panel_id: r.source_path.rsplit("/", 1)[-1][:-4] for r in found.collect()}
    assert sorted(name.values()) == ["a", "cloned", "crop", "flipped", "other"]
    pairs = I.candidate_pairs(found)
    assert pairs.count() == 10
    scored = I.score_pairs(found, pairs).where("score >= 60")
    got = {frozenset((name[r.panel_id_a], name[r.panel_id_b])): r.match_type for r in scored.collect()}
    assert got[frozenset(("a", "flipped"))] == "transformed_reuse" and got[frozenset(("a", "crop"))] == "cropped_reuse" and not any("other" in k for k in got)
    both = scored.unionByName(I.local_clones(found), allowMissingColumns=True)
    ranked = I.normalize_images(both)
    rows = ranked.orderBy("normalized_rank").collect()
    assert {r.risk_tier for r in rows if r.match_type == "local_clone"} == {"High"} and rows[0].risk_tier == "High"
    text = report.render_images(ranked, found, str(tmp_path))
    assert "transformed_reuse" in text and list((tmp_path / "evidence").glob("*.svg")) and I.normalize_images(both, "High").count() <= len(rows)


def drawn(seed, h=240, w=300):
    """Boxes and ellipses at all angles, a little blurred and noisy."""
    rng = np.random.default_rng(seed)
    img = np.full((h, w), rng.integers(150, 230), float)
    yy, xx = np.mgrid[0:h, 0:w]
    for _ in range(60):
        y, x, t, v = rng.integers(0, h), rng.integers(0, w), rng.random() * np.pi, rng.integers(0, 230)
        one, two = rng.integers(4, 28, 2)
        u, q = (xx - x) * np.cos(t) + (yy - y) * np.sin(t), (yy - y) * np.cos(t) - (xx - x) * np.sin(t)
        img[(np.abs(u) < one) & (np.abs(q) < two) if rng.random() < 0.5 else (u / one) ** 2 + (q / two) ** 2 < 1] = v
    return np.clip(K.blurred(img, 0.7) + rng.normal(0, 3, (h, w)), 0, 255).astype(np.uint8)


def warped(gray, degrees=0.0, scale=1.0, mirror=False, seed=0):
    """Turned and scaled on white, by bilinear interpolation, with noise of its own."""
    g = (gray[:, ::-1] if mirror else gray).astype(float)
    h, w = g.shape
    c, s = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))
    height, width = int(scale * (abs(h * c) + abs(w * s))), int(scale * (abs(w * c) + abs(h * s)))
    yy, xx = np.mgrid[0:height, 0:width]
    dx, dy = (xx - width / 2) / scale, (yy - height / 2) / scale
    x, y = dx * c + dy * s + w / 2, -dx * s + dy * c + h / 2
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    inside = (x0 >= 0) & (y0 >= 0) & (x0 < w - 1) & (y0 < h - 1)
    fx, fy = x - x0, y - y0
    x0, y0 = np.clip(x0, 0, w - 2), np.clip(y0, 0, h - 2)
    v = g[y0, x0] * (1 - fx) * (1 - fy) + g[y0, x0 + 1] * fx * (1 - fy) + g[y0 + 1, x0] * (1 - fx) * fy + g[y0 + 1, x0 + 1] * fx * fy
    return np.clip(np.where(inside, v, 255) + np.random.default_rng(seed).normal(0, 3, v.shape) * inside, 0, 255).astype(np.uint8)


def turned(m):
    return m["ransac_inliers"] >= 18 and m["inlier_ratio"] >= 0.35


@pytest.mark.parametrize("how,kind", [({"degrees": 20}, "rotate_affine"), ({"degrees": 137}, "rotate_affine"), ({"scale": 0.6}, "scale_affine"), ({"scale": 1.4}, "scale_affine"), ({"degrees": 33, "scale": 0.8}, "scale_affine"), ({"mirror": True}, "flip_affine"), ({"mirror": True, "degrees": 50}, "flip_affine")])
def test_maps_between_corners(how, kind):
    """Recall over scenes that no threshold was chosen on, and the map itself."""
    got = []
    for seed in range(500, 510):
        a = drawn(seed)
        one, two = K.described(a), K.described(warped(a, seed=seed, **how))
        m = K.matched(one, two)
        assert m == K.matched(one, two)
        got.append(turned(m) and m["feature_transform"] == kind and abs(m["scale_x"] - how.get("scale", 1)) < 0.03)
    assert sum(got) >= 9
    sign = np.sign(np.linalg.det(np.array(m["matrix"])[:, :2]))
    assert sign == (-1 if how.get("mirror") else 1)


def test_other_scenes_have_no_map():
    found = [K.described(drawn(s)) for s in range(600, 612)]
    assert not any(turned(K.matched(a, b)) for i, a in enumerate(found) for b in found[i + 1 :])
    nothing = K.described(np.full((90, 90), 200, np.uint8))
    assert K.matched(nothing, found[0]) == K.NOTHING and K.matched(K.described(drawn(1, 20, 25)), found[0]) == K.NOTHING


def test_transformed_reuse(spark, tmp_path):
    """Turned, scaled and mirrored panels come out as such, with where they are from."""
    a, other = drawn(700), drawn(701)
    for name, pixels in {"a": a, "turned": warped(a, 40, seed=1), "scaled": warped(a, 75, 0.7, seed=2), "mirrored": warped(a, 25, mirror=True, seed=3), "other": other}.items():
        (tmp_path / f"{name}.png").write_bytes(report.png(pixels))
    found = I.panels(I.register_images(spark, str(tmp_path)), folder="work/panels").persist()
    scored = I.score_pairs(found, I.candidate_pairs(found)).collect()
    name = lambda path: path.rsplit("/", 1)[-1][:-4]
    got = {frozenset((name(r.source_a), name(r.source_b))): r for r in scored}
    assert len(got) == 10
    for other_name in ("turned", "scaled", "mirrored"):
        r = got[frozenset(("a", other_name))]
        assert r.match_type == "transformed_reuse" and r.score > 74 and r.transform.endswith("_affine"), other_name
        assert r.panel_path_a == f"work/panels/{r.panel_id_a}.png" and r.figure_id_b == "" and r.page_a is None
    assert not any(r.match_type == "transformed_reuse" for k, r in got.items() if "other" in k)
    ranked = I.normalize_images(I.score_pairs(found, I.candidate_pairs(found)).where("score >= 60")).collect()
    assert {r.risk_tier for r in ranked if r.match_type == "transformed_reuse"} == {"High"}
    found.unpersist()


def test_candidate_limits_beyond_eighty(spark, found, monkeypatch):
    monkeypatch.setattr(C, "EXHAUSTIVE", 2)
    assert I.candidate_pairs(found).count() <= 10 and I.candidate_pairs(found, max_pairs=1).count() == 1
