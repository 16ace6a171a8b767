"""Corners over scales, binary descriptors, and the partial affine map between two images' corners.

Everything is made of a panel's gray pixels with numpy: no Spark here, and no other library. Descriptors are taken twice, of the image as it is and of its
mirror image, at the same corners, so a pair is matched both ways without a second search for corners.
"""

from __future__ import annotations

import numpy as np

from plumbline.functions.pixels import resize

# A match is good if its distance is below this share of the next place's; so many good ones are needed; an inlier lies this near (pixels).
RATIO, FEWEST, REACH = 0.75, 6, 5.0
# Beyond these a map counts as scaled, or turned (degrees).
SCALED, TURNED = 0.08, 8.0
#: Longer images are searched at this size; levels of the pyramid, and corners of all levels, at most.
LONGEST, STEP, LEVELS, CORNERS = 720, 1.22, 9, 1000
#: Pixels about a corner that its direction and its bits come from.
RADIUS = 12
BITS = 256
#: Maps that are tried.
TRIALS = 1500

_rng = np.random.default_rng(20)
_PAIRS = np.clip(_rng.normal(0, RADIUS * 0.42, (BITS, 2, 2)), -RADIUS, RADIUS)
_DISC = np.array([(x, y) for y in range(-RADIUS, RADIUS + 1) for x in range(-RADIUS, RADIUS + 1) if x * x + y * y <= RADIUS * RADIUS])
_BORDER = int(np.ceil(RADIUS * np.sqrt(2))) + 2


def blurred(x: np.ndarray, sigma: float) -> np.ndarray:
    n = int(np.ceil(3 * sigma))
    k = np.exp(-0.5 * (np.arange(-n, n + 1) / sigma) ** 2)
    k /= k.sum()
    p = np.pad(x, n, mode="edge")
    rows = sum(w * p[i : i + x.shape[0]] for i, w in enumerate(k))
    return sum(w * rows[:, i : i + x.shape[1]] for i, w in enumerate(k))


def _corners(level: np.ndarray, most: int) -> np.ndarray:
    """(x, y) of the strongest corners: the smaller eigenvalue of the gradients' spread, largest within 5 x 5."""
    g = blurred(level, 1.0)
    gy, gx = np.gradient(g)
    a, b, c = (blurred(v, 1.6) for v in (gx * gx, gx * gy, gy * gy))
    strength = (a + c) / 2 - np.sqrt(((a - c) / 2) ** 2 + b * b)
    h, w = strength.shape
    if min(h, w) <= 2 * _BORDER:
        return np.empty((0, 2), dtype=np.int64)
    p = np.pad(strength, 2, constant_values=-1)
    around = np.maximum.reduce([p[:, i : i + w] for i in range(5)])
    around = np.maximum.reduce([around[i : i + h] for i in range(5)])
    peak = (strength >= around) & (strength > 1.0)
    peak[:_BORDER] = peak[-_BORDER:] = False
    peak[:, :_BORDER] = peak[:, -_BORDER:] = False
    y, x = np.nonzero(peak)
    order = np.lexsort((x, y, -strength[y, x]))[:most]
    return np.stack([x[order], y[order]], axis=1)


def _bits(level: np.ndarray, at: np.ndarray, mirrored: bool) -> np.ndarray:
    """Descriptors, packed: which of two places, turned to the corner's own direction, is darker."""
    flip = -1 if mirrored else 1
    near = level[at[:, 1, None] + _DISC[:, 1], at[:, 0, None] + flip * _DISC[:, 0]]
    angle = np.arctan2(near @ _DISC[:, 1], near @ _DISC[:, 0])
    cos, sin = np.cos(angle)[:, None], np.sin(angle)[:, None]
    values = []
    for side in (0, 1):
        px, py = _PAIRS[:, side, 0], _PAIRS[:, side, 1]
        x = np.rint(px * cos - py * sin).astype(np.int64) * flip
        y = np.rint(px * sin + py * cos).astype(np.int64)
        values.append(level[at[:, 1, None] + y, at[:, 0, None] + x])
    return np.packbits(values[0] < values[1], axis=1)


def described(gray: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, descriptors, descriptors of the mirror image): float32 x, y in the image's own pixels; 32 bytes each."""
    h, w = gray.shape
    base = min(1.0, LONGEST / max(h, w))
    places, plain, turned = [], [], []
    areas = [STEP ** (-2 * i) for i in range(LEVELS)]
    for i in range(LEVELS):
        scale = base / STEP**i
        lw, lh = round(w * scale), round(h * scale)
        if min(lw, lh) <= 2 * _BORDER:
            break
        level = (gray if (lw, lh) == (w, h) else resize(gray, lw, lh)).astype(np.float64)
        at = _corners(level, max(20, int(CORNERS * areas[i] / sum(areas))))
        if len(at):
            smooth = blurred(level, 2.0)
            places.append((at + 0.5) * [w / lw, h / lh])
            plain.append(_bits(smooth, at, False))
            turned.append(_bits(smooth, at, True))
    if not places:
        return np.empty((0, 2), np.float32), np.empty((0, BITS // 8), np.uint8), np.empty((0, BITS // 8), np.uint8)
    return np.concatenate(places).astype(np.float32), np.concatenate(plain), np.concatenate(turned)


def _good(bits_a: np.ndarray, bits_b: np.ndarray, places_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corners of a and their matches in b: far nearer than the best elsewhere (the same place at another level isn't elsewhere)."""
    a, b = (np.unpackbits(x, axis=1).astype(np.float32) * 2 - 1 for x in (bits_a, bits_b))
    distance = (BITS - a @ b.T) / 2
    best = distance.argmin(axis=1)
    nearest = distance[np.arange(len(a)), best]
    away = np.abs(places_b[best][:, None, :] - places_b[None, :, :]).max(axis=2) > 2 * REACH
    second = np.where(away, distance, np.float32(BITS)).min(axis=1)
    kept = np.flatnonzero(nearest < RATIO * second)
    return kept, best[kept]


def _mapped(a: np.ndarray, b: np.ndarray, seed: int) -> tuple[complex, complex, np.ndarray]:
    """(turn and scale, shift, inliers) of the map z -> s z + t that most pairs of places agree on."""
    n = len(a)
    rng = np.random.default_rng(seed)
    i, j = rng.integers(0, n, TRIALS), rng.integers(0, n, TRIALS)
    apart = np.abs(a[i] - a[j]) > 2 * REACH
    i, j = i[apart], j[apart]
    none = np.zeros(n, dtype=bool)
    if not len(i):
        return 1, 0, none
    s = (b[i] - b[j]) / (a[i] - a[j])
    sound = (np.abs(s) > 0.1) & (np.abs(s) < 10)
    s, t = s[sound], (b[i] - s * a[i])[sound]
    if not len(s):
        return 1, 0, none
    agree = np.array([np.count_nonzero(np.abs(x * a + y - b) <= REACH) for x, y in zip(s, t, strict=True)])
    top = int(agree.argmax())
    s, t = s[top], t[top]
    inside = np.abs(s * a + t - b) <= REACH
    for _ in range(3):  # least squares over the inliers, whose number may only grow
        za, zb = a[inside], b[inside]
        spread = (np.abs(za - za.mean()) ** 2).sum()
        if spread == 0:
            break
        s2 = ((zb - zb.mean()) * np.conj(za - za.mean())).sum() / spread
        t2 = zb.mean() - s2 * za.mean()
        again = np.abs(s2 * a + t2 - b) <= REACH
        if again.sum() < inside.sum():
            break
        s, t, inside = s2, t2, again
    return s, t, inside


NOTHING = {"keypoint_matches": 0, "ransac_inliers": 0, "inlier_ratio": 0.0, "feature_transform": "none", "matrix": None, "rotation_degrees": None, "scale_x": None, "scale_y": None}


def matched(one: tuple[np.ndarray, np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray, np.ndarray], seed: int = 0) -> dict:
    """The map from one image to another whose corners are ``described``, as it is or mirrored: whichever more corners agree on."""
    found = dict(NOTHING)
    if min(len(one[0]), len(two[0])) < FEWEST:
        return found
    for mirrored in (False, True):
        places = two[0] * np.float32([-1, 1]) if mirrored else two[0]
        i, j = _good(one[1], two[2] if mirrored else two[1], two[0])
        if len(i) < FEWEST:
            if not found["ransac_inliers"]:
                found["keypoint_matches"] = max(found["keypoint_matches"], len(i))
            continue
        a, b = (x[:, 0].astype(np.float64) + 1j * x[:, 1] for x in (one[0][i], places[j]))
        s, t, inside = _mapped(a, b, seed)
        n = int(inside.sum())
        if n <= found["ransac_inliers"]:
            continue
        flip = -1 if mirrored else 1
        matrix = [[flip * s.real, -flip * s.imag, flip * t.real], [s.imag, s.real, t.imag]]
        angle = float(np.degrees(np.arctan2(matrix[1][0], matrix[0][0])))
        kind = "affine"
        if mirrored:
            kind = "flip_affine"
        elif abs(abs(s) - 1) > SCALED:
            kind = "scale_affine"
        elif abs(angle) > TURNED:
            kind = "rotate_affine"
        found = {"keypoint_matches": len(i), "ransac_inliers": n, "inlier_ratio": round(n / len(i), 4), "feature_transform": kind, "matrix": [[float(x) for x in row] for row in matrix]}
        found |= {"rotation_degrees": round(angle, 2), "scale_x": round(float(abs(s)), 3), "scale_y": round(float(abs(s)), 3)}
    return found
