"""Pixel kernels on 2-d uint8 arrays. They know nothing of Spark; operators.images runs them in Arrow batches."""

from __future__ import annotations

import numpy as np


def luma(bgr: np.ndarray) -> np.ndarray:
    """Gray of a height x width x 3 (or 4, or 1) array in the order blue, green, red."""
    if bgr.ndim == 2:
        return bgr
    if bgr.shape[2] == 1:
        return bgr[:, :, 0]
    b, g, r = (bgr[:, :, i].astype(np.float64) for i in range(3))
    return np.clip(np.rint(0.114 * b + 0.587 * g + 0.299 * r), 0, 255).astype(np.uint8)


def _cover(n: int, m: int) -> np.ndarray:
    """m x n weights: the share of each of n pixels in each of m equal stretches."""
    edges = np.linspace(0, n, m + 1)
    lo, hi = edges[:-1, None], edges[1:, None]
    at = np.arange(n)[None, :]
    return np.clip(np.minimum(hi, at + 1) - np.maximum(lo, at), 0, None) / (hi - lo)


def resize(gray: np.ndarray, width: int, height: int) -> np.ndarray:
    """Area means, rounded."""
    out = _cover(gray.shape[0], height) @ gray.astype(np.float64) @ _cover(gray.shape[1], width).T
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def _packed(bits: np.ndarray) -> int:
    """64 bits, the first one highest, as a signed long."""
    return int(np.packbits(bits.ravel()[:64]).view(">i8")[0])


def dhash(gray: np.ndarray) -> int:
    small = resize(gray, 9, 8)
    return _packed(small[:, 1:] > small[:, :-1])


def dct_basis(n: int) -> np.ndarray:
    k = np.arange(n)
    basis = np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / (2 * n)) * np.sqrt(2 / n)
    basis[0] /= np.sqrt(2)
    return basis


_DCT = dct_basis(32)


def phash(gray: np.ndarray) -> int:
    block = (_DCT @ resize(gray, 32, 32).astype(np.float64) @ _DCT.T)[:8, :8]
    return _packed(block > np.median(block[1:, 1:]))


def edges(gray: np.ndarray, low: int = 60, high: int = 160) -> np.ndarray:
    """Canny edges: Sobel gradients, thinning along the gradient, hysteresis."""
    g = np.pad(gray.astype(np.int32), 1, mode="edge")
    gx = (g[:-2, 2:] + 2 * g[1:-1, 2:] + g[2:, 2:]) - (g[:-2, :-2] + 2 * g[1:-1, :-2] + g[2:, :-2])
    gy = (g[2:, :-2] + 2 * g[2:, 1:-1] + g[2:, 2:]) - (g[:-2, :-2] + 2 * g[:-2, 1:-1] + g[:-2, 2:])
    size = np.abs(gx) + np.abs(gy)
    p = np.pad(size, 1)
    at = lambda dy, dx: p[1 + dy : p.shape[0] - 1 + dy, 1 + dx : p.shape[1] - 1 + dx]
    steep = np.abs(gy) > 2.414 * np.abs(gx)
    flat = np.abs(gy) < 0.414 * np.abs(gx)
    same = (gx >= 0) == (gy >= 0)
    one = np.where(flat, at(0, -1), np.where(steep, at(-1, 0), np.where(same, at(-1, -1), at(-1, 1))))
    two = np.where(flat, at(0, 1), np.where(steep, at(1, 0), np.where(same, at(1, 1), at(1, -1))))
    thin = (size > one) & (size >= two)
    weak, strong = thin & (size > low), thin & (size > high)
    while True:
        grown = np.pad(strong, 1)
        near = np.zeros_like(strong)
        for dy in range(3):
            for dx in range(3):
                near |= grown[dy : dy + strong.shape[0], dx : dx + strong.shape[1]]
        new = weak & near
        if (new == strong).all():
            return new
        strong = new


def edge_histogram(gray: np.ndarray) -> np.ndarray:
    found = edges(resize(gray, 160, 160)).astype(np.float32) * 255
    both = np.concatenate([found.sum(axis=0), found.sum(axis=1)])
    norm = np.linalg.norm(both)
    return both / norm if norm else both


def ncc(a: np.ndarray, b: np.ndarray) -> float:
    a, b = a.astype(np.float64) - a.mean(), b.astype(np.float64) - b.mean()
    return float((a * b).sum() / max(np.sqrt((a * a).sum() * (b * b).sum()), 1e-9))


def _means(x: np.ndarray, n: int) -> np.ndarray:
    s = np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    return (s[n:, n:] - s[:-n, n:] - s[n:, :-n] + s[:-n, :-n]) / (n * n)


def ssim(a: np.ndarray, b: np.ndarray, window: int = 7) -> float:
    """Mean structural similarity over windows that lie inside; 0 for images smaller than one."""
    if min(a.shape + b.shape) < window:
        return 0.0
    a, b = a.astype(np.float64), b.astype(np.float64)
    n = window * window
    ma, mb = _means(a, window), _means(b, window)
    va, vb, vab = ((_means(x * y, window) - m) * n / (n - 1) for x, y, m in ((a, a, ma * ma), (b, b, mb * mb), (a, b, ma * mb)))
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    return float(((2 * ma * mb + c1) * (2 * vab + c2) / ((ma**2 + mb**2 + c1) * (va + vb + c2))).mean())


#: Sizes at which a template is tried.
SCALES = (0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 1.0, 1.1, 1.25, 1.4, 1.6)


def correlations(large: np.ndarray, small: np.ndarray) -> np.ndarray:
    """Normalised correlation of small at each place in large, by FFT."""
    h, w = small.shape
    t = small.astype(np.float64) - small.mean()
    x = large.astype(np.float64)
    shape = large.shape
    cross = np.fft.irfft2(np.fft.rfft2(x) * np.conj(np.fft.rfft2(t, shape)), shape)[: shape[0] - h + 1, : shape[1] - w + 1]

    def sums(y: np.ndarray) -> np.ndarray:
        s = np.pad(y.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
        return s[h:, w:] - s[:-h, w:] - s[h:, :-w] + s[:-h, :-w]

    spread = np.clip(sums(x * x) - sums(x) ** 2 / (h * w), 0, None)
    return cross / np.maximum(np.sqrt(spread * (t * t).sum()), 1e-9)


def template(a: np.ndarray, b: np.ndarray) -> dict:
    """The smaller image in the larger one: best correlation over the scales."""
    a_larger = a.size > b.size
    small, large = (b, a) if a_larger else (a, b)
    best = {"ncc": 0.0, "direction": "b_in_a" if a_larger else "a_in_b", "bbox": None, "scale": 1.0}
    if min(small.shape) < 40:
        return best
    top = -1.0
    for scale in SCALES:
        h, w = round(small.shape[0] * scale), round(small.shape[1] * scale)
        if h >= large.shape[0] or w >= large.shape[1] or min(h, w) < 32:
            continue
        found = correlations(large, resize(small, w, h))
        y, x = np.unravel_index(int(found.argmax()), found.shape)
        if found[y, x] > top:
            top = float(found[y, x])
            best |= {"ncc": max(0.0, round(top, 4)), "bbox": [int(x), int(y), int(x) + w, int(y) + h], "scale": scale}
    return best


def whole(a: np.ndarray, b: np.ndarray) -> tuple[float, float, str]:
    """(ncc, ssim, orientation) at 256 x 256, b as it is or flipped."""
    a, b = resize(a, 256, 256), resize(b, 256, 256)
    turned = {"normal": b, "flip_horizontal": b[:, ::-1], "flip_vertical": b[::-1], "flip_both": b[::-1, ::-1]}
    scores = {k: ncc(a, v) for k, v in turned.items()}
    best = max(scores, key=scores.get)
    return scores[best], ssim(a, turned[best]), best


def patches(gray: np.ndarray, size: int = 64, stride: int = 48) -> tuple[np.ndarray, np.ndarray]:
    """Normalised 16 x 16 thumbnails and corners of patches with structure."""
    found, corners = [], []
    if min(gray.shape) >= 2 * size:
        for y in range(0, gray.shape[0] - size + 1, stride):
            for x in range(0, gray.shape[1] - size + 1, stride):
                block = gray[y : y + size, x : x + size]
                if block.std() < 8:
                    continue
                small = resize(block, 16, 16).astype(np.float64)
                small -= small.mean()
                norm = np.linalg.norm(small)
                if norm:
                    found.append((small / norm).ravel())
                    corners.append((x, y))
    return np.array(found).reshape(-1, 256), np.array(corners, dtype=int).reshape(-1, 2)


def local_clone(gray: np.ndarray, size: int = 64, least: float = 0.96) -> dict | None:
    """The most similar two patches of an image that hardly overlap."""
    found, corners = patches(gray, size)
    best = None
    for i in range(len(found) - 1):
        apart = np.clip(size - np.abs(corners[i + 1 :] - corners[i]), 0, None).prod(axis=1) <= 0.1 * size * size
        similar = np.where(apart, found[i + 1 :] @ found[i], -1.0)
        j = int(similar.argmax())
        if similar[j] > max(least, best["similarity"] if best else 0.0):
            boxes = [[int(x), int(y), int(x) + size, int(y) + size] for x, y in (corners[i], corners[i + 1 + j])]
            best = {"similarity": round(float(similar[j]), 4), "boxes": boxes}
    return best


def content_box(gray: np.ndarray, margin: int = 8) -> tuple[int, int, int, int]:
    """What isn't white, with a margin; the whole image if that is next to nothing."""
    ink = gray < 248
    h, w = gray.shape
    if ink.sum() < 50:
        return 0, 0, w, h
    ys, xs = np.flatnonzero(ink.any(axis=1)), np.flatnonzero(ink.any(axis=0))
    return max(int(xs[0]) - margin, 0), max(int(ys[0]) - margin, 0), min(int(xs[-1]) + margin + 1, w), min(int(ys[-1]) + margin + 1, h)


def _spread(mask: np.ndarray, n: int) -> np.ndarray:
    """Dilation by an n x n square."""
    for axis in (0, 1):
        total = np.pad(mask.astype(np.int32), [(n // 2 + 1, n // 2) if a == axis else (0, 0) for a in (0, 1)]).cumsum(axis)
        lead = [slice(None), slice(None)]
        lag = [slice(None), slice(None)]
        lead[axis], lag[axis] = slice(n, None), slice(None, -n)
        mask = total[tuple(lead)] > total[tuple(lag)]
    return mask


def component_boxes(gray: np.ndarray, least_area: int, most: int) -> list[tuple[int, int, int, int]]:
    """Boxes of large connected parts, gaps of up to 25 pixels closed, from the top."""
    mask = gray < 245
    mask = ~_spread(~np.pad(_spread(np.pad(mask, 12), 25), 12, constant_values=True), 25)[24:-24, 24:-24] if mask.size else mask
    h, w = mask.shape
    label: dict[int, int] = {}

    def find(x: int) -> int:
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    boxes: dict[int, list[int]] = {}
    before: list[tuple[int, int, int]] = []
    number = 0
    for y in range(h):  # runs of a line are joined with those of the line above that they touch
        edge = np.flatnonzero(np.diff(np.concatenate([[0], mask[y].astype(np.int8), [0]])))
        now = []
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            label[number] = number
            boxes[number] = [a, y, b, y + 1]
            for c, d, other in before:
                if c <= b and a <= d:
                    x, z = find(number), find(other)
                    if x != z:
                        label[x] = z
            now.append((a, b, number))
            number += 1
        before = now
    merged: dict[int, list[int]] = {}
    for k, (x0, y0, x1, y1) in boxes.items():
        m = merged.setdefault(find(k), [x0, y0, x1, y1])
        m[:] = [min(m[0], x0), min(m[1], y0), max(m[2], x1), max(m[3], y1)]
    out = []
    for x0, y0, x1, y1 in merged.values():
        bw, bh = x1 - x0, y1 - y0
        if bw * bh >= least_area and bw >= 80 and bh >= 80 and not (bw > 0.96 * w and bh > 0.96 * h):
            out.append((max(x0 - 8, 0), max(y0 - 8, 0), min(x1 + 8, w), min(y1 + 8, h)))
    return sorted(out, key=lambda b: (b[1], b[0]))[:most]


def informative(gray: np.ndarray) -> bool:
    return min(gray.shape) >= 64 and float((gray < 245).mean()) > 0.03 and float(gray.std()) > 3.0
