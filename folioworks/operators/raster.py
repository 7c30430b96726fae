"""Pixels and polygons of line detection, vectorized per image: text regions of a probability map, and crops of them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Thresholds of a text pixel and of a region's mean, growth of a region, and the least side.
PIXEL, REGION, GROWTH, LEAST = 0.3, 0.6, 1.5, 3


def labelled(mask: np.ndarray) -> np.ndarray:
    """Numbers of the 8-connected regions of a mask, 0 outside; by runs per row and union of touching runs."""
    h, w = mask.shape
    padded = np.zeros((h, w + 2), np.int8)
    padded[:, 1:-1] = mask
    step = np.diff(padded, axis=1)
    row, start = np.nonzero(step == 1)
    _, end = np.nonzero(step == -1)
    root = np.arange(len(row))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    first = np.searchsorted(row, np.arange(h + 1))
    for y in range(1, h):
        a, b = first[y - 1], first[y]
        i, j = a, b
        while i < b and j < first[y + 1]:
            if start[i] <= end[j] and start[j] <= end[i]:
                x, z = find(i), find(j)
                root[max(x, z)] = min(x, z)
            if end[i] < end[j]:
                i += 1
            else:
                j += 1
    out = np.zeros((h, w), np.int32)
    names: dict[int, int] = {}
    for k in range(len(row)):
        out[row[k], start[k] : end[k]] = names.setdefault(find(k), len(names) + 1)
    return out


def hull(points: np.ndarray) -> np.ndarray:
    """The convex hull, by monotone chains."""
    pts = sorted(set(map(tuple, points.tolist())))
    if len(pts) < 3:
        return np.array(pts, float)

    def half(seq):
        out: list = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(pts) + half(pts[::-1]), float)


def least_rectangle(points: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Corners (from the upper left, clockwise), width and height of the rectangle of least area around points; one of its
    sides lies along the hull."""
    h = hull(points)
    if len(h) < 2:
        return np.repeat(h, 4, axis=0), 0.0, 0.0
    edges = np.roll(h, -1, axis=0) - h
    best = None
    for angle in np.unique(np.round(np.arctan2(edges[:, 1], edges[:, 0]) % (np.pi / 2), 9)):
        turn = np.array([[np.cos(angle), np.sin(angle)], [-np.sin(angle), np.cos(angle)]])
        r = h @ turn.T
        low, high = r.min(axis=0), r.max(axis=0)
        area = float(np.prod(high - low))
        if best is None or area < best[0] - 1e-9:
            best = area, np.array([low, (high[0], low[1]), high, (low[0], high[1])]) @ turn
    box = best[1]
    left = box[np.argsort(box[:, 0], kind="stable")]
    a, d = left[:2][np.argsort(left[:2, 1], kind="stable")]
    b, c = left[2:][np.argsort(left[2:, 1], kind="stable")]
    out = np.array([a, b, c, d])
    return out, float(np.hypot(*(b - a))), float(np.hypot(*(d - a)))


def grown(box: np.ndarray, ratio: float = GROWTH) -> np.ndarray:
    """A rectangle moved outwards by area * ratio / perimeter on all sides."""
    centre = box.mean(axis=0)
    across, down = box[1] - box[0], box[3] - box[0]
    w, h = np.hypot(*across), np.hypot(*down)
    if not w or not h:
        return box
    d = w * h * ratio / (2 * (w + h))
    return centre + (box - centre) @ np.linalg.inv(np.array([across / w, down / h])) * [(w + 2 * d) / w, (h + 2 * d) / h] @ np.array([across / w, down / h])


def inside(box: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """The pixels of a convex polygon."""
    y, x = np.mgrid[: shape[0], : shape[1]]
    side = [(b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) for a, b in zip(box, np.roll(box, -1, axis=0), strict=True)]
    return np.logical_and.reduce([s >= -1e-6 for s in side]) | np.logical_and.reduce([s <= 1e-6 for s in side])


def text_boxes(probabilities: np.ndarray) -> list[tuple[list[list[float]], float]]:
    """Quadrilaterals and mean probabilities of the text regions of a map, grown and held within it."""
    h, w = probabilities.shape
    regions = labelled(probabilities > PIXEL)
    out = []
    for n in range(1, int(regions.max(initial=0)) + 1):
        y, x = np.nonzero(regions == n)
        box, wide, high = least_rectangle(np.column_stack([x, y]))
        if min(wide, high) + 1 < LEAST:
            continue
        score = float(probabilities[inside(box, (h, w))].mean())
        if score >= REGION:
            quad = np.clip(grown(box), 0, [w - 1, h - 1])
            out.append((quad.tolist(), score))
    return out


def resized(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear, with pixel centres in place."""
    h, w = image.shape[:2]
    y = np.clip((np.arange(height) + 0.5) * h / height - 0.5, 0, h - 1)
    x = np.clip((np.arange(width) + 0.5) * w / width - 0.5, 0, w - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0).reshape(-1, 1, *[1] * (image.ndim - 2)), (x - x0).reshape(1, -1, *[1] * (image.ndim - 2))
    i = image.astype(float)
    top = i[y0][:, x0] * (1 - fx) + i[y0][:, x1] * fx
    low = i[y1][:, x0] * (1 - fx) + i[y1][:, x1] * fx
    return top * (1 - fy) + low * fy


def perspective(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The 3 by 3 matrix that takes four source points to four target points."""
    rows, right = [], []
    for (x, y), (u, v) in zip(source, target, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    return np.append(np.linalg.solve(np.array(rows, float), np.array(right, float)), 1).reshape(3, 3)


def cropped(image: np.ndarray, quad: np.ndarray) -> np.ndarray:
    """A quadrilateral of an image as an upright rectangle; tall ones are turned."""
    quad = np.asarray(quad, float)
    w = max(1, int(round(max(np.hypot(*(quad[1] - quad[0])), np.hypot(*(quad[2] - quad[3]))))))
    h = max(1, int(round(max(np.hypot(*(quad[3] - quad[0])), np.hypot(*(quad[2] - quad[1]))))))
    back = perspective(np.array([[0, 0], [w, 0], [w, h], [0, h]]), quad)
    y, x = np.mgrid[:h, :w]
    p = back @ np.vstack([x.ravel(), y.ravel(), np.ones(w * h)])
    sx, sy = np.clip(p[0] / p[2], 0, image.shape[1] - 1), np.clip(p[1] / p[2], 0, image.shape[0] - 1)
    x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
    x1, y1 = np.minimum(x0 + 1, image.shape[1] - 1), np.minimum(y0 + 1, image.shape[0] - 1)
    weight = lambda f: f.reshape(-1, *[1] * (image.ndim - 2))
    fx, fy = weight(sx - x0), weight(sy - y0)
    i = image.astype(float)
    out = (i[y0, x0] * (1 - fx) + i[y0, x1] * fx) * (1 - fy) + (i[y1, x0] * (1 - fx) + i[y1, x1] * fx) * fy
    out = out.reshape(h, w, *image.shape[2:])
    return np.rot90(out) if h >= 1.5 * w else out


BOX = T.StructType([T.StructField("quad", T.ArrayType(T.ArrayType(T.DoubleType()))), T.StructField("score", T.DoubleType())])


@F.pandas_udf(T.ArrayType(BOX))
def detected(probabilities: pd.Series) -> pd.Series:
    """Text boxes of probability maps (arrays of rows)."""
    return pd.Series([[{"quad": q, "score": s} for q, s in text_boxes(np.array([list(r) for r in m], float))] if m is not None and len(m) else [] for m in probabilities])
