"""Ground surfaces that have no relational form: a triangulation and a cloth, a group of tiles in a task."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def triangulate(xy: np.ndarray) -> np.ndarray:
    """Delaunay triangles (m, 3) of distinct points, by insertion (Bowyer 1981, Watson 1981) from left to right.

    A triangle whose circle lies left of the sweep is final and isn't looked at again, so each point meets those near the
    sweep only.
    """
    n = len(xy)
    order = np.lexsort((xy[:, 1], xy[:, 0]))
    middle, span = (xy.min(0) + xy.max(0)) / 2, max(float(np.ptp(xy, axis=0).max()), 1.0)
    p = np.vstack([xy, middle + span * np.array([[-30, -10], [30, -10], [0, 30]])])

    def circles(t):
        a, b, c = p[t[:, 0]], p[t[:, 1]], p[t[:, 2]]
        d = 2 * ((a[:, 0] - c[:, 0]) * (b[:, 1] - c[:, 1]) - (b[:, 0] - c[:, 0]) * (a[:, 1] - c[:, 1]))
        aa, bb = ((a - c) ** 2).sum(1), ((b - c) ** 2).sum(1)
        centre = c + np.stack([(aa * (b - c)[:, 1] - bb * (a - c)[:, 1]) / d, (bb * (a - c)[:, 0] - aa * (b - c)[:, 0]) / d], 1)
        return centre, ((a - centre) ** 2).sum(1)

    triangles, final = np.array([[n, n + 1, n + 2]]), []
    centre, radius = circles(triangles)
    for i in order:
        past = centre[:, 0] + np.sqrt(radius) * (1 + 1e-9) < p[i, 0] - 1e-9 * span
        if past.any():
            final.append(triangles[past])
            triangles, centre, radius = triangles[~past], centre[~past], radius[~past]
        bad = ((p[i] - centre) ** 2).sum(1) < radius * (1 + 1e-12)
        edges = np.sort(triangles[bad][:, [[0, 1], [1, 2], [2, 0]]].reshape(-1, 2), axis=1)
        edges, times = np.unique(edges, axis=0, return_counts=True)
        rim = edges[times == 1]
        area = np.abs((p[rim[:, 1]] - p[rim[:, 0]])[:, 0] * (p[i] - p[rim[:, 0]])[:, 1] - (p[rim[:, 1]] - p[rim[:, 0]])[:, 1] * (p[i] - p[rim[:, 0]])[:, 0])
        new = np.column_stack([rim[area > 0], np.full(int((area > 0).sum()), i)])
        c, r = circles(new) if len(new) else (np.zeros((0, 2)), np.zeros(0))
        triangles, centre, radius = np.vstack([triangles[~bad], new]), np.vstack([centre[~bad], c]), np.concatenate([radius[~bad], r])
    found = np.vstack([*final, triangles])
    return found[(found < n).all(1)]


def in_triangles(corners: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, triangle) of places whose cell of a common lattice a triangle's box meets: few for each place."""
    low, high = corners.min(axis=(0, 1)), corners.max(axis=(0, 1))
    side = max(float((high - low).max()) / max(1.0, np.sqrt(len(corners))), 1e-9)
    cell = lambda v: np.clip(np.floor((v - low) / side).astype(np.int64), 0, None)
    first, last = cell(corners.min(axis=1)), cell(corners.max(axis=1))
    wide = int(last[:, 0].max()) + 1
    size = last - first + 1
    number = np.repeat(np.arange(len(corners)), size[:, 0] * size[:, 1])
    place = np.arange(len(number)) - np.repeat(np.cumsum(size[:, 0] * size[:, 1]) - size[:, 0] * size[:, 1], size[:, 0] * size[:, 1])
    key = (first[number, 1] + place // size[number, 0]) * wide + first[number, 0] + place % size[number, 0]
    order = np.argsort(key, kind="stable")
    key, number = key[order], number[order]
    some = np.flatnonzero(((at >= low) & (at <= high)).all(1))
    own = cell(at[some])
    own = own[:, 1] * wide + own[:, 0]
    begin, end = np.searchsorted(key, own), np.searchsorted(key, own, "right")
    n = end - begin
    return np.repeat(some, n), number[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def linear_surface(xy: np.ndarray, z: np.ndarray, at: np.ndarray, extrapolate: bool) -> np.ndarray:
    """z at the places by their triangle's plane; outside, the nearest point's z or NaN."""
    out = np.full(len(at), np.nan)
    xy, first = np.unique(xy, axis=0, return_index=True)
    z = z[first]
    if len(at) and len(xy) >= 3 and np.linalg.matrix_rank(xy - xy[0]) == 2:
        t = triangulate(xy)
        place, number = in_triangles(xy[t], at)
        a, b, c = (xy[t[number, i]] for i in range(3))
        v = at[place]
        d = (b[:, 1] - c[:, 1]) * (a[:, 0] - c[:, 0]) + (c[:, 0] - b[:, 0]) * (a[:, 1] - c[:, 1])
        p = ((b[:, 1] - c[:, 1]) * (v[:, 0] - c[:, 0]) + (c[:, 0] - b[:, 0]) * (v[:, 1] - c[:, 1])) / d
        q = ((c[:, 1] - a[:, 1]) * (v[:, 0] - c[:, 0]) + (a[:, 0] - c[:, 0]) * (v[:, 1] - c[:, 1])) / d
        inside = np.flatnonzero((p >= -1e-9) & (q >= -1e-9) & (p + q <= 1 + 1e-9))[::-1]
        k = t[number[inside]]
        out[place[inside]] = p[inside] * z[k[:, 0]] + q[inside] * z[k[:, 1]] + (1 - p - q)[inside] * z[k[:, 2]]
    if extrapolate and len(xy):
        for i in np.flatnonzero(np.isnan(out)):
            out[i] = z[((xy - at[i]) ** 2).sum(1).argmin()]
    return out


def height_above_triangulation(points: DataFrame, extrapolate: bool = True, ground_class: int = 2) -> DataFrame:
    """points with hag: z minus the ground triangulation's, by group_id. A group is a task's memory; null without ground."""
    schema = T.StructType([*[f for f in points.schema.fields if f.name != "hag"], T.StructField("hag", T.DoubleType())])

    def each(rows: pd.DataFrame) -> pd.DataFrame:
        ground = rows[rows["classification"] == ground_class]
        level = linear_surface(ground[["x", "y"]].to_numpy(float), ground["z"].to_numpy(float), rows[["x", "y"]].to_numpy(float), extrapolate)
        return rows.drop(columns="hag", errors="ignore").assign(hag=rows["z"].to_numpy(float) - level)

    return points.groupBy("group_id").applyInPandas(each, schema)


def cloth_ground(x: np.ndarray, y: np.ndarray, z: np.ndarray, resolution: float, rigidness: int, iterations: int, threshold: float, step: float = 0.65) -> np.ndarray:
    """Which points a cloth that falls on the turned-over cloud comes within threshold of (Zhang et al. 2016)."""
    col, row = ((v - v.min()) // resolution for v in (x, y))
    col, row = col.astype(int), row.astype(int)
    top = np.full((row.max() + 1, col.max() + 1), -np.inf)
    np.maximum.at(top, (row, col), -z)
    while np.isinf(top).any():  # cells without points take their neighbours' height
        padded = np.pad(top, 1, constant_values=-np.inf)
        around = np.stack([padded[:-2, 1:-1], padded[2:, 1:-1], padded[1:-1, :-2], padded[1:-1, 2:]])
        known = ~np.isinf(around)
        mean = np.where(known, around, 0).sum(0) / np.maximum(known.sum(0), 1)
        top = np.where(np.isinf(top) & known.any(0), mean, top)
    cloth = np.full(top.shape, top.max() + 1.0)
    before, free = cloth.copy(), np.ones(top.shape, bool)
    for _ in range(iterations):
        now = cloth + np.where(free, (cloth - before) * 0.99 - 9.8 * 0.01 * step**2, 0)
        before, cloth = cloth, now
        for _ in range(rigidness):
            for axis in (0, 1):
                a = [slice(None)] * 2
                b = [slice(None)] * 2
                a[axis], b[axis] = slice(None, -1), slice(1, None)
                gap = (cloth[tuple(b)] - cloth[tuple(a)]) / 2
                fa, fb = free[tuple(a)], free[tuple(b)]
                moved = cloth.copy()
                moved[tuple(a)] += np.where(fa, gap * np.where(fb, 0.5, 1.0), 0)
                moved[tuple(b)] -= np.where(fb, gap * np.where(fa, 0.5, 1.0), 0)
                cloth = moved
        hit = cloth <= top
        cloth = np.where(hit, top, cloth)
        free &= ~hit
        if np.abs(cloth - before).max() < 0.005:
            break
    return np.abs(-z - cloth[row, col]) <= threshold


def cloth_filter(points: DataFrame, resolution: float = 2.0, rigidness: int = 2, iterations: int = 1000, threshold: float = 0.5) -> DataFrame:
    """points with classification 2 for ground and 1 for the rest, by group_id. A group is a task's memory."""

    def each(rows: pd.DataFrame) -> pd.DataFrame:
        ground = cloth_ground(*(rows[c].to_numpy(float) for c in "xyz"), resolution, rigidness, iterations, threshold)
        return rows.assign(classification=np.where(ground, 2, 1).astype(rows["classification"].dtype))

    return points.groupBy("group_id").applyInPandas(each, points.schema)
