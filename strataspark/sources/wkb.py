"""Bounds and centroids of WKB geometries, a whole Arrow batch at a time.

Reads both byte orders, the seven types with Z, M and ZM flags (ISO thousands and the high bits of EWKB, with or without SRID).
Null, empty and malformed geometries give nulls. A centroid follows the dimension of the geometry: by area, else length, else points.

The decoder walks all geometries of a batch side by side: each has a place in the batch's bytes, and a round reads one header, ring or
list of coordinates of every geometry that is not done, in numpy. What it finds are runs of coordinates (where they begin, how many,
how wide), which are then read in one step and reduced by geometry. Rounds are as many as the parts of the batch's most divided
geometry; no Python call is made per geometry.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEPTH = 16  # collections in collections


class Runs(NamedTuple):
    """Runs of coordinates, by geometry: its number, dimension (0, 1, 2), first byte, coordinates, numbers a coordinate, byte order, and
    whether it is a hole. A polygon's first ring is its shell, the others are holes, whichever way they turn."""

    row: np.ndarray
    dim: np.ndarray
    start: np.ndarray
    count: np.ndarray
    width: np.ndarray
    big: np.ndarray
    hole: np.ndarray


def _numbers(data: np.ndarray, at: np.ndarray, big: np.ndarray, kind: str) -> np.ndarray:
    """Numbers of a type at any places of the bytes, each in its own order."""
    size = np.dtype(kind).itemsize
    raw = np.lib.stride_tricks.sliding_window_view(data, size)[at]
    raw[big] = raw[big, ::-1]
    return np.ascontiguousarray(raw).view(f"<{kind}").ravel()


def decode(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[Runs, np.ndarray]:
    """The runs of the geometries at ``first`` to ``last`` of the bytes, in order, and which geometries are malformed."""
    n = len(first)
    data = np.concatenate([data, np.zeros(16, dtype=np.uint8)])
    at, depth = first.astype(np.int64), np.zeros(n, dtype=np.int64)
    left = np.zeros((n, DEPTH), dtype=np.int64)  # geometries to come, by depth
    left[:, 0] = 1
    rings, hole = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
    width, big, bad = np.full(n, 2), np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    found: list[tuple[np.ndarray, ...]] = []

    def fits(rows: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        """The rows that have so many bytes left; the others are malformed."""
        ok = at[rows] + size <= last[rows]
        bad[rows[~ok]] = True
        return ok

    def counts(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = rows[fits(rows, 4)]
        c = _numbers(data, at[rows], big[rows], "u4").astype(np.int64)
        at[rows] += 4
        return rows, c

    def run(rows: np.ndarray, c: np.ndarray, dim: int, inner: np.ndarray) -> None:
        ok = fits(rows, 8 * c * width[rows])
        rows, c, inner = rows[ok], c[ok], inner[ok]
        found.append((rows, np.full(len(rows), dim), at[rows], c, width[rows], big[rows], inner))
        at[rows] += 8 * c * width[rows]

    active = np.arange(n)
    while len(active):
        in_ring = rings[active] > 0
        rows, c = counts(active[in_ring])
        run(rows, c, 2, hole[rows])
        rings[rows] -= 1
        hole[rows] = True
        rows = active[~in_ring]
        done = left[rows, depth[rows]] == 0
        depth[rows[done]] -= 1
        rows = rows[~done]
        left[rows, depth[rows]] -= 1
        rows = rows[fits(rows, 5)]
        big[rows] = data[at[rows]] == 0
        code = _numbers(data, at[rows] + 1, big[rows], "u4").astype(np.int64)
        at[rows] += 5 + 4 * ((code & 0x20000000) != 0)
        kind = code & 0xFFFF
        z = ((code & 0x80000000) != 0) | np.isin(kind // 1000, (1, 3))
        m = ((code & 0x40000000) != 0) | np.isin(kind // 1000, (2, 3))
        width[rows] = 2 + z + m
        kind = kind % 1000
        bad[rows[(kind < 1) | (kind > 7)]] = True
        points = rows[kind == 1]
        run(points, np.ones(len(points), dtype=np.int64), 0, np.zeros(len(points), dtype=bool))
        lines, c = counts(rows[kind == 2])
        run(lines, c, 1, np.zeros(len(lines), dtype=bool))
        polygons, c = counts(rows[kind == 3])
        ok = fits(polygons, 4 * c)
        rings[polygons[ok]], hole[polygons[ok]] = c[ok], False
        many, c = counts(rows[(kind >= 4) & (kind <= 7)])
        ok = fits(many, 5 * c)
        bad[many[depth[many] + 1 >= DEPTH]] = True
        many, c = many[ok & ~bad[many]], c[ok & ~bad[many]]
        depth[many] += 1
        left[many, depth[many]] = c
        active = active[~bad[active] & (depth[active] >= 0)]
    parts = [np.concatenate(x) for x in zip(*found)] if found else [np.empty(0, dtype=np.int64)] * 7
    order = np.argsort(parts[0], kind="stable")
    order = order[~bad[parts[0][order]]]
    return Runs(*(x[order] for x in parts)), bad


def summaries(geometries: pa.Array) -> np.ndarray:
    """(xmin, ymin, xmax, ymax, x, y) of every geometry, NaN where it has no coordinates or is malformed."""
    geometries = geometries.cast(pa.large_binary()).fill_null(b"")
    n = len(geometries)
    out = np.full((n, 6), np.nan)
    off = np.frombuffer(geometries.buffers()[1], dtype=np.int64)[geometries.offset : geometries.offset + n + 1] if n else np.zeros(1, dtype=np.int64)
    raw = geometries.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[off[0] : off[-1]] if raw is not None else np.empty(0, dtype=np.uint8)
    some = np.flatnonzero(np.diff(off) > 0)
    runs, _ = decode(data, off[:-1][some] - off[0], off[1:][some] - off[0])
    run = np.repeat(np.arange(len(runs.row)), runs.count)
    if not len(run):
        return out
    step = np.arange(len(run)) - np.repeat(np.cumsum(runs.count) - runs.count, runs.count)
    place, big = runs.start[run] + 8 * runs.width[run] * step, runs.big[run]
    padded = np.concatenate([data, np.zeros(16, dtype=np.uint8)])
    x, y = _numbers(padded, place, big, "f8"), _numbers(padded, place + 8, big, "f8")
    good = ~(np.isnan(x) | np.isnan(y))
    x, y, run = x[good], y[good], run[good]
    if not len(run):
        return out
    row = runs.row[run]
    have, begin = np.unique(row, return_index=True)
    for k, (v, least) in enumerate(((x, np.minimum), (y, np.minimum), (x, np.maximum), (y, np.maximum))):
        out[some[have], k] = least.reduceat(v, begin)

    # Sums over a run, then over a geometry; coordinates are taken from the geometry's first one.
    with np.errstate(all="ignore"):
        size = np.diff(np.append(begin, len(x)))
        u, v = x - np.repeat(x[begin], size), y - np.repeat(y[begin], size)
        pair = np.flatnonzero(run[1:] == run[:-1])
        edge, ux, uy, vx, vy = run[pair], u[pair], v[pair], u[pair + 1], v[pair + 1]
        per_run = lambda w: np.bincount(edge, weights=w, minlength=len(runs.row))
        per_row = lambda w: np.bincount(runs.row, weights=w, minlength=len(some))[have]
        cross, ring = ux * vy - vx * uy, runs.dim == 2
        area = per_run(cross)
        turn = np.where(ring, np.sign(area) * np.where(runs.hole, -1, 1), 0)
        weight = per_row(turn * area / 2)
        length = np.where(runs.dim[edge] >= 1, np.hypot(vx - ux, vy - uy), 0.0)
        by_area = [per_row(turn * per_run((p + q) * cross)) / 6 / weight for p, q in ((ux, vx), (uy, vy))]
        total = per_row(per_run(length))
        by_length = [per_row(per_run((p + q) / 2 * length)) / total for p, q in ((ux, vx), (uy, vy))]
        mean = [np.add.reduceat(w, begin) / size for w in (u, v)]
        for k, at in enumerate((x[begin], y[begin])):
            out[some[have], 4 + k] = at + np.where(weight != 0, by_area[k], np.where(total != 0, by_length[k], mean[k]))
    return out


def bbox_columns(df: DataFrame, geometry: str = "geometry", centroid: bool = False) -> DataFrame:
    """``df`` with bbox_xmin ... bbox_ymax (and centroid_x, centroid_y) of its WKB column. Columns of those names are replaced."""
    names = ["bbox_xmin", "bbox_ymin", "bbox_xmax", "bbox_ymax", "centroid_x", "centroid_y"][: 6 if centroid else 4]
    base = df.drop(*names)
    packed = base.select(F.struct("*").alias("row"), F.col(geometry).alias("g"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = summaries(b.column(1))
            none = np.isnan(got[:, 0])
            cols = [pa.array(got[:, i], type=pa.float64(), mask=none) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["row", *names])

    kind = packed.schema["row"].dataType.simpleString()
    return packed.mapInArrow(run, f"row {kind}, " + ", ".join(f"{n} double" for n in names)).select("row.*", *names)
