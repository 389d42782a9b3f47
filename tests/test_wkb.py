"""The columnar WKB decoder against a plain recursive one, on random geometries of all types, orders, flags and damages."""

import struct

import numpy as np
import pyarrow as pa

from strataspark.sources import wkb


def build(rng, depth=0):
    """A random geometry: (bytes, [(dimension, sign, points)])."""
    kind = int(rng.integers(1, 8 if depth < 3 else 4))
    order, flag = rng.choice(["<", ">"]), int(rng.integers(0, 6))
    z, m = ((0, 0), (1, 0), (0, 1), (1, 1), (1, 0), (0, 0))[flag]
    code = kind + (1000 * (z + 2 * m) if flag < 4 else 0)
    srid = b""
    if flag >= 4:
        code |= 0x80000000 * z | 0x20000000
        srid = struct.pack(order + "I", 4326)
    head = struct.pack(order + "BI", order == "<", code) + srid
    points = lambda n: [tuple(map(float, p)) for p in rng.integers(-20, 20, (n, 2))]
    raw = lambda ps: b"".join(struct.pack(f"{order}{2 + z + m}d", *p, *[9.0] * (z + m)) for p in ps)
    count = lambda n: struct.pack(order + "I", n)
    if kind == 1:
        p = points(1) if rng.random() < 0.8 else [(float("nan"), float("nan"))]
        return head + raw(p), [(0, 1, p)]
    if kind == 2:
        p = points(int(rng.integers(0, 5)))
        return head + count(len(p)) + raw(p), [(1, 1, p)]
    if kind == 3:
        rings = [points(int(rng.integers(0, 6))) for _ in range(int(rng.integers(0, 4)))]
        rings = [r + r[:1] for r in rings]
        return head + count(len(rings)) + b"".join(count(len(r)) + raw(r) for r in rings), [(2, -1 if i else 1, r) for i, r in enumerate(rings)]
    parts = [build(rng, depth + 1) for _ in range(int(rng.integers(0, 4)))]
    return head + count(len(parts)) + b"".join(p[0] for p in parts), [x for p in parts for x in p[1]]


def plain(parts):
    parts = [(d, s, [p for p in ps if p == p and not any(np.isnan(p))]) for d, s, ps in parts]
    parts = [p for p in parts if p[2]]
    if not parts:
        return [np.nan] * 6
    every = np.array([p for _, _, ps in parts for p in ps])
    box = [*every.min(axis=0), *every.max(axis=0)]
    o, area, cx, cy = every[0], 0.0, 0.0, 0.0
    for d, s, ps in parts:
        if d == 2:
            q = np.array(ps) - o
            cross = q[:-1, 0] * q[1:, 1] - q[1:, 0] * q[:-1, 1]
            cross = cross * s * np.sign(cross.sum())
            area += cross.sum() / 2
            cx += ((q[:-1, 0] + q[1:, 0]) * cross).sum() / 6
            cy += ((q[:-1, 1] + q[1:, 1]) * cross).sum() / 6
    if abs(area) > 1e-12:
        return [*box, cx / area + o[0], cy / area + o[1]]
    steps = [(np.hypot(*(np.array(b) - a)), (np.array(a) + b) / 2) for d, _, ps in parts if d for a, b in zip(ps, ps[1:])]
    total = sum(s for s, _ in steps)
    return [*box, *(sum(s * mid for s, mid in steps) / total if total else every.mean(axis=0))]


def test_random_geometries():
    rng = np.random.default_rng(12)
    made = [build(rng) for _ in range(3000)]
    got = wkb.summaries(pa.array([g for g, _ in made], pa.binary()))
    want = np.array([plain(p) for _, p in made])
    assert np.array_equal(got[:, :4], want[:, :4], equal_nan=True)
    assert np.allclose(got[:, 4:], want[:, 4:], atol=1e-6, equal_nan=True)


def test_damaged_geometries_do_no_harm_to_others():
    rng = np.random.default_rng(3)
    good = struct.pack("<BIdd", 1, 1, 3.0, 4.0)
    bad = [b"", None, b"\x01", struct.pack("<BI", 1, 99), struct.pack("<BII", 1, 2, 2**32 - 1), struct.pack("<BII", 1, 7, 2**31), struct.pack("<BII", 1, 6, 3) + good, good[:-1], b"".join(struct.pack("<BII", 1, 7, 1) for _ in range(40)) + good]
    for _ in range(400):
        g = bytearray(build(rng)[0])
        g[int(rng.integers(0, len(g)))] = int(rng.integers(0, 256))
        bad.append(bytes(g[: int(rng.integers(0, len(g) + 1))]))
    rows = [x for b in bad for x in (b, good)]
    got = wkb.summaries(pa.array(rows, pa.binary()))
    assert (got[1::2] == [3, 4, 3, 4, 3, 4]).all() and np.isnan(got[0:18:2]).all()
    sliced = pa.array([good, None, good, b"", good], pa.binary()).slice(1, 3)
    assert np.isnan(wkb.summaries(sliced)[[0, 2]]).all() and wkb.summaries(sliced)[1, 0] == 3
    assert wkb.summaries(pa.array([], pa.binary())).shape == (0, 6)
    assert np.isnan(wkb.summaries(pa.array([None, None], pa.binary()))).all()


def test_many_parts():
    n = 20_000
    points = b"".join(struct.pack("<BIdd", 1, 1, float(i), -float(i)) for i in range(n))
    got = wkb.summaries(pa.array([struct.pack("<BII", 1, 4, n) + points], pa.binary()))
    assert got[0].tolist() == [0, 1 - n, n - 1, 0, (n - 1) / 2, (1 - n) / 2]
