"""Column expressions on boxes: four doubles (west, south, east, north), or an array of 4 or 6 doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LIMIT = 1e9  # a finite coordinate beyond this is a sentinel, in any CRS
TOLERANCE = 1e-9


def box(*names: str) -> Column:
    return F.array(*[F.col(n).cast("double") for n in (names or ("xmin", "ymin", "xmax", "ymax"))])


def bbox_2d(b: Column) -> Column:
    """Six elements to indices 0, 1, 3, 4; four stay; other counts stay as they are."""
    return F.when(F.size(b) == 6, F.array(b[0], b[1], b[3], b[4])).otherwise(b)


def bbox_polygon(b: Column) -> Column:
    """The closed five-point footprint ring."""
    return F.array(*[F.array(b[i], b[j]) for i, j in ((0, 1), (2, 1), (2, 3), (0, 3), (0, 1))])


def _infinite(x: Column) -> Column:
    return F.abs(x) == float("inf")


def invalid_reason(b: Column, wgs84_only: bool = True) -> Column:
    """The first reason why a box is bad, else null: count, NaN, infinite, beyond LIMIT, out of range, south above north."""
    flat = bbox_2d(b)
    names = ("west", "south", "east", "north")
    steps = [F.when(~F.size(b).isin(4, 6), F.lit("wrong element count"))]
    for i, n in enumerate(names):
        steps += [F.when(F.isnan(flat[i]), F.lit(f"{n} is NaN")), F.when(_infinite(flat[i]), F.lit(f"{n} is infinite"))]
    rest = F.when(F.size(b) == 6, F.array(b[2], b[5])).otherwise(F.array().cast("array<double>"))
    steps.append(F.when(F.exists(rest, lambda x: F.isnan(x) | _infinite(x)), F.lit("elevation is not finite")))
    steps.append(F.when(F.exists(b, lambda x: F.abs(x) > LIMIT), F.lit("exceeds sane magnitude")))
    if wgs84_only:
        for i, n in enumerate(names):
            top = 180.0 if i % 2 == 0 else 90.0
            steps.append(F.when(~flat[i].between(-top, top), F.lit(f"{n} out of range")))
        steps.append(F.when(flat[1] > flat[3], F.lit("south > north")))
    return F.coalesce(*steps)


def strict_ok(b: Column) -> Column:
    """A user's box: exactly four values, minima not above maxima on both axes."""
    return (F.size(b) == 4) & (b[0] <= b[2]) & (b[1] <= b[3])


def crossing(b: Column) -> Column:
    flat = bbox_2d(b)
    return flat[0] > flat[2]


def parts(b: Column) -> Column:
    """The box as one part, or two where it crosses the antimeridian."""
    f = bbox_2d(b)
    return F.when(f[0] > f[2], F.array(F.array(f[0], f[1], F.lit(180.0), f[3]), F.array(F.lit(-180.0), f[1], f[2], f[3]))).otherwise(F.array(f))


def intersect(a: Column, b: Column) -> Column:
    """a clipped by b; null where nothing is left."""
    w, s, e, n = F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3])
    return F.when((w < e) & (s < n), F.array(w, s, e, n))


def is_placeholder(b: Column) -> Column:
    """The whole world within 0.001."""
    ends = (-180.0, -90.0, 180.0, 90.0)
    ok = F.lit(True)
    for i, v in enumerate(ends):
        ok = ok & (F.abs(b[i] - v) < 0.001)
    return ok


def looks_like_wgs84(b: Column) -> Column:
    return b[0].between(-180, 180) & b[2].between(-180, 180) & b[1].between(-90, 90) & b[3].between(-90, 90)


def crs_mismatch(b: Column, crs: Column) -> Column:
    """Coordinates in lon/lat range although the declared CRS is a projected one."""
    return looks_like_wgs84(b) & crs.isNotNull() & ~crs.isin("EPSG:4326", "OGC:CRS84")


def equal_tol(a: Column, b: Column, tol: float = TOLERANCE) -> Column:
    """Equality within a tolerance, absolute or relative; a null is never equal."""
    same = F.forall(F.zip_with(a, b, lambda x, y: F.coalesce(F.abs(x - y) <= F.greatest(F.lit(tol), F.lit(1e-9) * F.greatest(F.abs(x), F.abs(y))), F.lit(False))), lambda x: x)
    return F.coalesce(same & (F.size(a) == F.size(b)), F.lit(False))


def tile_bounds(z: Column, x: Column, y: Column) -> Column:
    """Slippy tile to (west, south, east, north)."""
    n = F.pow(F.lit(2.0), z)
    lon = lambda v: v / n * 360.0 - 180.0
    lat = lambda v: F.degrees(F.atan(F.sinh(F.pi() * (1 - 2 * v / n))))
    return F.array(lon(x), lat(y + 1), lon(x + 1), lat(y))


def mercator_to_lonlat(x: Column, y: Column) -> tuple[Column, Column]:
    """EPSG:3857 to degrees, in closed form."""
    r = 6378137.0
    return F.degrees(x / r), F.degrees(2 * F.atan(F.exp(y / r)) - F.pi() / 2)


def geohash(lon: Column, lat: Column, precision: int) -> Column:
    """Geohash text from Column arithmetic: both coordinates as integers of half the bits, interleaved, five bits a letter."""
    bits = 5 * precision
    nx, ny = (bits + 1) // 2, bits // 2
    x = F.least(F.floor((lon + 180) / 360 * float(1 << nx)).cast("long"), F.lit((1 << nx) - 1))
    y = F.least(F.floor((lat + 90) / 180 * float(1 << ny)).cast("long"), F.lit((1 << ny) - 1))
    letters = []
    for k in range(precision):
        v = F.lit(0).cast("long")
        for j in range(5):
            i = 5 * k + j
            bit = F.shiftright(x, nx - 1 - i // 2) if i % 2 == 0 else F.shiftright(y, ny - 1 - i // 2)
            v = v * 2 + bit.bitwiseAND(F.lit(1))
        letters.append(F.substring(F.lit("0123456789bcdefghjkmnpqrstuvwxyz"), (v + 1).cast("int"), F.lit(1)))
    return F.concat(*letters)


def mercator_tile(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    n = float(1 << zoom)
    clip = F.greatest(F.least(lat, F.lit(85.05112878)), F.lit(-85.05112878))
    edge = lambda v: F.greatest(F.least(F.floor(v), F.lit((1 << zoom) - 1)), F.lit(0)).cast("long")
    s = F.sin(F.radians(clip))
    return edge((lon + 180) / 360 * n), edge((0.5 - F.log((1 + s) / (1 - s)) / (4 * F.pi())) * n)


def quadkey(lon: Column, lat: Column, zoom: int = 13) -> Column:
    """Quadkey text: the bits of tile x and y, one digit a level."""
    x, y = mercator_tile(lon, lat, zoom)
    digits = [(F.shiftright(x, i).bitwiseAND(F.lit(1)) + 2 * F.shiftright(y, i).bitwiseAND(F.lit(1))).cast("string") for i in range(zoom - 1, -1, -1)]
    return F.concat(*digits)


def hilbert(x: Column, y: Column, order: int = 16) -> Column:
    """Distance along the Hilbert curve of 2**order cells a side, as one fold over the levels."""
    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(0).cast("long").alias("d"))

    def step(a: Column, s: Column) -> Column:
        rx = (a["x"].bitwiseAND(s) > 0).cast("long")
        ry = (a["y"].bitwiseAND(s) > 0).cast("long")
        d = a["d"] + s * s * (3 * rx).bitwiseXOR(ry)
        low = s - 1
        x0, y0 = a["x"].bitwiseAND(low), a["y"].bitwiseAND(low)
        fx = F.when((ry == 0) & (rx == 1), low - x0).otherwise(x0)
        fy = F.when((ry == 0) & (rx == 1), low - y0).otherwise(y0)
        return F.struct(F.when(ry == 0, fy).otherwise(fx).alias("x"), F.when(ry == 0, fx).otherwise(fy).alias("y"), d.alias("d"))

    sides = F.array(*[F.lit(1 << i).cast("long") for i in range(order - 1, -1, -1)])
    return F.aggregate(sides, start, step, lambda a: a["d"])


def grid_cell(lon: Column, lat: Column, order: int = 16) -> tuple[Column, Column]:
    n = 1 << order
    edge = lambda v: F.greatest(F.least(F.floor(v * n), F.lit(n - 1)), F.lit(0)).cast("long")
    return edge((lon + 180) / 360), edge((lat + 90) / 180)
