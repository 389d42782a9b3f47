"""Boxes and extents: derived columns, validity, antimeridian rules, unions, containment, time intervals."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspark.functions import boxes as B
from strataspark.plans.views import sql, view
from strataspark.registry import register
from strataspark.session import scratch

EDGES = ("xmin", "ymin", "xmax", "ymax")
KEY = ("l_orderkey", "ln")
R6 = 6


def _round(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), R6) for n in names})


def flat(b: Column, prefix: str = "") -> list[Column]:
    return [b[i].alias(prefix + e) for i, e in enumerate(EDGES)]


def _items(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "items")


_REASON = """case when xmin < -180 or xmin > 180 then 'west out of range' when ymin < -90 or ymin > 90 then 'south out of range'
  when xmax < -180 or xmax > 180 then 'east out of range' when ymax < -90 or ymax > 90 then 'north out of range' when ymin > ymax then 'south > north' end"""


@register("bbox_columns", sql("items", "select l_orderkey, ln, round(least(lon, lon), 6) as bbox_xmin, round(lat, 6) as bbox_ymin, round(lon, 6) as bbox_xmax, round(lat, 6) as bbox_ymax from items"))
def bbox_columns_q(spark: SparkSession, sf: str) -> DataFrame:
    return _round(point_bbox_columns(_items(spark, sf).select(*KEY, "lon", "lat"), "lon", "lat").drop("lon", "lat"), *[f"bbox_{e}" for e in EDGES])


def point_bbox_columns(df: DataFrame, lon: str, lat: str) -> DataFrame:
    """bbox_xmin ... bbox_ymax of rows with coordinates (for WKB see sources.wkb.bbox_columns)."""
    return df.withColumns({"bbox_xmin": F.col(lon), "bbox_ymin": F.col(lat), "bbox_xmax": F.col(lon), "bbox_ymax": F.col(lat)})


@register("bbox_struct", sql("items", "select l_orderkey, ln, xmin || '' as a, round(xmin, 6) as xmin, round(ymin, 6) as ymin, round(xmax, 6) as xmax, round(ymax, 6) as ymax from items").replace("xmin || '' as a, ", ""))
def bbox_struct_q(spark: SparkSession, sf: str) -> DataFrame:
    out = bbox_struct(_items(spark, sf)).select(*KEY, "bbox.*")
    return _round(out, *EDGES)


def bbox_struct(df: DataFrame, names: tuple[str, ...] = EDGES) -> DataFrame:
    """A covering struct column ``bbox``."""
    return df.withColumn("bbox", F.struct(*[F.col(n).alias(e) for n, e in zip(names, EDGES)]))


@register("bbox_invalid_reason", sql("items", f"select l_orderkey, ln, {_REASON} as reason from items"))
def bbox_invalid_reason_q(spark: SparkSession, sf: str) -> DataFrame:
    return _items(spark, sf).select(*KEY, B.invalid_reason(B.box()).alias("reason"))


def bbox_quarantine(df: DataFrame, b: Column, wgs84_only: bool = True) -> tuple[DataFrame, DataFrame]:
    """(valid rows, invalid rows with ``reason``)."""
    marked = df.withColumn("reason", B.invalid_reason(b, wgs84_only))
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


@register("bbox_quarantine", sql("items", f"select collection, cast(count(case when {_REASON} is null then 1 end) as bigint) as valid, cast(count({_REASON}) as bigint) as invalid from items group by collection"))
def bbox_quarantine_q(spark: SparkSession, sf: str) -> DataFrame:
    good, bad = bbox_quarantine(_items(spark, sf), B.box())
    n = good.groupBy("collection").agg(F.count("*").alias("valid"))
    m = bad.groupBy("collection").agg(F.count("*").alias("invalid"))
    return n.join(m, "collection", "full").select("collection", F.coalesce("valid", F.lit(0)).alias("valid"), F.coalesce("invalid", F.lit(0)).alias("invalid"))


@register("bbox_strict_check", sql("items", "select l_orderkey, ln, xmin <= xmax and ymin <= ymax as ok from items"))
def bbox_strict_check_q(spark: SparkSession, sf: str) -> DataFrame:
    return _items(spark, sf).select(*KEY, B.strict_ok(B.box()).alias("ok"))


@register("bbox_2d", sql("items", "select l_orderkey, ln, round(xmin, 6) as xmin, round(ymin, 6) as ymin, round(xmax, 6) as xmax, round(ymax, 6) as ymax from items"))
def bbox_2d_q(spark: SparkSession, sf: str) -> DataFrame:
    six = F.array("xmin", "ymin", F.lit(-5.0), "xmax", "ymax", F.lit(9.0))
    out = _items(spark, sf).select(*KEY, B.bbox_2d(F.when(F.col("ln") % 2 == 0, six).otherwise(B.box())).alias("b")).select(*KEY, *flat(F.col("b")))
    return _round(out, *EDGES)


@register("bbox_polygon", sql("items", "select l_orderkey, ln, (round(xmin, 2) + 0.0e0) || ' ' || (round(ymin, 2) + 0.0e0) || ',' || (round(xmax, 2) + 0.0e0) || ' ' || (round(ymin, 2) + 0.0e0) || ',' || (round(xmax, 2) + 0.0e0) || ' ' || (round(ymax, 2) + 0.0e0) || ',' || (round(xmin, 2) + 0.0e0) || ' ' || (round(ymax, 2) + 0.0e0) || ',' || (round(xmin, 2) + 0.0e0) || ' ' || (round(ymin, 2) + 0.0e0) as ring from items"))
def bbox_polygon_q(spark: SparkSession, sf: str) -> DataFrame:
    ring = B.bbox_polygon(B.box())
    return _items(spark, sf).select(*KEY, F.array_join(F.transform(ring, lambda p: F.concat_ws(" ", (F.round(p[0], 2) + 0.0).cast("string"), (F.round(p[1], 2) + 0.0).cast("string"))), ",").alias("ring"))


_SPLIT = """select l_orderkey, ln, xmin, ymin, 180.0e0 as xmax, ymax from items where xmin > xmax
  union all select l_orderkey, ln, -180.0e0, ymin, xmax, ymax from items where xmin > xmax
  union all select l_orderkey, ln, xmin, ymin, xmax, ymax from items where xmin <= xmax"""


@register("antimeridian_split", sql("items", f"select l_orderkey, ln, round(xmin, 6) as xmin, round(ymin, 6) as ymin, round(xmax, 6) as xmax, round(ymax, 6) as ymax from ({_SPLIT}) s"))
def antimeridian_split_q(spark: SparkSession, sf: str) -> DataFrame:
    out = _items(spark, sf).select(*KEY, F.explode(B.parts(B.box())).alias("b")).select(*KEY, *flat(F.col("b")))
    return _round(out, *EDGES)


@register("bbox_intersect", sql("items", """select l_orderkey, ln, round(greatest(xmin, -60.0e0), 6) as xmin, round(greatest(ymin, -40.0e0), 6) as ymin, round(least(xmax, 90.0e0), 6) as xmax, round(least(ymax, 50.0e0), 6) as ymax
  from items where greatest(xmin, -60.0e0) < least(xmax, 90.0e0) and greatest(ymin, -40.0e0) < least(ymax, 50.0e0)"""))
def bbox_intersect_q(spark: SparkSession, sf: str) -> DataFrame:
    area = F.array(*[F.lit(v) for v in (-60.0, -40.0, 90.0, 50.0)])
    out = _items(spark, sf).select(*KEY, B.intersect(B.box(), area).alias("b")).where("b is not null").select(*KEY, *flat(F.col("b")))
    return _round(out, *EDGES)


def bbox_to_wgs84(df: DataFrame, key: list[str], crs: str | None = "EPSG:3857", samples: int = 10, allow_guess: bool = False) -> DataFrame:
    """Boxes to lon/lat, with xmin > xmax where a box crosses the antimeridian: the shortest span of the longitudes of ``samples``
    steps an edge in EPSG:3857 (a box of more than samples / (samples + 1) of the circle is the whole circle), in closed form.

    A null CRS, or lon/lat itself, passes as it is. Refused with an error: boxes that are not finite; coordinates beyond lon/lat
    without a projection; lon/lat magnitudes in a projected CRS. ``allow_guess`` passes the last two unchanged. Other CRSs raise.
    """
    corners = F.array(*EDGES)
    finite = reduce(and_, [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in EDGES])
    check = lambda ok, why: F.when(ok, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(why + ": "), F.array_join(corners.cast("array<string>"), ", "))).cast("boolean"))
    like = B.looks_like_wgs84(corners)
    if crs in (None, "EPSG:4326", "OGC:CRS84"):
        passed = check(finite, "box is not finite") & (F.lit(True) if allow_guess else check(like, "coordinates beyond longitude and latitude"))
        return df.where(passed).select(*key, *EDGES)
    if crs != "EPSG:3857":
        raise ValueError(f"no closed form for {crs}")
    df = df.where(check(finite, "box is not finite") & (F.lit(True) if allow_guess else check(~like, "longitude and latitude in a projected system")))
    # Longitude depends on x alone and latitude on y alone, both rising, so the ends tell what samples between them would: the
    # largest gap is the one outside of the box, unless the samples' own distance is as wide.
    wrapped = lambda lon: F.when((lon >= -180) & (lon <= 180), lon).otherwise(lon - 360 * F.floor((lon + 180) / 360))
    x0, x1 = F.least("xmin", "xmax"), F.greatest("xmin", "xmax")
    (west, south), (east, north) = B.mercator_to_lonlat(x0, F.least("ymin", "ymax")), B.mercator_to_lonlat(x1, F.greatest("ymin", "ymax"))
    width = B.mercator_to_lonlat(x1 - x0, F.lit(0.0))[0]
    whole = 360 - width <= width / samples * (1 + 1e-9)
    keep = like & F.lit(allow_guess)
    pick = lambda own, new: F.when(keep, F.col(own)).otherwise(new).alias(own)
    return df.select(*key, pick("xmin", F.when(whole, -180.0).otherwise(wrapped(west))), pick("ymin", south), pick("xmax", F.when(whole, 180.0).otherwise(wrapped(east))), pick("ymax", north))


_METRES = {"xmin": "lon * 1.2e5", "ymin": "lat * 1e5", "xmax": "lon * 1.2e5 + 1e6 * ln", "ymax": "lat * 1e5 + 7000"}


def _wrapped_sql(x: str) -> str:
    d = f"degrees(({x}) / 6378137.0e0)"
    return f"case when {d} between -180 and 180 then {d} else {d} - 360 * floor(({d} + 180) / 360) end"


@register("bbox_to_wgs84", sql("items", f"""select l_orderkey, ln, round({_wrapped_sql(_METRES["xmin"])}, 6) as xmin, round(degrees(2 * atan(exp(lat * 1e5 / 6378137.0e0)) - pi() / 2), 6) as ymin,
  round({_wrapped_sql(_METRES["xmax"])}, 6) as xmax, round(degrees(2 * atan(exp((lat * 1e5 + 7000) / 6378137.0e0)) - pi() / 2), 6) as ymax from items"""))
def bbox_to_wgs84_q(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes of 9 to 63 degrees in metres, some of them over the antimeridian, from where they come out crossing."""
    metres = _items(spark, sf).select(*KEY, *[F.expr(e).alias(c) for c, e in _METRES.items()])
    return _round(bbox_to_wgs84(metres, list(KEY)), *EDGES)


_WORLD = {"xmin": "case when collection % 7 = 3 and ln = 1 then -180 + l_orderkey % 3 * 0.0009e0 else xmin end", "ymin": "case when collection % 7 = 3 and ln = 1 then -90.0e0 else ymin end", "xmax": "case when collection % 7 = 3 and ln = 1 then 180.0e0 else xmax end", "ymax": "case when collection % 7 = 3 and ln = 1 then 90 - 0.0005e0 else ymax end"}


@register("placeholder_extent", sql("items", "select collection, cast(count(*) as bigint) as n, cast(count(case when collection % 7 = 3 and ln = 1 and l_orderkey % 3 < 2 then 1 end) as bigint) as placeholders from items group by collection"))
def placeholder_extent_q(spark: SparkSession, sf: str) -> DataFrame:
    """Some items hold the whole world, or nearly so, in place of a box; a few miss it by more than the tolerance."""
    boxes = _items(spark, sf).select("collection", *[F.expr(e).alias(c) for c, e in _WORLD.items()])
    return boxes.groupBy("collection").agg(F.count("*").alias("n"), F.count_if(B.is_placeholder(B.box())).alias("placeholders"))


@register("looks_like_wgs84", sql("items", "select l_orderkey, ln, xmin between -180 and 180 and xmax between -180 and 180 and ymin between -90 and 90 and ymax between -90 and 90 and ln % 2 = 0 as mismatch from items"))
def looks_like_wgs84_q(spark: SparkSession, sf: str) -> DataFrame:
    crs = F.when(F.col("ln") % 2 == 0, "EPSG:3857").otherwise("EPSG:4326")
    return _items(spark, sf).select(*KEY, B.crs_mismatch(B.box(), crs).alias("mismatch"))


@register("bbox_equal_tol", sql("items", "select l_orderkey, ln, ln % 3 <> 0 as same from items"))
def bbox_equal_tol_q(spark: SparkSession, sf: str) -> DataFrame:
    moved = F.transform(B.box(), lambda x: x + F.when(F.col("ln") % 3 == 0, 1e-3).otherwise(1e-12))
    return _items(spark, sf).select(*KEY, B.equal_tol(B.box(), moved).alias("same"))


@register("spatial_filter", sql("items", "select l_orderkey, ln from items where xmin <= 40 and xmax >= -20 and ymin <= 30 and ymax >= 10"))
def spatial_filter_q(spark: SparkSession, sf: str) -> DataFrame:
    return spatial_filter(_items(spark, sf), (-20, 10, 40, 30)).select(*KEY)


def spatial_filter(df: DataFrame, area: tuple[float, float, float, float], names: tuple[str, ...] = EDGES) -> DataFrame:
    """Rows whose box overlaps the area, as plain range predicates that reach the Parquet row groups' statistics."""
    w, s, e, n = area
    x0, y0, x1, y1 = (F.col(c) for c in names)
    return df.where((x0 <= e) & (x1 >= w) & (y0 <= n) & (y1 >= s))


def ring_meets_box(ring: F.Column, area: tuple[float, float, float, float]) -> F.Column:
    """Does a polygon's ring (array of structs x, y; closed or not) share a point with a box: an edge that meets it, or a corner
    of the box within the ring. Every question is one of side: an edge meets the box unless their ranges are apart, or the box
    lies wholly on one side of the edge's line. A corner's side is told by the line's height over the edge's lower end, in
    both questions alike, so a shape that only touches the box has one answer."""
    w, s, e, n = (float(v) for v in area)
    size = F.size(ring)
    edges = F.transform(F.sequence(F.lit(1), size), lambda i: F.struct(F.element_at(ring, i).alias("a"), F.element_at(ring, F.when(i < size, i + 1).otherwise(1)).alias("b")))

    def lower_first(edge):
        """Lower end, upper end, and the line's height over the lower end at a given x (null for an upright edge)."""
        up = edge["a"]["y"] <= edge["b"]["y"]
        ax, ay, bx, by = (F.when(up, edge[p][c]).otherwise(edge[q][c]) for p, q, c in (("a", "b", "x"), ("a", "b", "y"), ("b", "a", "x"), ("b", "a", "y")))
        return ax, ay, bx, by, lambda x: (F.lit(x) - ax) * (by - ay) / F.nullif(bx - ax, F.lit(0.0))

    def meets(edge):
        ax, ay, bx, by, height = lower_first(edge)
        apart = (F.greatest(ax, bx) < w) | (F.least(ax, bx) > e) | (by < s) | (ay > n)
        rising = bx > ax
        above = F.lit(s) - ay > F.when(rising, height(e)).otherwise(height(w))
        below = F.lit(n) - ay < F.when(rising, height(w)).otherwise(height(e))
        return ~(apart | F.coalesce(above, F.lit(False)) | F.coalesce(below, F.lit(False)))

    # The corner (w, s) is within the ring if a ray from it to the east crosses an odd number of edges.
    def crosses(edge):
        ax, ay, bx, by, height = lower_first(edge)
        left = F.when(bx > ax, F.lit(s) - ay > height(w)).when(bx < ax, F.lit(s) - ay < height(w)).otherwise(ax > w)
        return ((ay > s) != (by > s)) & left

    within = F.size(F.filter(edges, lambda d: F.coalesce(crosses(d), F.lit(False)))) % 2 == 1
    return F.coalesce((size > 0) & (F.exists(edges, meets) | within), F.lit(False))


def footprint_filter(df: DataFrame, area: tuple[float, float, float, float], ring: str = "ring", names: tuple[str, ...] = EDGES) -> DataFrame:
    """Rows whose footprint meets the area: the box test, which prunes row groups, then the exact test of the ring on what is left. A
    null or empty ring meets nothing; holes play no part."""
    return spatial_filter(df, area, names).where(ring_meets_box(F.col(ring), area))


_TRIANGLE = "array(named_struct('x', lon - w, 'y', lat - w), named_struct('x', lon + w, 'y', lat - w), named_struct('x', case ln % 2 when 0 then lon - w else lon + w end, 'y', lat + w))"
_AREA = (-20, 10, 40, 30)


def _footprint_sql() -> str:
    """The oracle: two convex shapes meet unless a line along a side of one of them parts them (sides of the box, of the triangle)."""
    w, s, e, n = _AREA
    # The slanting side: lower left to upper right (odd ln), or lower right to upper left (even ln); the triangle is below it.
    odd = f"({s}e0 - y0) <= (least({e}e0, 1e9) - x0) * (y1 - y0) / nullif(x1 - x0, 0)"
    even = f"({s}e0 - y0) <= (x1 - {w}e0) * (y1 - y0) / nullif(x1 - x0, 0)"
    return f"""select l_orderkey, ln from (select l_orderkey, ln, lon - w as x0, lon + w as x1, lat - w as y0, lat + w as y1 from (select *, 0.5e0 + (l_orderkey % 40) / 2.0e0 as w from items) i) t
      where x0 <= {e} and x1 >= {w} and y0 <= {n} and y1 >= {s} and case ln % 2 when 1 then {odd} else {even} end"""


@register("footprint_filter", sql("items", _footprint_sql()))
def footprint_filter_q(spark: SparkSession, sf: str) -> DataFrame:
    """Triangles written with their boxes in order of place; about a fourth of those whose box overlaps the area don't meet it."""
    path = scratch(spark, "footprints")
    shapes = spark.sql(f"select l_orderkey, ln, {_TRIANGLE} as ring, lon - w as xmin, lat - w as ymin, lon + w as xmax, lat + w as ymax from (select *, 0.5e0 + (l_orderkey % 40) / 2.0e0 as w from {{items}}) i", items=_items(spark, sf))
    shapes.repartitionByRange("xmin", "ymin").sortWithinPartitions("xmin", "ymin").write.parquet(path)
    return footprint_filter(spark.read.parquet(path), _AREA).select(*KEY)


def union(df: DataFrame, by: list[str]) -> DataFrame:
    """Union box per group, one partial and one final aggregation; no rows give a null box."""
    return df.groupBy(*by).agg(F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"))


@register("bbox_union", sql("items", f"""select collection, round(min(case when {_REASON} is null then least(xmin, xmax) end), 6) as xmin, round(min(case when {_REASON} is null then ymin end), 6) as ymin,
  round(max(case when {_REASON} is null then greatest(xmin, xmax) end), 6) as xmax, round(max(case when {_REASON} is null then ymax end), 6) as ymax, min(ts) as first_ts, max(ts) as last_ts,
  cast(count(*) as bigint) as items, cast(count({_REASON}) as bigint) as invalid from items group by collection"""))
def bbox_union_q(spark: SparkSession, sf: str) -> DataFrame:
    """The extent of every collection: union box of its valid items, time extent, counts."""
    ok = F.col("reason").isNull()
    marked = _items(spark, sf).withColumn("reason", B.invalid_reason(B.box()))
    out = marked.groupBy("collection").agg(
        F.min(F.when(ok, F.least("xmin", "xmax"))).alias("xmin"), F.min(F.when(ok, F.col("ymin"))).alias("ymin"), F.max(F.when(ok, F.greatest("xmin", "xmax"))).alias("xmax"), F.max(F.when(ok, F.col("ymax"))).alias("ymax"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("items"), F.count("reason").alias("invalid"))
    return _round(out, *EDGES)


def union_antimeridian(df: DataFrame, by: list[str]) -> DataFrame:
    """Union boxes with antimeridian rules, of valid boxes: where one crosses, all parts are united by hemisphere (parts over
    the zero meridian count in both). ``crossing``, west_*, east_* (null where the plain union holds), envelope edges."""
    p = df.select(*by, (F.col("xmin") > F.col("xmax")).alias("c"), F.explode(B.parts(B.box())).alias("b")).select(*by, "c", *flat(F.col("b")))
    west, east = (F.col("xmax") <= 0) | ((F.col("xmin") < 0) & (F.col("xmax") > 0)), (F.col("xmin") >= 0) | ((F.col("xmin") < 0) & (F.col("xmax") > 0))
    low, high = ("xmin", "ymin"), ("xmax", "ymax")
    half = [f(F.when(side, F.col(e))).alias(f"{name}_{e}") for name, side in (("west", west), ("east", east)) for f, es in ((F.min, low), (F.max, high)) for e in es]
    agg = p.groupBy(*by).agg(F.bool_or("c").alias("crossing"), *half, *[F.min(e).alias(e) for e in low], *[F.max(e).alias(e) for e in high])
    names = [f"{s}_{e}" for s in ("west", "east") for e in EDGES]
    return agg.withColumns({n: F.when(F.col("crossing"), F.col(n)) for n in names})


_AM = f"""select collection, bool_or(c) as crossing,
  {', '.join(f"case when bool_or(c) then round({f}(case when {cond} then {e} end), 6) end as {s}_{e}" for s, cond in (("west", "xmax <= 0 or (xmin < 0 and xmax > 0)"), ("east", "xmin >= 0 or (xmin < 0 and xmax > 0)")) for f, e in (("min", "xmin"), ("min", "ymin"), ("max", "xmax"), ("max", "ymax")))},
  round(min(xmin), 6) as xmin, round(min(ymin), 6) as ymin, round(max(xmax), 6) as xmax, round(max(ymax), 6) as ymax
  from (select collection, true as c, xmin, ymin, 180.0e0 as xmax, ymax from v where xmin > xmax union all select collection, true, -180.0e0, ymin, xmax, ymax from v where xmin > xmax
        union all select collection, false, xmin, ymin, xmax, ymax from v where xmin <= xmax) p group by collection"""


@register("bbox_union_antimeridian", sql("items", f", v as (select * from items where {_REASON} is null) {_AM}"))
def bbox_union_antimeridian_q(spark: SparkSession, sf: str) -> DataFrame:
    good, _ = bbox_quarantine(_items(spark, sf), B.box())
    out = union_antimeridian(good, ["collection"])
    return _round(out, *[c for c in out.columns if c not in ("collection", "crossing")])


def extent_update(old: DataFrame, new: DataFrame, by: list[str], keep: bool = False) -> DataFrame:
    """A placeholder extent is replaced by the new union, any other is expanded; ``keep`` leaves what is there."""
    n = new.select(*by, *[F.col(e).alias(f"n_{e}") for e in EDGES])
    both = old.join(n, by, "left")
    if keep:
        return both.select(*by, *EDGES)
    fresh = B.is_placeholder(B.box()) & F.col("n_xmin").isNotNull()
    wide = {e: (F.least if e.endswith("min") else F.greatest)(F.col(e), F.col(f"n_{e}")) for e in EDGES}
    return both.select(*by, *[F.when(fresh, F.col(f"n_{e}")).otherwise(wide[e]).alias(e) for e in EDGES])


@register("extent_update", sql("items", """, n as (select collection, min(lon) as xmin, min(lat) as ymin, max(lon) as xmax, max(lat) as ymax from items group by collection),
  o as (select collection, case when collection % 2 = 0 then -180.0e0 else -1.0e0 end as xmin, case when collection % 2 = 0 then -90.0e0 else -1.0e0 end as ymin, case when collection % 2 = 0 then 180.0e0 else 1.0e0 end as xmax, case when collection % 2 = 0 then 90.0e0 else 1.0e0 end as ymax from n)
  select o.collection, round(case when o.collection % 2 = 0 then n.xmin else least(o.xmin, n.xmin) end, 6) as xmin, round(case when o.collection % 2 = 0 then n.ymin else least(o.ymin, n.ymin) end, 6) as ymin,
    round(case when o.collection % 2 = 0 then n.xmax else greatest(o.xmax, n.xmax) end, 6) as xmax, round(case when o.collection % 2 = 0 then n.ymax else greatest(o.ymax, n.ymax) end, 6) as ymax from o join n on o.collection = n.collection"""))
def extent_update_q(spark: SparkSession, sf: str) -> DataFrame:
    pts = _items(spark, sf).select("collection", F.col("lon").alias("xmin"), F.col("lat").alias("ymin"), F.col("lon").alias("xmax"), F.col("lat").alias("ymax"))
    new = union(pts, ["collection"])
    even = F.col("collection") % 2 == 0
    old = new.select("collection", *[F.when(even, w).otherwise(s).alias(e) for e, w, s in zip(EDGES, (-180.0, -90.0, 180.0, 90.0), (-1.0, -1.0, 1.0, 1.0))])
    return _round(extent_update(old, new, ["collection"]), *EDGES)


def measured_bounds(df: DataFrame, by: list[str], lon: str = "lon", lat: str = "lat") -> DataFrame:
    """True extent from coordinates; the span shifted to 0..360 counts where it is shorter (then west > east)."""
    x = F.col(lon)
    shifted = F.when(x < 0, x + 360).otherwise(x)
    a = df.groupBy(*by).agg(F.min(x).alias("a"), F.max(x).alias("b"), F.min(shifted).alias("c"), F.max(shifted).alias("d"), F.min(lat).alias("ymin"), F.max(lat).alias("ymax"))
    short = F.col("d") - F.col("c") < F.col("b") - F.col("a")
    back = lambda v: F.when(v > 180, v - 360).otherwise(v)
    return a.select(*by, F.when(short, back(F.col("c"))).otherwise(F.col("a")).alias("xmin"), "ymin", F.when(short, back(F.col("d"))).otherwise(F.col("b")).alias("xmax"), "ymax")


_SHIFTED = "case when lon < 0 then lon + 360 else lon end"
#: Groups of 500 keys; those of the even ones lie about the antimeridian, those of the others anywhere.
_HUGGING = "case when l_orderkey % 2 = 1 then lon when lon >= 0 then 180 - lon / 20 else -180 - lon / 20 end"


@register("measured_bounds", sql("items", f""", i as (select l_orderkey % 500 as l_orderkey, {_HUGGING} as lon, lat from items),
  g as (select l_orderkey, min(lon) as a, max(lon) as b, min({_SHIFTED}) as c, max({_SHIFTED}) as d, min(lat) as y0, max(lat) as y1 from i group by l_orderkey)
  select l_orderkey, round(case when d - c < b - a then case when c > 180 then c - 360 else c end else a end, 6) as xmin, round(y0, 6) as ymin, round(case when d - c < b - a then case when d > 180 then d - 360 else d end else b end, 6) as xmax, round(y1, 6) as ymax from g"""))
def measured_bounds_q(spark: SparkSession, sf: str) -> DataFrame:
    it = _items(spark, sf).select((F.col("l_orderkey") % 500).alias("l_orderkey"), F.expr(_HUGGING).alias("lon"), "lat")
    return _round(measured_bounds(it, ["l_orderkey"]), *EDGES)


@register("measured_bounds_items", sql("items", f""", i as (select l_orderkey, case when l_orderkey % 3 = 0 and ln % 2 = 0 then -lon else lon end as lon, lat from items),
  g as (select l_orderkey, min(lon) as a, max(lon) as b, min({_SHIFTED}) as c, max({_SHIFTED}) as d, min(lat) as y0, max(lat) as y1 from i group by l_orderkey)
  select l_orderkey, round(case when d - c < b - a then case when c > 180 then c - 360 else c end else a end, 6) as xmin, round(y0, 6) as ymin, round(case when d - c < b - a then case when d > 180 then d - 360 else d end else b end, 6) as xmax, round(y1, 6) as ymax from g"""))
def measured_bounds_items_q(spark: SparkSession, sf: str) -> DataFrame:
    """Over all items by order. The items of an order share a longitude; in every third order some are mirrored, so that both spans occur."""
    it = _items(spark, sf).select("l_orderkey", F.expr("case when l_orderkey % 3 = 0 and ln % 2 = 0 then -lon else lon end").alias("lon"), "lat")
    return _round(measured_bounds(it, ["l_orderkey"]), *EDGES)


@register("temporal_extent", sql("items", "select collection, min(ts) as start_ts, max(ts) as end_ts from items group by collection"))
def temporal_extent_q(spark: SparkSession, sf: str) -> DataFrame:
    return _items(spark, sf).groupBy("collection").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"))


@register("temporal_interval_all", "select l_returnflag, least(min(l_shipdate), min(l_shipdate + interval 3 day)) as start_ts, greatest(max(l_shipdate), max(l_shipdate + interval 3 day)) as end_ts from lineitem group by l_returnflag")
def temporal_interval_all_q(spark: SparkSession, sf: str) -> DataFrame:
    df = view(spark, sf, "lineitem").withColumn("due", F.expr("l_shipdate + interval 3 days"))
    return temporal_interval_all(df, ["l_returnflag"])


def temporal_interval_all(df: DataFrame, by: list[str]) -> DataFrame:
    """Earliest and latest value over every date and timestamp column."""
    cols = [c for c, t in df.dtypes if t in ("date", "timestamp", "timestamp_ntz")]
    pick = lambda f, g: g(*[f(c) for c in cols]) if len(cols) > 1 else f(cols[0])
    return df.groupBy(*by).agg(pick(F.min, F.least).alias("start_ts"), pick(F.max, F.greatest).alias("end_ts"))


def extent_containment(items: DataFrame, extents: DataFrame, by: list[str]) -> DataFrame:
    """Items outside their collection's extent, or without a box; an equi-join with the ranges as residual."""
    e = extents.select(*by, *[F.col(x).alias(f"c_{x}") for x in EDGES])
    both = items.join(e, by, "left")
    inside = (F.col("xmin") >= F.col("c_xmin")) & (F.col("ymin") >= F.col("c_ymin")) & (F.col("xmax") <= F.col("c_xmax")) & (F.col("ymax") <= F.col("c_ymax"))
    return both.withColumn("problem", F.when(F.col("xmin").isNull(), "no bbox").when(~F.coalesce(inside, F.lit(False)), "outside")).where("problem is not null").drop(*[f"c_{x}" for x in EDGES])


@register("extent_containment", sql("items", "select l_orderkey, ln, 'outside' as problem from items where not (xmin >= -170 and ymin >= -80 + collection and xmax <= 170 and ymax <= 80)"))
def extent_containment_q(spark: SparkSession, sf: str) -> DataFrame:
    it = _items(spark, sf)
    ext = it.select("collection").distinct().select("collection", F.lit(-170.0).alias("xmin"), (F.col("collection") - 80.0).alias("ymin"), F.lit(170.0).alias("xmax"), F.lit(80.0).alias("ymax"))
    return extent_containment(it, ext, ["collection"]).select(*KEY, "problem")


def aoi_inherit(tables: DataFrame, siblings: DataFrame, by: list[str]) -> DataFrame:
    """A table without extent takes its explicit box, else the union of its siblings, else the world; ``origin`` says which."""
    u = union(siblings, by).select(*by, *[F.col(e).alias(f"u_{e}") for e in EDGES])
    both = tables.join(u, by, "left")
    world = dict(zip(EDGES, (-180.0, -90.0, 180.0, 90.0)))
    own, sib = F.col("xmin").isNotNull(), F.col("u_xmin").isNotNull()
    return both.select(*by, *[F.coalesce(F.col(e), F.col(f"u_{e}"), F.lit(world[e])).alias(e) for e in EDGES], F.when(own, "explicit").when(sib, "siblings").otherwise("world").alias("origin"))


@register("aoi_inherit", sql("items", """, u as (select collection, min(lon) as xmin, min(lat) as ymin, max(lon) as xmax, max(lat) as ymax from items where collection < 15 group by collection),
  t as (select distinct collection, case when collection % 3 = 0 then 1.0e0 end as xmin, case when collection % 3 = 0 then 2.0e0 end as ymin, case when collection % 3 = 0 then 3.0e0 end as xmax, case when collection % 3 = 0 then 4.0e0 end as ymax from items)
  select t.collection, round(coalesce(t.xmin, u.xmin, -180.0e0), 6) as xmin, round(coalesce(t.ymin, u.ymin, -90.0e0), 6) as ymin, round(coalesce(t.xmax, u.xmax, 180.0e0), 6) as xmax, round(coalesce(t.ymax, u.ymax, 90.0e0), 6) as ymax,
    case when t.xmin is not null then 'explicit' when u.xmin is not null then 'siblings' else 'world' end as origin from t left join u on t.collection = u.collection"""))
def aoi_inherit_q(spark: SparkSession, sf: str) -> DataFrame:
    it = _items(spark, sf)
    third = F.col("collection") % 3 == 0
    t = it.select("collection").distinct().select("collection", *[F.when(third, float(i + 1)).alias(e) for i, e in enumerate(EDGES)])
    s = it.where("collection < 15").select("collection", F.col("lon").alias("xmin"), F.col("lat").alias("ymin"), F.col("lon").alias("xmax"), F.col("lat").alias("ymax"))
    return _round(aoi_inherit(t, s, ["collection"]), *EDGES)


@register("catalog_extent", sql("items", "select round(min(lon), 6) as xmin, round(min(lat), 6) as ymin, round(max(lon), 6) as xmax, round(max(lat), 6) as ymax, min(ts) as start_ts, max(ts) as end_ts, (select string_agg(cast(c as varchar), ',' order by cast(c as varchar)) from (select distinct collection as c from items) d) as collections from items"))
def catalog_extent_q(spark: SparkSession, sf: str) -> DataFrame:
    per = _items(spark, sf).groupBy("collection").agg(F.min("lon").alias("xmin"), F.min("lat").alias("ymin"), F.max("lon").alias("xmax"), F.max("lat").alias("ymax"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"))
    return _round(catalog_extent(per), *EDGES)


def catalog_extent(collections: DataFrame) -> DataFrame:
    """Envelope, time interval and ids over the collections of a catalog (one row a collection)."""
    return collections.agg(*[(F.min if e.endswith("min") else F.max)(e).alias(e) for e in EDGES], F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"),
                           F.array_join(F.sort_array(F.collect_list(F.col("collection").cast("string"))), ",").alias("collections"))
