"""Spatial layout: cell columns, space-filling orders, balanced partitions, grids and spread samples."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataspark.functions import boxes as B
from strataspark.operators.extents import point_bbox_columns
from strataspark.plans.views import sql, view
from strataspark.registry import register
from strataspark.session import scratch, ship


def _points(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "points")


def _geohash_sql(p: int) -> str:
    """The oracle's geohash: each letter takes five bits of the two coordinates' integers in turn."""
    bits = 5 * p
    nx, ny = (bits + 1) // 2, bits // 2
    xs = f"cast(least(floor((lon + 180) / 360 * {1 << nx}), {(1 << nx) - 1}) as bigint)"
    ys = f"cast(least(floor((lat + 90) / 180 * {1 << ny}), {(1 << ny) - 1}) as bigint)"
    letters = []
    for k in range(p):
        terms = []
        for j in range(5):
            i = 5 * k + j
            src, shift = (xs, nx - 1 - i // 2) if i % 2 == 0 else (ys, ny - 1 - i // 2)
            terms.append(f"((({src}) >> {shift}) & 1) * {1 << (4 - j)}")
        letters.append(f"substr('0123456789bcdefghjkmnpqrstuvwxyz', cast({' + '.join(terms)} + 1 as integer), 1)")
    return " || ".join(letters)


def geohash_column(df: DataFrame, lon: str, lat: str, precision: int) -> DataFrame:
    return df.withColumn(f"geohash_{precision}", B.geohash(F.col(lon), F.col(lat), precision))


@register("geohash_column", sql("points", f"select id, {_geohash_sql(5)} as geohash_5 from points"))
def geohash_column_q(spark: SparkSession, sf: str) -> DataFrame:
    return geohash_column(_points(spark, sf), "lon", "lat", 5).select("id", "geohash_5")


def geohash_precision(rows: int) -> int | None:
    """None below 100 000 rows, 3 below 10 million, else 4."""
    return None if rows < 100_000 else 3 if rows < 10_000_000 else 4


@register("geohash_precision", sql("points items", "select 'points' as t, cast(count(*) as bigint) as rows, case when count(*) < 100000 then null when count(*) < 10000000 then 3 else 4 end as p from points union all select 'items100', cast(count(*) * 100 as bigint), case when count(*) * 100 < 100000 then null when count(*) * 100 < 10000000 then 3 else 4 end from items"))
def geohash_precision_q(spark: SparkSession, sf: str) -> DataFrame:
    p = F.when(F.col("rows") < 100_000, None).when(F.col("rows") < 10_000_000, 3).otherwise(4)
    a = _points(spark, sf).agg(F.lit("points").alias("t"), F.count("*").alias("rows"))
    b = view(spark, sf, "items").agg(F.lit("items100").alias("t"), (F.count("*") * 100).alias("rows"))
    return a.union(b).withColumn("p", p.cast("int"))


def add_spatial_columns(df: DataFrame, lon: str, lat: str, precision: int | None = None) -> DataFrame:
    """Box columns always; a geohash at the given precision, or at that for the row count (4 where that says none)."""
    p = precision or geohash_precision(df.count()) or 4
    return geohash_column(point_bbox_columns(df, lon, lat), lon, lat, p)


@register("add_spatial_columns", sql("points", f"select id, {_geohash_sql(4)} as geohash_4, round(lon, 6) as bbox_xmin, round(lat, 6) as bbox_ymin from points"))
def add_spatial_columns_q(spark: SparkSession, sf: str) -> DataFrame:
    return add_spatial_columns(_points(spark, sf), "lon", "lat", 4).select("id", "geohash_4", F.round("bbox_xmin", 6).alias("bbox_xmin"), F.round("bbox_ymin", 6).alias("bbox_ymin"))


def _tile_sql(z: int) -> tuple[str, str]:
    x = f"cast(greatest(least(floor((lon + 180) / 360 * {1 << z}), {(1 << z) - 1}), 0) as bigint)"
    s = "sin(radians(greatest(least(lat, 85.05112878), -85.05112878)))"
    y = f"cast(greatest(least(floor((0.5e0 - ln((1 + {s}) / (1 - {s})) / (4 * pi())) * {1 << z}), {(1 << z) - 1}), 0) as bigint)"
    return x, y


def _quadkey_sql(z: int) -> str:
    x, y = _tile_sql(z)
    return " || ".join(f"cast((({x} >> {i}) & 1) + 2 * (({y} >> {i}) & 1) as varchar)" for i in range(z - 1, -1, -1))


@register("spatial_index_column", sql("points", f"select id, {_quadkey_sql(9)} as quadkey from points"))
def spatial_index_column_q(spark: SparkSession, sf: str) -> DataFrame:
    return spatial_index_column(_points(spark, sf), "quadkey", "lon", "lat", 9).select("id", "quadkey")


#: Default resolutions of the index kinds built here.
RESOLUTIONS = {"quadkey": 13, "kdtree": 9}


def spatial_index_column(df: DataFrame, kind: str, lon: str, lat: str, resolution: int | None = None) -> DataFrame:
    r = resolution or RESOLUTIONS[kind]
    if kind == "quadkey":
        return df.withColumn("quadkey", B.quadkey(F.col(lon), F.col(lat), r))
    return kdtree_approx(df, lon, lat, r)


def sort_quadkey(df: DataFrame, lon: str, lat: str, zoom: int = 13, partitions: int | None = None) -> DataFrame:
    """Rows in quadkey order: range partitions of the key, sorted within."""
    keyed = df.withColumn("quadkey", B.quadkey(F.col(lon), F.col(lat), zoom))
    ranged = keyed.repartitionByRange(partitions, "quadkey") if partitions else keyed.repartitionByRange("quadkey")
    return ranged.sortWithinPartitions("quadkey")


@register("sort_quadkey", sql("points", f"select id, {_quadkey_sql(6)} as quadkey, rank() over (order by {_quadkey_sql(6)}) as pos from points"))
def sort_quadkey_q(spark: SparkSession, sf: str) -> DataFrame:
    s = sort_quadkey(_points(spark, sf).select("id", "lon", "lat"), "lon", "lat", 6).select("id", "quadkey")
    # Keys rank within their first digits, and those among each other: no window holds all keys.
    n = s.groupBy("quadkey", F.substring("quadkey", 1, 3).alias("top")).agg(F.count("*").alias("n"))
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    tops = n.groupBy("top").agg(F.sum("n").alias("n")).select("top", earlier(W.orderBy("top")).alias("base"))  # at most 64 rows
    before = n.withColumn("own", earlier(W.partitionBy("top").orderBy("quadkey"))).join(tops, "top")
    return s.join(before.select("quadkey", (F.col("base") + F.col("own") + 1).alias("pos")), "quadkey")


def sort_hilbert(df: DataFrame, lon: str, lat: str, order: int = 16) -> DataFrame:
    """Rows on a Hilbert curve: range partitions of the distance, sorted within."""
    x, y = B.grid_cell(F.col(lon), F.col(lat), order)
    return df.withColumn("hilbert", B.hilbert(x, y, order)).repartitionByRange("hilbert").sortWithinPartitions("hilbert")


def _hilbert_sql(order: int) -> str:
    """The oracle walks the levels in a recursive query over distinct cells."""
    n = 1 << order
    return f""", recursive_cells as (select distinct cast(greatest(least(floor((lon + 180) / 360 * {n}), {n - 1}), 0) as bigint) as cx, cast(greatest(least(floor((lat + 90) / 180 * {n}), {n - 1}), 0) as bigint) as cy from points),
  h0 as (select cx, cy, cx as x, cy as y, cast(0 as bigint) as d from recursive_cells)""" + "".join(
        f""", h{i + 1} as (select cx, cy, case when ry = 0 then fy else fx end as x, case when ry = 0 then fx else fy end as y, d + {s * s} * xor(3 * rx, ry) as d from (
    select *, case when ry = 0 and rx = 1 then {s - 1} - (x & {s - 1}) else x & {s - 1} end as fx, case when ry = 0 and rx = 1 then {s - 1} - (y & {s - 1}) else y & {s - 1} end as fy from (
      select *, case when x & {s} > 0 then 1 else 0 end as rx, case when y & {s} > 0 then 1 else 0 end as ry from h{i}) a) b)"""
        for i, s in enumerate(1 << k for k in range(order - 1, -1, -1)))


@register("sort_hilbert", sql("points", f"{_hilbert_sql(6)} select id, cast(d as bigint) as hilbert from points join h6 on cx = cast(greatest(least(floor((lon + 180) / 360 * 64), 63), 0) as bigint) and cy = cast(greatest(least(floor((lat + 90) / 180 * 64), 63), 0) as bigint)"))
def sort_hilbert_q(spark: SparkSession, sf: str) -> DataFrame:
    return sort_hilbert(_points(spark, sf), "lon", "lat", 6).select("id", "hilbert")


def kdtree_exact(df: DataFrame, x: str, y: str, levels: int, id: str) -> DataFrame:
    """Balanced cells by exact halving: every level splits each cell at the median of alternating axes, with a total order.

    Ranks in a cell come from range partitions and their counts (a row per cell and partition), so no task sorts a whole cell.
    Each level's ranges are written once: the counts and the ranks must see the same partitions.
    """
    out = df.withColumn("cell", F.lit(""))
    for level in range(levels):
        axis = x if level % 2 == 0 else y
        path = scratch(df.sparkSession, f"kdtree_{level}")
        out.repartitionByRange("cell", axis, id).withColumn("_p", F.spark_partition_id()).write.parquet(path)
        ranged = df.sparkSession.read.parquet(path)
        counts = ranged.groupBy("cell", "_p").agg(F.count("*").alias("_n"))
        before = W.partitionBy("cell").orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
        base = counts.select("cell", "_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"), F.sum("_n").over(W.partitionBy("cell")).alias("_all"))
        ranks = ranged.withColumn("_rn", F.row_number().over(W.partitionBy("cell", "_p").orderBy(axis, id))).join(base, ["cell", "_p"])
        half = (2 * (F.col("_base") + F.col("_rn")) > F.col("_all") + 1).cast("int").cast("string")  # the first half has the odd row
        out = ranks.withColumn("cell", F.concat("cell", half)).select(*df.columns, "cell")
    return out


SAMPLE = 1 << 18  # points of the whole table from which the upper levels are cut, on the driver
FIRST = 10  # levels that these points cut: 256 a cell
PER_LEAF = 64  # points for each cell that a further cut gives, in a task a cell


def kdtree_cuts(x: np.ndarray, y: np.ndarray, levels: int, axis: int = 0) -> np.ndarray:
    """The cuts of a tree over sample points, by node (the root is 1, the children of n are 2n and 2n + 1): the lower median of the
    node's points, x and y in turn; NaN, which no value is above, where no point is."""
    node, cuts = np.ones(len(x), dtype=np.int64), np.full(1 << levels, np.nan)
    for level in range(levels):
        v = y if (level + axis) % 2 else x
        order = np.lexsort((v, node))
        some, first, n = np.unique(node[order], return_index=True, return_counts=True)
        cuts[some] = v[order][first + (n - 1) // 2]
        node = 2 * node + (v > cuts[node])
    return cuts


def _descend(cuts: str, levels: str, x: str, y: str, axis: str = "0") -> str:
    """SQL: the path (a digit a level) of a point through a tree of cuts. One pass, no join, whatever the depth."""
    step = f"(n, l) -> 2 * n + case when if((l + {axis}) % 2 = 0, `{x}`, `{y}`) > {cuts}[n] and not isnan({cuts}[n]) then 1L else 0L end"
    return f"if({levels} > 0, substring(bin(aggregate(sequence(0, greatest({levels} - 1, 0)), 1L, {step})), 2), '')"


def kdtree_approx(df: DataFrame, x: str, y: str, levels: int, sample: int = SAMPLE) -> DataFrame:
    """Cells (paths of 0 and 1) of near-equal size: the tree from one sample of about ``sample`` points, rows sent to it in one pass.

    Levels below FIRST are cut from further samples, a cell's in a task. Null coordinates go to the lower side.
    """
    return _deepen(_first(df, x, y, min(levels, FIRST), sample), x, y, lambda cells: cells.withColumn("more", F.lit(max(0, levels - FIRST))))


def _first(df: DataFrame, x: str, y: str, levels: int, sample: int) -> DataFrame:
    share = min(1.0, sample / max(1, df.count()))
    points = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null")
    points = (points.sample(share, seed=11) if share < 1 else points).toPandas()  # at most about ``sample`` rows
    cuts = kdtree_cuts(points["x"].to_numpy(), points["y"].to_numpy(), levels)
    tree = F.lit([float(c) for c in cuts]) if levels else F.array(F.lit(0.0))
    return df.withColumn("_cuts", tree).withColumn("cell", F.expr(_descend("_cuts", str(levels), x, y))).drop("_cuts")


def _deepen(placed: DataFrame, x: str, y: str, more) -> DataFrame:
    """Cells that ``more`` (from cell, n to the same with the levels to add) names are cut again, the others stay as they are."""
    wanted = more(placed.groupBy("cell").agg(F.count("*").alias("n"))).where("more > 0")
    if wanted.isEmpty():
        return placed
    path = scratch(placed.sparkSession, "cells")
    wanted.write.parquet(path)
    wanted = placed.sparkSession.read.parquet(path)
    share = F.least(F.lit(1.0), PER_LEAF * F.pow(F.lit(2.0), F.col("more")) / F.col("n"))
    some = placed.select("cell", F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null").join(wanted, "cell").where(F.rand(13) < share)

    def cut(key: tuple, points: pd.DataFrame) -> pd.DataFrame:
        levels = int(points["more"].iloc[0])
        return pd.DataFrame({"cell": [key[0]], "more": [levels], "cuts": [kdtree_cuts(points["x"].to_numpy(), points["y"].to_numpy(), levels, len(key[0]))]})

    ship(placed.sparkSession)
    trees = scratch(placed.sparkSession, "trees")
    some.groupBy("cell").applyInPandas(cut, "cell string, more int, cuts array<double>").write.parquet(trees)
    trees = placed.sparkSession.read.parquet(trees).select(F.col("cell").alias("_cell"), F.col("more").alias("_more"), F.col("cuts").alias("_cuts"))
    both = placed.join(trees, F.col("cell") == F.col("_cell"), "left")
    deeper = F.concat("cell", F.coalesce(F.expr(_descend("_cuts", "_more", x, y, "length(cell)")), F.lit("")))
    return both.withColumn("cell", deeper).select(*placed.columns)


def kdtree_sampled(df: DataFrame, x: str, y: str, target_rows: int, sample: int = SAMPLE, first: int = FIRST, slack: float = 1.25) -> DataFrame:
    """Cells of about ``target_rows``: the upper ``first`` levels from one bounded sample, the rows written once with their cells; cells
    that then have more than ``slack`` times the target are cut again, in one further pass."""
    n, levels = df.count(), 0
    while n > target_rows << levels and levels < first:
        levels += 1
    path = scratch(df.sparkSession, "kdtree")
    _first(df, x, y, levels, sample).write.parquet(path)
    more = F.when(F.col("n") > slack * target_rows, F.ceil(F.log2(F.col("n") / target_rows))).otherwise(0).cast("int")
    return _deepen(df.sparkSession.read.parquet(path), x, y, lambda cells: cells.withColumn("more", more))


def kdtree_partition(df: DataFrame, x: str, y: str, target_rows: int = 120_000, id: str | None = None) -> DataFrame:
    """Cells of about ``target_rows``: exact with an id to break ties, else by samples."""
    if not id:
        return kdtree_sampled(df, x, y, target_rows)
    n, levels = df.count(), 0
    while n > target_rows << levels and levels < 20:
        levels += 1
    return kdtree_exact(df, x, y, levels, id)


@register("kdtree_sampled", sql("points", "select cast(count(*) as bigint) as rows, cast(0 as bigint) as large, cast(0 as bigint) as overlapping, true as many from points"))
def kdtree_sampled_q(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of a 48th of the table, three levels first: every row has a cell, none holds twice the target, and no two overlap (their
    boxes share no inner point, told by a sweep over the cells of one level above)."""
    pts = _points(spark, sf).select("id", "lon", "lat")
    target = -(-pts.count() // 48)
    cells = kdtree_sampled(pts, "lon", "lat", target, first=3).groupBy("cell").agg(F.count("*").alias("n"), *[f(c).alias(f"{k}_{c}") for c in ("lon", "lat") for k, f in (("lo", F.min), ("hi", F.max))])
    cells = cells.withColumn("up", F.expr("substring(cell, 1, length(cell) - 1)"))
    a, b = cells.where("cell like '%0'").alias("a"), cells.where("cell like '%1'").alias("b")
    pairs = a.join(b, F.col("a.up") == F.col("b.up")).where("a.hi_lon > b.lo_lon and a.hi_lat > b.lo_lat and b.hi_lon > a.lo_lon and b.hi_lat > a.lo_lat")
    return cells.agg(F.sum("n").alias("rows"), F.count_if(F.col("n") > 2 * target).alias("large"), (F.count("*") >= 40).alias("many")).join(pairs.agg(F.count("*").alias("overlapping"))).select("rows", "large", "overlapping", "many")


@register("kdtree_partition", sql("points", """, a as (select id, lon, lat, cast(ntile(2) over (order by lon, id) - 1 as varchar) as c from points), b as (select id, lon, lat, c || cast(ntile(2) over (partition by c order by lat, id) - 1 as varchar) as c from a)
  select id, c || cast(ntile(2) over (partition by c order by lon, id) - 1 as varchar) as cell from b"""))
def kdtree_partition_q(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of at most an eighth of the table (rounded up), so three levels at any size."""
    pts = _points(spark, sf).select("id", "lon", "lat")
    return kdtree_partition(pts, "lon", "lat", -(-pts.count() // 8), "id").select("id", "cell")


def tile_grid(extents: DataFrame, key: list[str], tile: float, pixel: float) -> DataFrame:
    """Tiles (x, y, box, pixels) over each extent, edge tiles clipped, at least one each way."""
    nx = F.greatest(F.ceil((F.col("xmax") - F.col("xmin")) / tile), F.lit(1)).cast("int")
    ny = F.greatest(F.ceil((F.col("ymax") - F.col("ymin")) / tile), F.lit(1)).cast("int")
    g = extents.select(*key, "xmin", "ymin", "xmax", "ymax", F.explode(F.sequence(F.lit(0), nx - 1)).alias("tx")).withColumn("ty", F.explode(F.sequence(F.lit(0), ny - 1)))
    x0, y0 = F.col("xmin") + F.col("tx") * tile, F.col("ymin") + F.col("ty") * tile
    x1, y1 = F.least(x0 + tile, F.col("xmax")), F.least(y0 + tile, F.col("ymax"))
    px = lambda d: F.greatest(F.round(d / pixel), F.lit(1)).cast("long")
    return g.select(*key, F.col("tx").cast("long"), F.col("ty").cast("long"), x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"), px(x1 - x0).alias("width_px"), px(y1 - y0).alias("height_px"))


@register("tile_grid", sql("items", """, e as (select collection, round(min(lon), 2) as xmin, round(min(lat), 2) as ymin, round(max(lon), 2) as xmax, round(max(lat), 2) as ymax from items group by collection),
  g as (select *, unnest(range(0, greatest(cast(ceil((xmax - xmin) / 50) as bigint), 1))) as tx from e), h as (select *, unnest(range(0, greatest(cast(ceil((ymax - ymin) / 50) as bigint), 1))) as ty from g)
  select collection, tx, ty, round(xmin + tx * 50.0e0, 6) as x0, round(ymin + ty * 50.0e0, 6) as y0, round(least(xmin + tx * 50.0e0 + 50, xmax), 6) as x1, round(least(ymin + ty * 50.0e0 + 50, ymax), 6) as y1,
    cast(greatest(round((least(xmin + tx * 50.0e0 + 50, xmax) - (xmin + tx * 50.0e0)) / 7.0e0), 1) as bigint) as width_px, cast(greatest(round((least(ymin + ty * 50.0e0 + 50, ymax) - (ymin + ty * 50.0e0)) / 7.0e0), 1) as bigint) as height_px from h"""))
def tile_grid_q(spark: SparkSession, sf: str) -> DataFrame:
    e = view(spark, sf, "items").groupBy("collection").agg(F.round(F.min("lon"), 2).alias("xmin"), F.round(F.min("lat"), 2).alias("ymin"), F.round(F.max("lon"), 2).alias("xmax"), F.round(F.max("lat"), 2).alias("ymax"))
    out = tile_grid(e, ["collection"], 50.0, 7.0)
    return out.withColumns({c: F.round(c, 6) for c in ("x0", "y0", "x1", "y1")})


@register("tile_bounds", sql("points", f", t as (select distinct {_tile_sql(6)[0]} as x, {_tile_sql(6)[1]} as y from points) select x, y, round(x / 64.0e0 * 360 - 180, 6) as w, round(degrees(atan(sinh(pi() * (1 - 2 * (y + 1) / 64.0e0)))), 6) as s, round((x + 1) / 64.0e0 * 360 - 180, 6) as e, round(degrees(atan(sinh(pi() * (1 - 2 * y / 64.0e0)))), 6) as n from t"))
def tile_bounds_q(spark: SparkSession, sf: str) -> DataFrame:
    x, y = B.mercator_tile(F.col("lon"), F.col("lat"), 6)
    t = _points(spark, sf).select(x.alias("x"), y.alias("y")).distinct()
    return t.withColumn("b", B.tile_bounds(F.lit(6), F.col("x"), F.col("y"))).select("x", "y", *[F.round(F.col("b")[i], 6).alias(c) for i, c in enumerate("wsen")])


def spread_sample(df: DataFrame, order: list[str], k: int) -> DataFrame:
    """At most k rows spread evenly over the order, both ends in, with all their columns.

    Positions come from range partitions and their counts (a table of one row a partition), not from one global window. The
    ranges are written once: the counts and the ranks must see the same partitions. A table that lies in order needs none of
    this: ``sources.footers.sample_row_groups`` reads a few of its row groups.
    """
    path = scratch(df.sparkSession, "spread")
    df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()).write.parquet(path)
    ranged = df.sparkSession.read.parquet(path)
    counts = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    base = counts.select("_p", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"), F.sum("_n").over(W.partitionBy(F.lit(1))).alias("_all"))
    pos = ranged.withColumn("_rn", F.row_number().over(W.partitionBy("_p").orderBy(*order))).join(base, "_p").withColumn("_i", F.col("_base") + F.col("_rn") - 1)
    # Row i of n is kept when it is j * (n - 1) div (k - 1) for some j below k.
    at = "((_i * {k} + _all - 2) div (_all - 1)) * (_all - 1) div {k} = _i".format(k=f"{k - 1}L")
    keep = F.expr(f"_all <= {k} or " + (at if k > 1 else "_i = 0")) if k > 0 else F.lit(False)
    return pos.where(keep).select(*df.columns)


@register("spread_sample", sql("points", ", r as (select id, row_number() over (order by lon, id) - 1 as i, count(*) over () as n from points), p as (select distinct cast(floor(j * ((select max(n) from r) - 1) / 99.0e0) as bigint) as i from (select unnest(range(0, 100)) as j) s) select id from r join p on r.i = p.i"))
def spread_sample_q(spark: SparkSession, sf: str) -> DataFrame:
    return spread_sample(_points(spark, sf), ["lon", "id"], 100).select("id")


@register("partition_prune", sql("items", "select l_orderkey, ln from items where collection in (3, 7)"))
def partition_prune_q(spark: SparkSession, sf: str) -> DataFrame:
    return partition_prune(view(spark, sf, "items"), "collection", [3, 7]).select("l_orderkey", "ln")


def partition_prune(df: DataFrame, key: str, values: list) -> DataFrame:
    """Rows of some partitions; on a partitioned table this reaches the scan as a partition filter."""
    return df.where(F.col(key).isin(*values))


def partition_prune_joined(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of the partitions whose key is in ``keys``, which only the run knows: a semi-join by the partition column, of which Spark
    makes a filter on the partitions to read (where the keys' side is filtered itself and small enough to broadcast)."""
    return df.join(keys.select(key).distinct(), key, "left_semi")


@register("partition_prune_joined", sql("items", "select l_orderkey, ln, collection from items where collection in (select s_nationkey from supplier where s_acctbal > 9000)"))
def partition_prune_joined_q(spark: SparkSession, sf: str) -> DataFrame:
    """Items written by collection, read for the nations of rich suppliers."""
    path = scratch(spark, "by_collection")
    view(spark, sf, "items").select("l_orderkey", "ln", "collection").hint("rebalance", "collection").write.partitionBy("collection").parquet(path)
    rich = view(spark, sf, "supplier").where("s_acctbal > 9000").select(F.col("s_nationkey").cast("long").alias("collection"))
    items = spark.read.schema("l_orderkey bigint, ln bigint, collection bigint").parquet(path)
    return partition_prune_joined(items, rich, "collection").select("l_orderkey", "ln", "collection")


def tile_export_select(df: DataFrame, box: tuple[float, float, float, float], where: str | None, columns: list[str], lon: str, lat: str, precision: int) -> DataFrame:
    """Rows and columns for a tile export: box, SQL filter text, named columns, rounded coordinates."""
    w, s, e, n = box
    out = df.where((F.col(lon) >= w) & (F.col(lon) <= e) & (F.col(lat) >= s) & (F.col(lat) <= n))
    out = out.where(F.expr(where)) if where else out
    return out.select(*columns, F.round(lon, precision).alias(lon), F.round(lat, precision).alias(lat))


@register("tile_export_select", sql("points", "select id, collection, round(lon, 3) as lon, round(lat, 3) as lat from points where lon between -50 and 60 and lat between -20 and 45 and price > 100000 and collection <> 'MACHINERY'"))
def tile_export_select_q(spark: SparkSession, sf: str) -> DataFrame:
    return tile_export_select(_points(spark, sf), (-50, -20, 60, 45), "price > 100000 and collection <> 'MACHINERY'", ["id", "collection"], "lon", "lat", 3)
