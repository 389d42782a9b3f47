"""Sampled kd-trees, pruning at run time, boxes over the antimeridian, footprints: properties and plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataspark.functions import boxes as B
from strataspark.operators import extents, layout


def boxes_overlap(rows):
    return [(a["cell"], b["cell"]) for i, a in enumerate(rows) for b in rows[:i] if a["x1"] > b["x0"] and b["x1"] > a["x0"] and a["y1"] > b["y0"] and b["y1"] > a["y0"]]


@pytest.mark.parametrize(("target", "first", "sample"), [(100, 10, 1 << 18), (100, 2, 400), (5000, 10, 100), (40, 0, 50)])
def test_sampled_kdtree(spark, target, first, sample):
    """Small samples, few first levels, clustered points: all rows placed, cells of bounded size that don't overlap."""
    rng = np.random.default_rng(7)
    xy = np.concatenate([rng.normal(size=(2500, 2)), 50 + rng.normal(size=(1500, 2)) / 100])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(xy)], "id long, x double, y double")
    out = layout.kdtree_sampled(df, "x", "y", target, sample, first)
    assert out.columns == ["id", "x", "y", "cell"] and out.select("id").distinct().count() == 4000
    rows = out.groupBy("cell").agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).collect()
    assert max(r["n"] for r in rows) <= 2.5 * target and not boxes_overlap(rows)
    names = [r["cell"] for r in rows]
    assert not any(a != b and b.startswith(a) for a in names for b in names)


def test_kdtree_of_ties_nulls_and_nothing(spark):
    df = spark.createDataFrame([(1.0, 1.0)] * 50 + [(None, 2.0), (None, None)], "x double, y double")
    assert layout.kdtree_sampled(df, "x", "y", 10).count() == 52
    assert layout.kdtree_sampled(df.where("false"), "x", "y", 10).count() == 0
    assert {r["cell"] for r in layout.kdtree_approx(df.where("false").union(df.limit(1)), "x", "y", 0).collect()} == {""}


def test_deep_approximate_kdtree(spark, monkeypatch):
    monkeypatch.setattr(layout, "FIRST", 2)
    df = spark.range(8000).select(F.rand(1).alias("x"), F.rand(2).alias("y"))
    counts = [r["count"] for r in layout.kdtree_approx(df, "x", "y", 5).groupBy("cell").count().collect()]
    assert len(counts) == 32 and max(counts) < 1.6 * min(counts)


def test_partitions_are_pruned_at_run_time(spark, tmp_path):
    spark.range(3000).selectExpr("id", "id % 30 as k").write.partitionBy("k").parquet(str(tmp_path / "t"))
    spark.range(30).selectExpr("id as k", "id * 2 as w").write.parquet(str(tmp_path / "d"))
    table = spark.read.parquet(str(tmp_path / "t"))
    out = layout.partition_prune_joined(table, spark.read.parquet(str(tmp_path / "d")).where("w > 50"), "k")
    assert "dynamicpruning" in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 400


def wgs(spark, *box, **options):
    df = spark.createDataFrame([(1, *map(float, box))], "k long, xmin double, ymin double, xmax double, ymax double")
    r = extents.bbox_to_wgs84(df, ["k"], **options).first()
    return tuple(round(r[c], 6) for c in ("xmin", "ymin", "xmax", "ymax"))


def test_boxes_over_the_antimeridian(spark):
    metres = lambda lon: np.radians(lon) * 6378137.0
    assert wgs(spark, metres(170), 0, metres(200), 1e5)[::2] == (170, -160)
    assert wgs(spark, metres(-190), 0, metres(-170), 1e5)[::2] == (170, -170)
    assert wgs(spark, metres(-100), 0, metres(120), 1e5)[::2] == (-100, 120)
    assert wgs(spark, metres(150), 0, metres(350), 1e5)[::2] == (150, -10)
    assert wgs(spark, metres(-180), 0, metres(180), 1e5)[::2] == (-180, 180)
    assert wgs(spark, metres(5), 0, metres(5), 1e5)[::2] == (5, 5)


def test_boxes_to_degrees_in_closed_form(spark):
    """No array of samples is built a row; ends in any order; ten steps of a box of 10 / 11 of the circle are the whole circle."""
    metres = lambda lon: np.radians(lon) * 6378137.0
    df = spark.createDataFrame([(1, 1e7, 0.0, 2e7, 1e6)], "k long, xmin double, ymin double, xmax double, ymax double")
    plan = extents.bbox_to_wgs84(df, ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(" not in plan and "forall(" not in plan and "lambda" not in plan
    assert wgs(spark, metres(120), 1e5, metres(-100), 0) == wgs(spark, metres(-100), 0, metres(120), 1e5)
    assert wgs(spark, metres(10), 0, metres(10 + 327), 1e5)[::2] == (10, -23)
    for width in (327.3, 360, 800, 5000):
        assert wgs(spark, metres(10), 0, metres(10 + width), 1e5)[::2] == (-180, 180)


def test_boxes_of_the_wrong_system(spark):
    assert wgs(spark, 170, -10, -170, 10, crs=None) == (170, -10, -170, 10)
    assert wgs(spark, 1, 2, 3, 4, allow_guess=True) == (1, 2, 3, 4)
    assert wgs(spark, 1e6, 0, 2e6, 1, crs="EPSG:4326", allow_guess=True) == (1e6, 0, 2e6, 1)
    for box, options in (((1, 2, 3, 4), {}), ((1e6, 0, 2e6, 1), {"crs": None}), ((float("nan"), 0, 1, 1), {}), ((float("inf"), 0, 1e7, 1), {"allow_guess": True})):
        with pytest.raises(Exception, match="box is not finite|beyond longitude|projected system"):
            wgs(spark, *box, **options)
    with pytest.raises(ValueError):
        wgs(spark, 0, 0, 1, 1, crs="EPSG:32610")


def inside(ring, x, y):
    hit = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        if (ay > y) != (by > y) and ax + (y - ay) * (bx - ax) / (by - ay) > x:
            hit = not hit
    return hit


def test_footprints(spark):
    """Random rings against a box, told by dense points on edges and in the box."""
    rng = np.random.default_rng(6)
    area, t = (-1.0, -0.5, 1.5, 2.0), np.linspace(0, 1, 2001)
    rings = [[(float(a), float(b)) for a, b in rng.normal(size=(2,)) * 4 + rng.normal(size=(int(rng.integers(3, 8)), 2)) * rng.choice([0.5, 3.0])] for _ in range(300)]
    rings += [[(-9, -9), (9, -9), (9, 9), (-9, 9)], [(1.5, 0), (3, 0), (3, 1)], [(0, 0), (0.1, 0), (0, 0.1)], [(0.0, 5.0), (0.0, -5.0)], [(9, 9)], [(0, 0)], []]
    want = []
    for ring in rings:
        edge = any((((ax + t * (bx - ax) >= area[0]) & (ax + t * (bx - ax) <= area[2])) & ((ay + t * (by - ay) >= area[1]) & (ay + t * (by - ay) <= area[3]))).any() for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]))
        want.append(bool(edge or inside(ring, area[0], area[1])))
    box = lambda r: (min(x for x, _ in r), min(y for _, y in r), max(x for x, _ in r), max(y for _, y in r)) if r else (0.0, 0.0, 0.0, 0.0)
    df = spark.createDataFrame([(i, [(float(x), float(y)) for x, y in r], *map(float, box(r))) for i, r in enumerate(rings)] + [(999, None, 0.0, 0.0, 0.0, 0.0)], "id long, ring array<struct<x: double, y: double>>, xmin double, ymin double, xmax double, ymax double")
    got = {r["id"] for r in extents.footprint_filter(df, area).collect()}
    by_box = {r["id"] for r in extents.spatial_filter(df, area).collect()}
    assert got == {i for i, w in enumerate(want) if w} and len(by_box - got) > 10


def test_footprints_that_touch_the_area(spark):
    """Slanting sides through a corner of the area: the answer is the side of the corner, as the query's SQL has it."""
    import duckdb

    rows = []
    for k in range(40):
        for j in range(0, 60, 3):
            lat = (j * 71 % 4000) / 100.0 - 10
            rows += [(k + 40 * j, 1, 30 + lat, lat), (k + 40 * j, 2, -10 - lat, lat)]
    df = spark.createDataFrame(rows, "l_orderkey long, ln long, lon double, lat double").selectExpr("*", "0.5D + (l_orderkey % 40) / 2D as w")
    shapes = df.selectExpr("l_orderkey", "ln", f"{extents._TRIANGLE} as ring", "lon - w as xmin", "lat - w as ymin", "lon + w as xmax", "lat + w as ymax")
    got = {tuple(r) for r in extents.footprint_filter(shapes, extents._AREA).select("l_orderkey", "ln").collect()}
    con = duckdb.connect()
    con.execute("create table items (l_orderkey bigint, ln bigint, lon double, lat double)")
    con.executemany("insert into items values (?, ?, ?, ?)", rows)
    want = set(con.execute(extents._footprint_sql()).fetchall())
    assert got == want and len(want) > 100


def test_footprint_filter_prunes_row_groups(spark, tmp_path):
    df = spark.range(100).selectExpr("id", "array(named_struct('x', cast(id as double), 'y', 0D)) as ring", "cast(id as double) xmin", "0D ymin", "cast(id as double) xmax", "0D ymax")
    df.write.parquet(str(tmp_path / "f"))
    out = extents.footprint_filter(spark.read.parquet(str(tmp_path / "f")), (5, -1, 9, 1))
    assert "LessThanOrEqual(xmin,9.0)" in out._jdf.queryExecution().executedPlan().toString() and out.count() == 5


def test_looks(spark):
    assert spark.range(1).select(B.looks_like_wgs84(F.array(*map(F.lit, (1.0, 2.0, 3.0, 4.0))))).first()[0]
