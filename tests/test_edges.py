"""Edge cases: antimeridian, sentinels, WKB forms, versions, schema imports, pruning plans."""

import struct

import pytest
from pyspark.sql import functions as F

from strataspark.functions import boxes as B
from strataspark.functions import text as T
from strataspark.operators import extents, layout, schemas, versions
from strataspark.sources import files as S
from strataspark.sources import wkb


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def arr(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


@pytest.mark.parametrize(("box", "reason"), [
    ((0, 0, 1, 1), None), ((177, -20, -175, -15), None), ((0, 0, 1), "wrong element count"), ((float("nan"), 0, 1, 1), "west is NaN"), ((0, 0, float("inf"), 1), "east is infinite"),
    ((1.79e308, 0, 1, 1), "exceeds sane magnitude"), ((0, 0, 181, 1), "east out of range"), ((0, 5, 1, 1), "south > north"), ((0, 0, -5, 1, 1, 9), None), ((0, 0, float("nan"), 1, 1, 9), "elevation is not finite"),
])
def test_invalid_reason(spark, box, reason):
    got = one(spark, r=B.invalid_reason(arr(*box)))["r"]
    assert got == reason


def test_antimeridian_parts(spark):
    assert one(spark, p=B.parts(arr(177, -20, -175, -15)))["p"] == [[177, -20, 180, -15], [-180, -20, -175, -15]]


def test_union_antimeridian_spanning_goes_to_both(spark):
    df = spark.createDataFrame([(1, 177.0, -20.0, -175.0, -15.0), (1, -10.0, 0.0, 10.0, 5.0)], "k long, xmin double, ymin double, xmax double, ymax double")
    r = extents.union_antimeridian(df, ["k"]).first()
    assert r["crossing"] and (r["west_xmin"], r["west_xmax"], r["east_xmin"], r["east_xmax"]) == (-180, 10, -10, 180)


def test_measured_bounds_reads_every_item(spark):
    from strataspark import registry
    from strataspark.plans.views import view

    sf = "/root/testdata/sf0.001"
    got = registry.queries()["measured_bounds_items"](spark, sf)
    assert got.count() == view(spark, sf, "items").select("l_orderkey").distinct().count()
    assert got.where("xmin > xmax").count() > 0 and got.where("xmin < xmax").count() > 0


def test_geohash_known(spark):
    assert one(spark, g=B.geohash(F.lit(-5.6), F.lit(42.6), 5))["g"] == "ezs42"


def test_hilbert_is_a_unit_step_bijection(spark):
    df = spark.range(256).select((F.col("id") % 16).alias("x"), F.floor(F.col("id") / 16).alias("y"))
    rows = df.select("x", "y", B.hilbert(F.col("x"), F.col("y"), 4).alias("d")).orderBy("d").collect()
    assert [r["d"] for r in rows] == list(range(256))
    assert all(abs(a["x"] - b["x"]) + abs(a["y"] - b["y"]) == 1 for a, b in zip(rows, rows[1:]))


def test_wkb_forms(spark):
    big = struct.pack(">BIdd", 0, 1, 1.0, 2.0)
    z = struct.pack("<BIddd", 1, 1001, 3.0, 4.0, 5.0)
    srid = struct.pack("<BIIdd", 1, 0x20000001, 4326, 5.0, 6.0)
    ring = [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]
    poly = struct.pack("<BIII", 1, 3, 1, 5) + b"".join(struct.pack("<dd", *p) for p in ring)
    multi = struct.pack("<BII", 1, 7, 2) + big + poly
    empty = struct.pack("<BII", 1, 2, 0)
    rows = [(i, bytearray(g) if g else None) for i, g in enumerate([big, z, srid, poly, multi, empty, None, b"\x01\x02"])]
    got = [tuple(r)[2:] for r in wkb.bbox_columns(spark.createDataFrame(rows, "i int, geometry binary"), centroid=True).orderBy("i").collect()]
    assert got[0] == (1, 2, 1, 2, 1, 2) and got[1] == (3, 4, 3, 4, 3, 4) and got[2][:2] == (5, 6)
    assert got[3] == (0, 0, 4, 4, 2, 2) and got[4] == (0, 0, 4, 4, 2, 2)
    assert all(g == (None,) * 6 for g in got[5:])


def test_versions(spark):
    got = one(spark, a=versions.next_version(F.lit("1.9.3"), F.lit(False)), b=versions.next_version(F.lit("1.9.3"), F.lit(True)), c=versions.next_version(F.lit(None).cast("string"), F.lit(True)),
              d=versions.patch_version(F.lit("1.0.0-beta")), e=versions.patch_version(F.lit("")))
    assert tuple(got) == ("1.10.0", "2.0.0", "1.0.0", "1.0.0-beta.1", "0.0.1")
    assert one(spark, x=T.parse_semver(F.lit("1.10.0")) > T.parse_semver(F.lit("1.9.0")))["x"]


def test_schema_diff_nan_and_added(spark):
    kind = "table_name string, element string, dtype string, nullable boolean, crs string, geometry_type string, nodata double"
    old = spark.createDataFrame([("t", "a", "int64", True, "x", "Point", float("nan")), ("t", "b", "int64", True, "x", "Point", None)], kind)
    new = spark.createDataFrame([("t", "a", "int64", False, "x", "Point", float("nan")), ("t", "c", "int64", True, "x", "Point", None)], kind)
    assert sorted((r["element"], r["change"]) for r in schemas.schema_diff(old, new).collect()) == [("a", "nullable_changed"), ("b", "column_removed")]


def test_import_schema_needs_columns(spark, tmp_path):
    spark.createDataFrame([("a",)], "name string").write.option("header", True).csv(str(tmp_path / "s"))
    with pytest.raises(ValueError, match="dtype"):
        S.import_schema(spark, str(tmp_path / "s"))


def test_export_of_an_empty_table_keeps_its_schema(spark, tmp_path):
    S.export_snapshot(spark.createDataFrame([], "a long, bbox_xmin double"), str(tmp_path / "e"))
    assert spark.read.parquet(str(tmp_path / "e")).dtypes == [("a", "bigint")]


def test_hive_filter_prunes_partitions(spark, tmp_path):
    spark.range(100).withColumn("k", F.col("id") % 5).write.partitionBy("k").parquet(str(tmp_path / "h"))
    plan = S.scan_hive_table(spark, str(tmp_path / "h")).where("k = 3")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(k" in plan


def test_spatial_filter_reaches_the_scan(spark, tmp_path):
    df = spark.range(100).selectExpr("cast(id as double) xmin", "cast(id as double) ymin", "cast(id as double) xmax", "cast(id as double) ymax", "id other")
    df.write.parquet(str(tmp_path / "b"))
    plan = extents.spatial_filter(spark.read.parquet(str(tmp_path / "b")), (1, 1, 5, 5)).select("xmin")._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(xmin,5.0)" in plan and "other" not in plan


def test_approximate_kdtree_is_balanced(spark):
    df = spark.range(4000).select(F.rand(1).alias("x"), F.rand(2).alias("y"))
    counts = [r["count"] for r in layout.kdtree_approx(df, "x", "y", 3).groupBy("cell").count().collect()]
    assert len(counts) == 8 and max(counts) < 1.1 * min(counts)


def test_exact_kdtree_ranks_by_range_partitions(spark):
    df = spark.range(1001).select("id", (F.col("id") * 37 % 11).cast("double").alias("x"), (F.col("id") * 53 % 7).cast("double").alias("y"))
    out = layout.kdtree_exact(df, "x", "y", 3, "id")
    assert sorted(r["count"] for r in out.groupBy("cell").count().collect()) == [125] * 7 + [126]
    plan = layout.kdtree_exact(df, "x", "y", 1, "id")._jdf.queryExecution().executedPlan().toString()
    assert "ntile" not in plan


def test_export_has_a_file_a_partition(spark, tmp_path):
    S.export_snapshot(spark.range(100).repartition(3), str(tmp_path / "e"))
    assert len(list((tmp_path / "e").glob("*.parquet"))) == 3


def test_scan_geojson_reads_every_feature(spark):
    from strataspark import registry
    from strataspark.plans.views import view

    sf = "/root/testdata/sf0.001"
    got = registry.queries()["scan_geojson"](spark, sf)
    want = view(spark, sf, "points").select("id", "collection", "lon")
    assert sorted(map(tuple, got.select("id", "name", "lon").collect())) == sorted(map(tuple, want.collect()))


def test_scan_geojson_parses_a_file_once(spark, tmp_path):
    """No expression on a whole file stands beside or above the explode of its features; odd files give the rows they did."""
    one = '{"type": "Feature", "properties": {"id": %d}, "geometry": null}'
    for name, text in {"good": '{"type": "FeatureCollection", "features": [%s, null, %s]}' % (one % 1, one % 2), "empty": '{"type": "FeatureCollection", "features": []}', "none": '{"type": "FeatureCollection"}', "bad": "{ no", "blank": " "}.items():
        (tmp_path / f"{name}.geojson").write_text(text)
    out = S.scan_geojson(spark, str(tmp_path), ["id"])
    got = sorted((r["file"].split("/")[-1], r["corrupt"], r["id"]) for r in out.collect())
    assert got == [("bad.geojson", True, None), ("blank.geojson", True, None), ("good.geojson", False, "1"), ("good.geojson", False, "2")]
    plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    explode = next(i for i, line in enumerate(plan) if "Generate explode" in line)
    assert not any("get_json_object(value" in line for line in plan[:explode])


def test_scan_stac_items_of_nested_multi_line_and_malformed_documents(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    one = '{"type": "Feature",\n "id": "%s",\n "bbox": [1, 2, 3, 4],\n "properties": {"datetime": "2024-01-02T03:04:05Z"}}'
    (tmp_path / "a" / "x.json").write_text(one % "x")
    (tmp_path / "a" / "b" / "y.json").write_text('{"type": "FeatureCollection", "features": [%s, %s]}' % (one % "y", one % "z"))
    (tmp_path / "a" / "bad.json").write_text('{"type": "Feature", "id": ')
    (tmp_path / "catalog.json").write_text('{"type": "Catalog", "id": "c"}')
    got = sorted((r["id"], r["file"].split("/")[-1], r["datetime"].day) for r in S.scan_stac_items(spark, str(tmp_path)).collect())
    assert got == [("x", "x.json", 2), ("y", "y.json", 2), ("z", "y.json", 2)]


def test_scan_stac_items_query_runs_the_operator(spark, monkeypatch):
    from strataspark import registry
    from strataspark.plans.views import view

    calls, scan = [], S.scan_stac_items
    monkeypatch.setattr(S, "scan_stac_items", lambda *a: calls.append(a) or scan(*a))
    got = registry.queries()["scan_stac_items"](spark, "/root/testdata/sf0.001")
    want = view(spark, "/root/testdata/sf0.001", "points").selectExpr("concat('i', id)", "collection", "lon")
    assert sorted(map(tuple, got.select("id", "collection", "west").collect())) == sorted(map(tuple, want.collect())) and calls


def batch(spark, rows, kind="asset string, v int"):
    df = spark.createDataFrame(rows, kind)
    return df, df.groupBy("asset").agg(F.sha2(F.count("*").cast("string"), 256).alias("sha256"), F.count("*").alias("size_bytes"))


def test_two_writers_both_land(spark, tmp_path, monkeypatch):
    """The number is taken while a writer prepares its entry: it rebases on the other's state, its data written once."""
    root, commit = str(tmp_path), S._commit
    S.publish(spark, root, "c", *batch(spark, [("a", 1)]), "1.0.0")

    def late(session, log, base, n):
        monkeypatch.setattr(S, "_commit", commit)
        assert S.publish(spark, root, "c", *batch(spark, [("b", 2)]), "1.1.0", removed=["a"]) == 2
        return commit(session, log, base, n)

    monkeypatch.setattr(S, "_commit", late)
    assert S.publish(spark, root, "c", *batch(spark, [("d", 3)]), "1.2.0") == 3
    assert sorted((r["asset"], r["v"], r["version"]) for r in S.read_version(spark, root, "c").collect()) == [("b", 2, "1.1.0"), ("d", 3, "1.2.0")]
    assert [r["asset"] for r in S.read_version(spark, root, "c", 1).collect()] == ["a"]
    assert len(list((tmp_path / "c/data/version=1.2.0").iterdir())) == 1 and not list((tmp_path / "c/_staging").iterdir())


def test_one_version_of_two_writers_is_an_error(spark, tmp_path, monkeypatch):
    commit = S._commit

    def late(session, log, base, n):
        monkeypatch.setattr(S, "_commit", commit)
        S.publish(spark, str(tmp_path), "c", *batch(spark, [("b", 2)]), "1.0.0")
        return commit(session, log, base, n)

    monkeypatch.setattr(S, "_commit", late)
    with pytest.raises(ValueError, match="another writer"):
        S.publish(spark, str(tmp_path), "c", *batch(spark, [("a", 1)]), "1.0.0")
    assert [r["asset"] for r in S.read_version(spark, str(tmp_path), "c").collect()] == ["b"]


def test_reader_opens_live_versions_alone(spark, tmp_path):
    """Replaced and lost versions are not listed; columns come from the log, widened, also where a version lacks one."""
    root = str(tmp_path)
    S.publish(spark, root, "c", *batch(spark, [("a", 1), ("k", 5)]), "1.0.0")
    S.publish(spark, root, "c", *batch(spark, [("a", 2)]), "1.1.0")
    batch(spark, [("a", 9)])[0].write.parquet(f"{root}/c/data/version=9.9.9/batch=lost")
    S.publish(spark, root, "c", *batch(spark, [("a", 2**40, 0.5)], "asset string, v long, extra double"), "1.2.0")
    out = S.read_version(spark, root, "c")
    assert sorted(map(tuple, out.select("asset", "v", "extra", "version").collect()), key=str) == sorted([("a", 1, None, "1.0.0"), ("k", 5, None, "1.0.0"), ("a", 2, None, "1.1.0"), ("a", 2**40, 0.5, "1.2.0")], key=str)
    S.publish(spark, root, "c", *batch(spark, [("a", 7), ("k", 8)]), "2.0.0", replace_asset=True)
    newest = S.read_version(spark, root, "c")
    assert all("version=2.0.0" in f for f in newest.inputFiles() if "/data/" in f) and newest.columns == ["asset", "v", "version"] and newest.count() == 2
    assert not any("9.9.9" in f for f in out.inputFiles())
    S.publish(spark, root, "c", *batch(spark, [("z", "text")], "asset string, v string"), "2.1.0", removed=["a", "k"])
    assert [tuple(r) for r in S.read_version(spark, root, "c").collect()] == [("z", "text", "2.1.0")]
    S.publish(spark, root, "c", *batch(spark, [("a", 1)]), "2.2.0")
    with pytest.raises(ValueError, match="column v"):
        S.read_version(spark, root, "c")


def test_missing_version_is_an_error(spark, tmp_path):
    with pytest.raises(ValueError):
        S.read_version(spark, str(tmp_path), "none")


def test_wkb_centroids_follow_ring_order_not_winding(spark):
    square = lambda x, y, s, back=False: [(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)][:: -1 if back else 1]
    ring = lambda r: struct.pack("<I", len(r)) + b"".join(struct.pack("<dd", *p) for p in r)
    polygon = lambda *rings: struct.pack("<BII", 1, 3, len(rings)) + b"".join(map(ring, rings))
    multi = struct.pack("<BII", 1, 6, 2) + polygon(square(0, 0, 2)) + polygon(square(10, 0, 1, back=True))
    shapes = [multi, polygon(square(0, 0, 10), square(6, 6, 2)), polygon(square(0, 0, 10), square(6, 6, 2, back=True)), polygon(square(0, 0, 10, back=True), square(6, 6, 2))]
    df = spark.createDataFrame([(i, bytearray(g)) for i, g in enumerate(shapes)], "i int, geometry binary")
    got = [(r["centroid_x"], r["centroid_y"]) for r in wkb.bbox_columns(df, centroid=True).orderBy("i").collect()]
    holed = (100 * 5 - 4 * 7) / 96
    assert got[0] == pytest.approx(((4 * 1 + 1 * 10.5) / 5, (4 * 1 + 1 * 0.5) / 5))
    assert all(g == pytest.approx((holed, holed)) for g in got[1:])


@pytest.mark.parametrize(("text", "plain"), [("Plzeň", "Plzen"), ("Győr", "Gyor"), ("ﬁle", "file"), ("Ｅｓｒｉ", "Esri"), ("données", "donnees"), ("½ x", "12 x"), ("世", ""), ("abc", "abc"), (None, None)])
def test_ascii_fold(spark, text, plain):
    assert one(spark, x=T.ascii_fold(F.lit(text).cast("string")))["x"] == plain


@pytest.mark.parametrize(("text", "technical"), [
    ("wa_river_line_v7", True), ("gis:RoadAxis", True), ("wells", True), ("plots1999", True), ("K9", True), ("", True), (None, True), ("   ", True), ("OldHarbourQuay", False), ("UNESCO", False),
    ("Comarca", False), ("Åland", False), ("Rivers - wa_river_line", False), ("averyverylonglowercasename", False), (" layer1 ", True),
])
def test_technical_name(spark, text, technical):
    assert one(spark, x=T.technical_name(F.lit(text).cast("string")))["x"] is technical


def test_best_description_falls_back(spark):
    pick = lambda t, a, n="layer": one(spark, x=T.best_description(*[F.lit(v).cast("string") for v in (t, a, n)]))["x"]
    assert pick("A title", "An abstract") == "An abstract" and pick("A title", "abs_1") == "A title" and pick("Layer", "abs_1") == "abs_1"
    assert pick("my-layer", "abs_1") == "my-layer" and pick(None, "abs_1") == "abs_1" and pick(None, None) is None


def test_humanize_keeps_long_words(spark):
    assert one(spark, x=T.humanize_slug(F.lit("a/b/" + "w" * 1500 + "-IGN")))["x"] == "W" + "w" * 1499 + " IGN"


def test_publish_takes_a_version_once(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, asset string")
    assets = df.selectExpr("asset", "asset as sha256", "id as size_bytes")
    root = str(tmp_path / "t")
    S.publish(spark, root, "c", df, assets, "1.0.0")
    S.publish(spark, root, "c", df, assets, "1.0.0")
    df.write.mode("overwrite").parquet(f"{root}/c/data/version=1.1.0")  # a publish that was lost before its log row
    assert S.read_version(spark, root, "c").count() == 2
    S.publish(spark, root, "c", df, assets, "1.1.0")
    assert S.read_version(spark, root, "c").count() == 4
