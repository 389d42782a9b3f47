"""Round trips of the sources and sinks over tables derived from the driver's, each read back through its scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspark.plans.views import sql, view
from strataspark.registry import register
from strataspark.session import scratch, ship
from strataspark.sources import files as S
from strataspark.sources import footers
from strataspark.sources import wkb


@register("scan_hive_table", "select l_returnflag, l_linestatus, cast(count(*) as bigint) as n, cast(sum(l_orderkey) as bigint) as keys from lineitem where l_returnflag = 'A' group by 1, 2")
def scan_hive_table_q(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch(spark, "hive")
    view(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus").write.partitionBy("l_returnflag", "l_linestatus").parquet(root)
    return S.scan_hive_table(spark, root).where("l_returnflag = 'A'").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("keys"))


@register("scan_geojson", sql("points", "select id, collection as name, 'Point' as geometry_type, lon from points"))
def scan_geojson_q(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch(spark, "geojson")
    feature = F.concat(F.lit('{"type":"Feature","properties":{"id":'), F.col("id").cast("string"), F.lit(',"name":"'), "collection", F.lit('"},"geometry":{"type":"Point","coordinates":['), F.col("lon").cast("string"), F.lit(","), F.col("lat").cast("string"), F.lit("]}}"))
    doc = view(spark, sf, "points").groupBy(F.floor(F.col("id") / 4000).alias("k")).agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.collect_list(feature), ","), F.lit("]}")).alias("value"))
    doc.select("value").write.option("maxRecordsPerFile", 1).text(root)  # one document a file, of at most 4000 features
    out = S.scan_geojson(spark, root, ["id", "name"])
    return out.select(F.col("id").cast("long").alias("id"), F.col("name"), "geometry_type", F.get_json_object("geometry", "$.coordinates[0]").cast("double").alias("lon"))


@register("scan_tabular", "select c_custkey, c_name, c_acctbal, c_mktsegment from customer")
def scan_tabular_q(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch(spark, "csv")
    view(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment").write.option("header", True).option("sep", "\t").csv(root)
    return S.scan_tabular(spark, root, "\t").withColumn("c_custkey", F.col("c_custkey").cast("long"))


@register("scan_stac_items", sql("points", "select 'i' || cast(id as varchar) as id, collection, lon as west, strftime(ts, '%Y-%m-%d') as day from points"))
def scan_stac_items_q(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch(spark, "items")
    pts = view(spark, sf, "points")
    item = F.struct(F.lit("Feature").alias("type"), F.concat(F.lit("i"), F.col("id").cast("string")).alias("id"), F.array("lon", "lat", "lon", "lat").alias("bbox"), F.col("collection"), F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("datetime")).alias("properties"))
    # An item collection a file, of at most 4000 items, in nested folders: files grow with the table, and one can be read whole.
    doc = pts.groupBy(F.floor(F.col("id") / 4000).alias("k")).agg(F.collect_list(item).alias("features"))
    doc.select(F.lit("FeatureCollection").alias("type"), "features", (F.col("k") % 10).alias("part")).write.partitionBy("part").option("maxRecordsPerFile", 1).option("compression", "none").json(root)
    df = S.scan_stac_items(spark, root)
    return df.select("id", "collection", F.col("bbox")[0].alias("west"), F.date_format("datetime", "yyyy-MM-dd").alias("day"))


@register("scan_versions", sql("assets", "select collection, ord, cast(count(*) as bigint) as assets, cast(sum(size_bytes) as bigint) as size_bytes from assets group by collection, ord"))
def scan_versions_q(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch(spark, "manifests")
    a = view(spark, sf, "assets")
    entry = F.map_from_entries(F.collect_list(F.struct("asset", F.struct("sha256", "size_bytes", F.col("asset").alias("href")).alias("a"))))
    v = a.groupBy("collection", "ord", "version").agg(entry.alias("assets"))
    doc = v.groupBy("collection").agg(F.array_sort(F.collect_list(F.struct("ord", "version", "assets")), lambda x, y: (x["ord"] - y["ord"]).cast("int")).alias("versions"), F.max("version").alias("current_version"))
    text = F.to_json(F.struct(F.lit("1").alias("spec_version"), "current_version", F.transform("versions", lambda x: F.struct(x["version"].alias("version"), x["assets"].alias("assets"), F.lit("2024-01-01T00:00:00Z").alias("created"))).alias("versions")))
    doc.repartition("collection").select(text.alias("value"), "collection").write.partitionBy("collection").text(root)
    versions, assets, _ = S.scan_versions(spark, root)
    key = F.regexp_extract("file", r"collection=(\d+)", 1).cast("long")
    return assets.select(key.alias("collection"), F.regexp_extract("version", r"\.(\d+)\.", 1).cast("long").alias("v"), "size_bytes").groupBy("collection", (F.col("v") + 1).alias("ord")).agg(F.count("*").alias("assets"), F.sum("size_bytes").alias("size_bytes"))


@register("scan_files", "select 'parquet' as ext, cast(count(distinct l_linestatus) as bigint) as folders, cast(0 as bigint) as missing, cast(0 as bigint) as strange, true as sized from lineitem")
def scan_files_q(spark: SparkSession, sf: str) -> DataFrame:
    """The listing of a table against the files that a read of its rows meets."""
    root = scratch(spark, "listing")
    view(spark, sf, "lineitem").select("l_linestatus", "l_tax").write.partitionBy("l_linestatus").parquet(root)
    plain = F.regexp_replace("path", "^file:/+", "/")
    listed = S.scan_files(spark, root).where("ext = 'parquet'").select(plain.alias("path"), "size_bytes", "ext")
    met = spark.read.parquet(root).select(F.input_file_name().alias("path")).distinct().select(plain.alias("path"), F.lit(True).alias("met"))
    both = listed.join(met, "path", "full")
    return both.agg(F.max("ext").alias("ext"), F.countDistinct(F.regexp_extract("path", "l_linestatus=([^/]*)/", 1)).alias("folders"), F.count_if(F.col("size_bytes").isNull()).alias("missing"), F.count_if(F.col("met").isNull()).alias("strange"), F.bool_and(F.col("size_bytes") > 0).alias("sized"))


@register("scan_parquet_footers", 'select \'l_orderkey\' as "column", cast(count(*) as bigint) as rows, cast(min(l_orderkey) as varchar) as lo, cast(max(l_orderkey) as varchar) as hi from lineitem')
def scan_parquet_footers_q(spark: SparkSession, sf: str) -> DataFrame:
    ship(spark)
    files = spark.read.format("binaryFile").load(f"{sf}/lineitem.parquet").select("path")
    f = S.scan_parquet_footers(files).where("column = 'l_orderkey'")
    return f.groupBy("column").agg(F.sum("rows").alias("rows"), F.min(F.col("min").cast("long")).cast("string").alias("lo"), F.max(F.col("max").cast("long")).cast("string").alias("hi"))


_FLAT = {"l_orderkey": "l_orderkey", "l_returnflag": "l_returnflag", "l_linenumber": "l_linenumber", "half": "case when l_linenumber % 2 = 0 then l_partkey end", "l_quantity": "l_quantity", "shipped": "l_shipdate"}


@register("column_statistics_footers", " union all ".join(f"""select '{c}' as "column", cast(min({e}) as varchar) as "min", cast(max({e}) as varchar) as "max", cast(count(*) - count({e}) as bigint) as null_count from lineitem""" for c, e in _FLAT.items()))
def column_statistics_footers_q(spark: SparkSession, sf: str) -> DataFrame:
    """Of a table written here: its timestamps have no statistics in footers, so those chunks alone are read."""
    path = scratch(spark, "measured")
    view(spark, sf, "lineitem").select(*[F.expr(e).alias(c) for c, e in _FLAT.items()], F.array("l_tax").alias("nested")).write.parquet(path)
    return footers.column_statistics(spark, path)


@register("spread_sample_groups", sql("points", "select cast(least(100, count(*)) as bigint) as n, (select lon from points order by lon, id limit 1) as first_lon, (select id from points order by lon, id limit 1) as first_id, (select lon from points order by lon desc, id desc limit 1) as last_lon, (select id from points order by lon desc, id desc limit 1) as last_id from points"))
def spread_sample_groups_q(spark: SparkSession, sf: str) -> DataFrame:
    """100 rows of a table written in order of longitude, from few of its row groups: its first and its last row are in."""
    path = scratch(spark, "in_order")
    view(spark, sf, "points").select("id", "lon", "lat", "collection").repartitionByRange("lon", "id").sortWithinPartitions("lon", "id").write.option("parquet.block.size", 1 << 16).parquet(path)
    s = footers.sample_row_groups(spark, path, 100, ["lon", "id"])
    ends = s.agg(F.count("*").alias("n"), F.min(F.struct("lon", "id")).alias("a"), F.max(F.struct("lon", "id")).alias("b"))
    return ends.select("n", F.col("a.lon").alias("first_lon"), F.col("a.id").alias("first_id"), F.col("b.lon").alias("last_lon"), F.col("b.id").alias("last_id"))


@register("sink_hive_partitioned", sql("points", "select collection, cast(count(*) as bigint) as n from points group by collection"))
def sink_hive_partitioned_q(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch(spark, "cells")
    S.sink_hive_partitioned(view(spark, sf, "points"), root, "collection", ["lon"])
    return S.scan_hive_table(spark, root).groupBy("collection").agg(F.count("*").alias("n"))


@register("sink_items_mirror", sql("items", "select l_orderkey, ln from items where xmin <= 20 and xmax >= 0 and ymin <= 20 and ymax >= 0"))
def sink_items_mirror_q(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "items.parquet")
    items = view(spark, sf, "items").withColumn("href", F.col("collection").cast("string"))
    S.sink_items_mirror(items, items.select("href").distinct(), path)
    return spark.read.parquet(path).where("xmin <= 20 and xmax >= 0 and ymin <= 20 and ymax >= 0").select("l_orderkey", "ln")


@register("sink_versioned_table", "select p_type as asset, cast(count(*) as bigint) as n, case when p_type = 'ECONOMY' then 1 else 2 end as batches from part where p_type <> 'SMALL' and not (p_type <> 'ECONOMY' and p_partkey < 0) group by 1, 3")
def sink_versioned_table_q(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch(spark, "versioned")
    p = view(spark, sf, "part").select("p_partkey", F.col("p_type").alias("asset"))
    assets = lambda d: d.groupBy("asset").agg(F.sha2(F.count("*").cast("string"), 256).alias("sha256"), F.count("*").alias("size_bytes"))
    one, two = p.where("p_partkey % 2 = 0 or asset = 'ECONOMY'"), p.where("p_partkey % 2 = 1 and asset <> 'ECONOMY'").withColumn("extra", F.lit(1))
    S.publish(spark, root, "c", one, assets(one), "1.0.0")
    S.publish(spark, root, "c", two, assets(two), "1.1.0", message="odd rows", removed=["SMALL"])
    return S.read_version(spark, root, "c").groupBy("asset").agg(F.count("*").alias("n"), F.countDistinct("version").cast("int").alias("batches"))


@register("export_snapshot", sql("points", "select id, collection from points"))
def export_snapshot_q(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "snapshot")
    S.export_snapshot(view(spark, sf, "points").select("id", "collection", F.col("lon").alias("bbox_xmin")), path)
    return spark.read.parquet(path)


_SCHEMA = "select table_name || '.' || element as name, dtype, nullable, case when isnan(nodata) then null else nodata end as nodata from schemas where version = 0"


def _schema_rows(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "schemas").where("version = 0").select(F.concat_ws(".", "table_name", "element").alias("name"), "dtype", "nullable", F.when(~F.isnan("nodata"), F.col("nodata")).alias("nodata"))


@register("export_schema", sql("schemas", _SCHEMA))
def export_schema_q(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "schema_json")
    S.export_schema(_schema_rows(spark, sf), path, "json")
    return spark.read.schema("name string, dtype string, nullable boolean, nodata double").json(path)


@register("import_schema", sql("schemas", _SCHEMA.replace(" as nodata from", " as nodata, cast(null as varchar) as description from")))
def import_schema_q(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "schema_csv")
    S.export_schema(_schema_rows(spark, sf), path, "csv")
    return S.import_schema(spark, path, "csv")


@register("split_layers", sql("points", "select collection, cast(count(*) as bigint) as rows, 'success' as status from points group by collection"))
def split_layers_q(spark: SparkSession, sf: str) -> DataFrame:
    return S.split_layers(view(spark, sf, "points"), "collection", scratch(spark, "layers"))


@register("partition_metadata", "select 'd' || cast(event_id % 3 as varchar) as root, case when event_id % 3 = 0 then 'year,month' else 'geohash' end as keys, cast(count(*) as bigint) as files, case when event_id % 3 = 0 then 'temporal' else 'spatial' end as strategy from events group by 1, 2, 4")
def partition_metadata_q(spark: SparkSession, sf: str) -> DataFrame:
    e = view(spark, sf, "events").select(F.expr("concat('d', event_id % 3, case when event_id % 3 = 0 then '/year=2024/month=1/' else '/geohash=ab/' end, event_id, '.parquet')").alias("path"))
    return S.partition_metadata(e)


#: Of each shape (by id % 7) the box and the centroid, from the point (lon, lat) it is made at.
_SHAPES = {"bbox_xmin": (0, 0, 0, 0, 0, 0, -2), "bbox_ymin": (0, 0, 0, -1, 0, 0, 0), "bbox_xmax": (0, 1, 3, 2, 1, 13, 1), "bbox_ymax": (0, 2, 3, 0, 2, 13, 5), "centroid_x": (0, 0.5, 1, 1, 0.5, 6, 0.5), "centroid_y": (0, 1, 1, -0.5, 1, 6, 1)}


@register("bbox_columns_wkb", sql("points", "select id, " + ", ".join(f"round({'lat' if 'y' in c else 'lon'} + case id % 7 {' '.join(f'when {k} then {float(d)}e0' for k, d in enumerate(ds))} end, 6) as {c}" for c, ds in _SHAPES.items()) + " from points"))
def bbox_columns_wkb_q(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes and centroids of WKB of all seven types in one column, made from the points view; must equal what they were made from."""
    ship(spark)
    pts = view(spark, sf, "points").select("id", "lon", "lat")
    out = wkb.bbox_columns(pts.mapInArrow(_to_wkb, "id long, geometry binary"), centroid=True)
    return out.select("id", *[F.round(c, 6).alias(c) for c in _SHAPES])


def _to_wkb(batches):
    """Shapes as rows of fixed layouts: headers as numbers, coordinates as offsets from the point. The last kind turns its bytes round."""
    import numpy as np
    import pyarrow as pa

    line, triangle = [(0, 0), (1, 2)], [(0, 0), (3, 0), (0, 3), (0, 0)]
    far = [(x + 10, y + 10) for x, y in triangle]
    point = lambda p: [("h", 1), ("xy", [p])]
    path = lambda ps: [("h", 2), ("n", len(ps)), ("xy", ps)]
    ring = lambda ps: [("h", 3), ("n", 1), ("n", len(ps)), ("xy", ps)]
    many = lambda kind, *parts: [("h", kind), ("n", len(parts)), *[x for p in parts for x in p]]
    shapes = [point((0, 0)), path(line), ring(triangle), many(4, point((0, 0)), point((2, -1))), many(5, path(line)), many(6, ring(triangle), ring(far)), many(7, point((-2, 5)), path(line))]
    for b in batches:
        ids, lon, lat = (c.to_numpy() for c in b.columns)
        out = np.empty(len(ids), dtype=object)
        for k, shape in enumerate(shapes):
            at, order = np.flatnonzero(ids % 7 == k), ">" if k == 6 else "<"
            parts = []
            for kind, v in shape:
                if kind == "h":
                    parts += [np.full((len(at), 1), order == "<", dtype=np.uint8), np.full((len(at), 1), v, dtype=f"{order}u4")]
                elif kind == "n":
                    parts.append(np.full((len(at), 1), v, dtype=f"{order}u4"))
                else:
                    parts.append(np.stack([c[at] + d for p in v for c, d in zip((lon, lat), p)], axis=1).astype(f"{order}f8"))
            rows = np.concatenate([np.ascontiguousarray(p).view(np.uint8).reshape(len(at), -1) for p in parts], axis=1)
            out[at] = [r.tobytes() for r in rows]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out.tolist(), type=pa.binary())], names=["id", "geometry"])
