"""Listings against manifests: status, freshness, orphans, structure checks and their summaries.

A listing row is (path, dir, name, stem, ext, collection, size_bytes, mtime); a manifest row is the stored state of a path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspark.functions import text as T
from strataspark.plans.views import sql, view
from strataspark.registry import register


def _files(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "files")


def _stored(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "stored")


def asset_status(files: DataFrame, stored: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """tracked, modified, untracked or deleted per path: one full outer join of listing and manifest."""
    s = stored.select("path", F.col("size_bytes").alias("s_size"), F.col("mtime").alias("s_mtime"), F.col("collection").alias("s_collection"))
    both = files.select("path", "collection", "size_bytes", "mtime").join(s, "path", "full")
    same = (F.col("size_bytes") == F.col("s_size")) & (F.abs(F.col("mtime") - F.col("s_mtime")) < tolerance)
    status = F.when(F.col("s_size").isNull(), "untracked").when(F.col("size_bytes").isNull(), "deleted").when(same, "tracked").otherwise("modified")
    return both.select("path", F.coalesce("collection", "s_collection").alias("collection"), status.alias("status"))


_STATUS = "select coalesce(f.path, s.path) as path, coalesce(f.collection, s.collection) as collection, case when s.path is null then 'untracked' when f.path is null then 'deleted' when f.size_bytes = s.size_bytes and abs(f.mtime - s.mtime) < 0.001 then 'tracked' else 'modified' end as status from files f full join stored s on f.path = s.path"


@register("asset_status", sql("stored", _STATUS))
def asset_status_q(spark: SparkSession, sf: str) -> DataFrame:
    return asset_status(_files(spark, sf), _stored(spark, sf))


def uncommitted_changes(files: DataFrame, stored: DataFrame) -> DataFrame:
    """Manifest paths that are missing, or whose cheap test (mtime within 1 ms, size) fails; only those need a checksum."""
    f = files.select("path", F.col("size_bytes").alias("f_size"), F.col("mtime").alias("f_mtime"))
    both = stored.join(f, "path", "left")
    clean = (F.abs(F.col("mtime") - F.col("f_mtime")) < 0.001) & (F.col("size_bytes") == F.col("f_size"))
    return both.where(~F.coalesce(clean, F.lit(False))).select("path", F.when(F.col("f_size").isNull(), "missing").when(F.col("f_size") != F.col("size_bytes"), "changed").otherwise("needs_checksum").alias("reason"))


@register("uncommitted_changes", sql("stored", "select s.path, case when f.path is null then 'missing' when f.size_bytes <> s.size_bytes then 'changed' else 'needs_checksum' end as reason from stored s left join files f on f.path = s.path where not coalesce(abs(s.mtime - f.mtime) < 0.001 and s.size_bytes = f.size_bytes, false)"))
def uncommitted_changes_q(spark: SparkSession, sf: str) -> DataFrame:
    return uncommitted_changes(_files(spark, sf), _stored(spark, sf))


def freshness_status(current: DataFrame, stored: DataFrame) -> DataFrame:
    """missing, breaking, stale or fresh per file, with the sorted changes. Both sides: path, mtime, bbox, feature_count,
    schema_fingerprint. Only a changed mtime leads to a comparison of the rest."""
    s = stored.select("path", *[F.col(c).alias(f"s_{c}") for c in ("mtime", "bbox", "feature_count", "schema_fingerprint")])
    both = current.join(s, "path", "left")
    differ = lambda c: ~F.col(c).eqNullSafe(F.col(f"s_{c}"))
    changes = F.array_compact(F.array(F.when(differ("mtime"), "mtime"), F.when(differ("bbox"), "bbox"), F.when(differ("feature_count"), "feature_count"), F.when(differ("schema_fingerprint"), "schema")))
    status = F.when(F.col("s_mtime").isNull(), "missing").when(~differ("mtime"), "fresh").when(differ("schema_fingerprint"), "breaking").when(differ("bbox") | differ("feature_count"), "stale").otherwise("fresh")
    return both.select("path", status.alias("status"), F.when(F.col("s_mtime").isNull() | ~differ("mtime"), "").otherwise(F.array_join(changes, ",")).alias("changes"))


_FRESH = """, c as (select path, collection, mtime, size_bytes % 7 as bbox, size_bytes as feature_count, size_bytes % 11 as schema_fingerprint from files),
  s as (select path, mtime, case when size_bytes % 2 = 0 then size_bytes % 7 else 0 end as bbox, size_bytes as feature_count, case when size_bytes % 5 = 0 then 99 else size_bytes % 11 end as schema_fingerprint from stored),
  r as (select c.path, c.collection, case when s.path is null then 'missing' when c.mtime = s.mtime then 'fresh' when c.schema_fingerprint <> s.schema_fingerprint then 'breaking' when c.bbox <> s.bbox or c.feature_count <> s.feature_count then 'stale' else 'fresh' end as status,
    case when s.path is null or c.mtime = s.mtime then '' else concat_ws(',', case when c.mtime <> s.mtime then 'mtime' end, case when c.bbox <> s.bbox then 'bbox' end, case when c.feature_count <> s.feature_count then 'feature_count' end, case when c.schema_fingerprint <> s.schema_fingerprint then 'schema' end) end as changes from c left join s on c.path = s.path)"""


def _fresh(spark: SparkSession, sf: str) -> DataFrame:
    c = _files(spark, sf).select("path", "mtime", F.expr("size_bytes % 7").alias("bbox"), F.col("size_bytes").alias("feature_count"), F.expr("size_bytes % 11").alias("schema_fingerprint"))
    s = _stored(spark, sf).select("path", "mtime", F.expr("case when size_bytes % 2 = 0 then size_bytes % 7 else 0 end").alias("bbox"), F.col("size_bytes").alias("feature_count"), F.expr("case when size_bytes % 5 = 0 then 99 else size_bytes % 11 end").alias("schema_fingerprint"))
    return freshness_status(c, s)


@register("freshness_status", sql("stored", _FRESH + " select path, status, changes from r"))
def freshness_status_q(spark: SparkSession, sf: str) -> DataFrame:
    return _fresh(spark, sf)


#: Severities of the statuses.
SEVERITY = {"fresh": 0, "orphaned": 1, "stale": 2, "missing": 3, "breaking": 4}


def metadata_report(results: DataFrame) -> DataFrame:
    """One row: counts by status, worst severity, and whether all is fresh."""
    worst = F.max(F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])[F.col("status")])
    return results.agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in SEVERITY], worst.cast("long").alias("severity"), F.bool_and(F.col("status") == "fresh").alias("passed"))


@register("metadata_report", sql("stored", _FRESH + " select cast(count(*) as bigint) as total, " + ", ".join(f"cast(count(case when status = '{s}' then 1 end) as bigint) as {s}" for s in SEVERITY) + ", cast(max(case status when 'fresh' then 0 when 'stale' then 2 when 'missing' then 3 when 'breaking' then 4 end) as bigint) as severity, bool_and(status = 'fresh') as passed from r"))
def metadata_report_q(spark: SparkSession, sf: str) -> DataFrame:
    return metadata_report(_fresh(spark, sf))


def orphan_assets(registered: DataFrame, present: DataFrame) -> DataFrame:
    """missing: registered local hrefs without a file; orphaned: files that nothing registers."""
    local = registered.where(~T.is_external_href(F.col("path"))).select("path")
    gone = local.join(present, "path", "left_anti").withColumn("status", F.lit("missing"))
    extra = present.select("path").join(local, "path", "left_anti").withColumn("status", F.lit("orphaned"))
    return gone.unionByName(extra)


@register("orphan_assets", sql("stored", "select path, 'missing' as status from stored s where not exists (select 1 from files f where f.path = s.path) union all select path, 'orphaned' from files f where not exists (select 1 from stored s where f.path = s.path)"))
def orphan_assets_q(spark: SparkSession, sf: str) -> DataFrame:
    return orphan_assets(_stored(spark, sf), _files(spark, sf))


@register("stale_links", sql("stored", "select path as href from stored s where not exists (select 1 from files f where f.path = s.path)"))
def stale_links_q(spark: SparkSession, sf: str) -> DataFrame:
    return stale_links(_stored(spark, sf).select(F.col("path").alias("href")), _files(spark, sf).select(F.col("path").alias("href")))


def stale_links(links: DataFrame, targets: DataFrame) -> DataFrame:
    return links.join(targets, "href", "left_anti")


def mixed_structure(files: DataFrame) -> DataFrame:
    """Directories with files that also have a descendant with files: ancestors exploded, then an equi semi-join."""
    dirs = files.select("dir").distinct()
    segs = F.split("dir", "/")
    up = dirs.where(F.size(segs) > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.size(segs) - 1), lambda n: F.array_join(F.slice(segs, F.lit(1), n), "/"))).alias("dir")).distinct()
    return dirs.join(up, "dir", "left_semi")


@register("mixed_structure", sql("files", "select distinct a.dir from files a where exists (select 1 from (select distinct dir from files) b where b.dir like a.dir || '/%')"))
def mixed_structure_q(spark: SparkSession, sf: str) -> DataFrame:
    return mixed_structure(_files(spark, sf))


def incomplete_shapefile(files: DataFrame) -> DataFrame:
    """.shp without .dbf or .shx, and sidecars without .shp, per directory and stem."""
    g = files.where(F.col("ext").isin("shp", "dbf", "shx")).groupBy("dir", "stem").agg(F.collect_set("ext").alias("has"))
    missing = F.array_join(F.sort_array(F.array_except(F.array(F.lit("dbf"), F.lit("shp"), F.lit("shx")), "has")), ",")
    kind = F.when(F.array_contains("has", "shp"), "incomplete").otherwise("orphan_sidecar")
    return g.where(F.size("has") < 3).select("dir", "stem", kind.alias("issue"), missing.alias("missing"))


@register("incomplete_shapefile", sql("files", "select dir, stem, case when max(case when ext = 'shp' then 1 else 0 end) = 1 then 'incomplete' else 'orphan_sidecar' end as issue, concat_ws(',', case when max(case when ext = 'dbf' then 1 else 0 end) = 0 then 'dbf' end, case when max(case when ext = 'shp' then 1 else 0 end) = 0 then 'shp' end, case when max(case when ext = 'shx' then 1 else 0 end) = 0 then 'shx' end) as missing from files where ext in ('shp', 'dbf', 'shx') group by dir, stem having count(distinct ext) < 3"))
def incomplete_shapefile_q(spark: SparkSession, sf: str) -> DataFrame:
    return incomplete_shapefile(_files(spark, sf))


def dedupe_asset_href(old: DataFrame, new: DataFrame) -> DataFrame:
    """New (asset_key, href) rows take the key that an existing asset of the same href has; one row an href."""
    o = old.groupBy("href").agg(F.min("asset_key").alias("_k"))
    return new.groupBy("href").agg(F.min("asset_key").alias("asset_key")).join(o, "href", "left").select(F.coalesce("_k", "asset_key").alias("asset_key"), "href")


@register("dedupe_asset_href", sql("stored", "select coalesce(o.k, n.k) as asset_key, n.href from (select path as href, min('new_' || name) as k from files group by path) n left join (select path as href, min(name) as k from stored group by path) o on o.href = n.href"))
def dedupe_asset_href_q(spark: SparkSession, sf: str) -> DataFrame:
    return dedupe_asset_href(_stored(spark, sf).select(F.col("name").alias("asset_key"), F.col("path").alias("href")), _files(spark, sf).select(F.concat(F.lit("new_"), "name").alias("asset_key"), F.col("path").alias("href")))


def fill_missing_sizes(assets: DataFrame, files: DataFrame) -> DataFrame:
    f = files.select("path", F.col("size_bytes").alias("_s"))
    return assets.join(f, "path", "left").withColumn("size_bytes", F.coalesce("size_bytes", "_s")).drop("_s")


@register("fill_missing_sizes", sql("stored", "select s.path, coalesce(case when s.size_bytes % 3 <> 0 then s.size_bytes end, f.size_bytes) as size_bytes from stored s left join files f on f.path = s.path"))
def fill_missing_sizes_q(spark: SparkSession, sf: str) -> DataFrame:
    holes = _stored(spark, sf).select("path", F.expr("case when size_bytes % 3 <> 0 then size_bytes end").alias("size_bytes"))
    return fill_missing_sizes(holes, _files(spark, sf))


def stamp_file_fields(assets: DataFrame, files: DataFrame) -> DataFrame:
    """Sizes and times from the listing; null where a relative target is gone; external hrefs keep what they had."""
    f = files.select("path", F.col("size_bytes").alias("_s"), F.col("mtime").alias("_m"))
    outside = T.is_external_href(F.col("path"))
    return assets.join(f, "path", "left").withColumn("size_bytes", F.when(outside, F.col("size_bytes")).otherwise(F.col("_s"))).withColumn("mtime", F.when(outside, F.col("mtime")).otherwise(F.col("_m"))).drop("_s", "_m")


@register("stamp_file_fields", sql("stored", "select case when s.size_bytes % 6 = 0 then 'https://x.org/' || s.path else s.path end as path, case when s.size_bytes % 6 = 0 then s.size_bytes else f.size_bytes end as size_bytes, case when s.size_bytes % 6 = 0 then s.mtime else f.mtime end as mtime from stored s left join files f on f.path = s.path"))
def stamp_file_fields_q(spark: SparkSession, sf: str) -> DataFrame:
    a = _stored(spark, sf).select(F.expr("case when size_bytes % 6 = 0 then concat('https://x.org/', path) else path end").alias("path"), "size_bytes", "mtime")
    return stamp_file_fields(a, _files(spark, sf))


def tracked_parquet_rows(footers: DataFrame, registered: DataFrame) -> DataFrame:
    """Rows of the Parquet files that are registered as assets, mirrors apart."""
    return footers.where(~F.col("path").endswith("items.parquet")).join(registered, "path", "left_semi").groupBy("collection").agg(F.sum("rows").alias("rows"), F.count("*").alias("files"))


@register("tracked_parquet_rows", sql("stored", "select collection, cast(sum(size_bytes) as bigint) as rows, cast(count(*) as bigint) as files from files f where ext = 'parquet' and exists (select 1 from stored s where s.path = f.path) group by collection"))
def tracked_parquet_rows_q(spark: SparkSession, sf: str) -> DataFrame:
    return tracked_parquet_rows(_files(spark, sf).where("ext = 'parquet'").withColumn("rows", F.col("size_bytes")), _stored(spark, sf))


PRIMARY = ("parquet", "geojson", "shp", "tif", "csv")


def multi_primary_issues(files: DataFrame) -> DataFrame:
    """More than one primary file in a directory, and one basename in several formats."""
    p = files.where(F.col("ext").isin(*PRIMARY))
    a = p.groupBy("dir").agg(F.count("*").alias("n")).where("n > 1").select("dir", F.lit("multiple_primaries").alias("issue"), F.lit("").alias("stem"), "n")
    b = p.groupBy("dir", "stem").agg(F.countDistinct("ext").alias("n")).where("n > 1").select("dir", F.lit("same_basename").alias("issue"), "stem", "n")
    return a.union(b)


_P = "('parquet', 'geojson', 'shp', 'tif', 'csv')"


@register("multi_primary_issues", sql("files", f"select dir, 'multiple_primaries' as issue, '' as stem, cast(count(*) as bigint) as n from files where ext in {_P} group by dir having count(*) > 1 union all select dir, 'same_basename', stem, cast(count(distinct ext) as bigint) from files where ext in {_P} group by dir, stem having count(distinct ext) > 1"))
def multi_primary_issues_q(spark: SparkSession, sf: str) -> DataFrame:
    return multi_primary_issues(_files(spark, sf))


def dir_fingerprint(files: DataFrame) -> DataFrame:
    """SHA-256 over a directory's sorted (path, size, mtime in ms), and its bytes. A directory is the unit that is gathered."""
    line = F.concat_ws("|", "path", F.col("size_bytes").cast("string"), F.floor(F.col("mtime") * 1000).cast("string"))
    return files.groupBy("dir").agg(F.sha2(F.array_join(F.sort_array(F.collect_list(line)), "\n"), 256).alias("sha256"), F.sum("size_bytes").alias("size_bytes"))


@register("dir_fingerprint", sql("files", "select dir, sha256(string_agg(l, chr(10) order by l)) as sha256, cast(sum(size_bytes) as bigint) as size_bytes from (select dir, size_bytes, concat_ws('|', path, cast(size_bytes as varchar), cast(cast(floor(mtime * 1000) as bigint) as varchar)) as l from files) f group by dir"))
def dir_fingerprint_q(spark: SparkSession, sf: str) -> DataFrame:
    return dir_fingerprint(_files(spark, sf))


def scan_summary(files: DataFrame) -> DataFrame:
    """Counts and bytes by collection and category, with totals (null means all)."""
    c = files.withColumn("category", T.classify_file(F.col("path"), F.col("size_bytes")))
    return c.rollup("collection", "category").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("size_bytes"))


_CAT = "case when size_bytes = 0 then 'junk' when ext in ('parquet', 'geojson', 'shp', 'tif') then 'geo_asset' when ext = 'csv' then 'tabular_data' when ext in ('dbf', 'shx') then 'known_sidecar' when ext = 'json' then 'metadata' when ext = 'txt' then 'documentation' else 'unknown' end"


@register("classify_file", sql("files", f"select path, {_CAT} as category from files"))
def classify_file_q(spark: SparkSession, sf: str) -> DataFrame:
    return _files(spark, sf).select("path", T.classify_file(F.col("path"), F.col("size_bytes")).alias("category"))


@register("scan_summary", sql("files", f"select collection, category, cast(count(*) as bigint) as files, cast(sum(size_bytes) as bigint) as size_bytes from (select *, {_CAT} as category from files) f group by rollup (collection, category)"))
def scan_summary_q(spark: SparkSession, sf: str) -> DataFrame:
    return scan_summary(_files(spark, sf))


@register("format_status", sql("files", "select path, case when ext in ('parquet', 'tif') then 'cloud_native' when ext in ('geojson', 'shp', 'csv') then 'convertible' else 'unsupported' end as status, case when ext in ('geojson', 'shp') then 'GeoParquet' when ext = 'csv' then 'Parquet' end as target from files"))
def format_status_q(spark: SparkSession, sf: str) -> DataFrame:
    e = T.extension(F.col("path"))
    return _files(spark, sf).select("path", T.format_field(e, "status", "unsupported").alias("status"), T.format_field(e, "target").alias("target"))


@register("media_type", sql("files", "select path, case ext when 'parquet' then 'application/vnd.apache.parquet' when 'tif' then 'image/tiff; application=geotiff; profile=cloud-optimized' when 'geojson' then 'application/geo+json' when 'shp' then 'application/x-shapefile' when 'shx' then 'application/x-shapefile' when 'dbf' then 'application/x-dbf' when 'csv' then 'text/csv' when 'json' then 'application/json' when 'txt' then 'text/plain' else 'application/octet-stream' end as media_type from files"))
def media_type_q(spark: SparkSession, sf: str) -> DataFrame:
    return _files(spark, sf).select("path", T.media_type(F.col("path")).alias("media_type"))


def structure_checklist(files: DataFrame) -> DataFrame:
    """Rules of a tree (rule, failures, passed) from its listing, where files at the root have dir ''.

    root_catalog and root_readme always pass (they are generated; ``failures`` tells that one lacks); no geo-asset at the root; one
    a directory; no directory with files both in it and below; names that are, hold, or are part of their directory's name, which
    passes while at most half of the geo-assets differ; ids that are valid.
    """
    asset = F.col("ext").isin(*PRIMARY)
    parent, stem = F.lower(F.regexp_replace("dir", "^.*/", "")), F.lower(T.stem(F.col("name")))
    named = stem.contains(parent) | parent.contains(stem)
    at_root = F.col("dir") == ""
    per = files.groupBy("dir").agg(F.count_if(asset).alias("assets"), F.count_if(asset & ~at_root & ~named).alias("misnamed"), F.count_if(at_root & (F.col("name") == "catalog.json")).alias("catalog"), F.count_if(at_root & (F.col("name") == "README.md")).alias("readme"))
    valid = T.collection_id_problem(F.col("dir")).isNull() | at_root
    mixed = mixed_structure(files.where(asset & ~at_root)).withColumn("mixed", F.lit(True))
    s = per.join(mixed, "dir", "left").agg(
        F.sum("catalog").alias("catalog"), F.sum("readme").alias("readme"), F.sum(F.when(at_root, F.col("assets"))).alias("root"), F.count_if(~at_root & (F.col("assets") > 1)).alias("several"),
        F.count_if("mixed").alias("mixed"), F.sum("misnamed").alias("misnamed"), F.sum("assets").alias("all"), F.count_if(~valid).alias("invalid"))
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    lacks = lambda c: F.when(count(c) > 0, 0).otherwise(1).cast("long")
    rules = [("root_catalog", lacks("catalog"), F.lit(True)), ("root_readme", lacks("readme"), F.lit(True)), ("no_root_geo_assets", count("root"), None), ("single_geo_asset_per_dir", count("several"), None), ("no_mixed_structure", count("mixed"), None),
             ("geo_asset_naming", count("misnamed"), count("misnamed") <= F.expr("coalesce(all, 0) div 2")), ("valid_ids", count("invalid"), None)]
    return s.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), c.alias("failures"), (c == 0 if ok is None else ok).alias("passed")) for n, c, ok in rules])).alias("r")).select("r.*")


_ROOTED = """select case when size_bytes % 40 = 0 then name else path end as path, case when size_bytes % 40 = 0 then '' when size_bytes % 41 = 0 then concat(dir, '/', stem) when size_bytes % 43 = 0 then concat('Bad ', dir) else dir end as dir, name, stem, ext, collection from {files}
  union all select distinct 'catalog.json', '', 'catalog.json', 'catalog', 'json', collection from {files} where collection = 'c1'"""


@register("structure_checklist", sql("files", f""", r as ({_ROOTED.replace("{files}", "files")}), a as (select *, lower(regexp_replace(dir, '^.*/', '')) as p, lower(stem) as s from r where ext in {_P}), d as (select dir, count(*) as n from a group by dir),
  f as (select (select case when count(*) > 0 then 0 else 1 end from r where dir = '' and name = 'catalog.json') as c, (select case when count(*) > 0 then 0 else 1 end from r where dir = '' and name = 'README.md') as m, (select count(*) from a where dir = '') as o, (select count(*) from d where dir <> '' and n > 1) as v,
    (select count(*) from d where dir <> '' and exists (select 1 from d b where b.dir like d.dir || '/%')) as x, (select count(*) from a where dir <> '' and not contains(s, p) and not contains(p, s)) as g, (select count(*) from a) as n,
    (select count(distinct dir) from r where dir <> '' and not regexp_full_match(dir, '[a-z0-9][a-z0-9_-]*(/[a-z0-9][a-z0-9_-]*)*')) as i)
  select unnest(['root_catalog', 'root_readme', 'no_root_geo_assets', 'single_geo_asset_per_dir', 'no_mixed_structure', 'geo_asset_naming', 'valid_ids']) as rule, unnest([c, m, o, v, x, g, i])::bigint as failures, unnest([true, true, o = 0, v = 0, x = 0, g <= n // 2, i = 0]) as passed from f"""))
def structure_checklist_q(spark: SparkSession, sf: str) -> DataFrame:
    return structure_checklist(spark.sql(_ROOTED, files=_files(spark, sf)))


#: Extensions by what they hold; other geo-assets are of neither kind.
VECTOR, RASTER = ("parquet", "geojson", "shp", "gpkg", "fgb"), ("tif", "tiff", "jp2")


def structure_pattern(files: DataFrame, by: list[str], collection: str | None = None) -> DataFrame:
    """Per group of a listing (columns ``by``, path, ext) the kind of tree, its collections and whether one is nested.

    empty: no geo-asset; flat: no collection; raster_items or raster_collection (rasters alone, in paths of two directories or more
    on average, or less); vector_collection; mixed; else single_collection or multiple_collections. ``collection`` names a column
    with a file's collection, which is else its directory.
    """
    own = F.nullif(F.col(collection) if collection else T.infer_collection_id(F.col("path")), F.lit(""))
    ready = F.col("ext").isin(*VECTOR, *RASTER, *PRIMARY, "pmtiles")
    depth = F.size(F.split("path", "/")) - 1
    rows = files.select(*by, ready.alias("ready"), F.when(ready, own).alias("own"), F.col("ext").isin(*VECTOR).alias("v"), F.col("ext").isin(*RASTER).alias("r"), F.when(ready, depth).alias("depth"))
    a = rows.groupBy(*by).agg(F.bool_or("ready").alias("ready"), F.countDistinct("own").alias("collections"), F.bool_or("v").alias("v"), F.bool_or("r").alias("r"), F.avg("depth").alias("depth"), F.coalesce(F.bool_or(F.col("own").contains("/")), F.lit(False)).alias("nested"))
    kind = (
        F.when(~F.col("ready"), "empty").when(F.col("collections") == 0, "flat").when(F.col("r") & ~F.col("v"), F.when(F.col("depth") >= 2, "raster_items").otherwise("raster_collection")).when(F.col("v") & ~F.col("r"), "vector_collection")
        .when(F.col("v"), "mixed").when(F.col("collections") == 1, "single_collection").otherwise("multiple_collections")
    )
    return a.select(*by, kind.alias("pattern"), "collections", "nested")


_TREES = """select cast(user_id % 10 as bigint) as tree, path, regexp_replace(path, '^.*[.]', '') as ext from (select user_id, case user_id % 10
  when 0 then concat('a', cast(event_id % 3 as string), '.parquet') when 1 then concat('sat/s', cast(event_id % 4 as string), '/b.tif') when 2 then concat('dem/', event_type, '.tif') when 3 then concat('roads/', event_type, '.parquet') when 4 then concat('x/', event_type, case when event_id % 2 = 0 then '.tif' else '.shp' end)
  when 5 then concat('t/', event_type, '.csv') when 6 then concat('t', cast(event_id % 3 as string), '/y.csv') when 7 then concat('d/', event_type, '.txt') when 8 then concat('a/b/', event_type, case when event_id % 2 = 0 then '.txt' else '.pmtiles' end) else concat('h/year=', cast(event_id % 5 as string), '/', event_type, '.parquet') end as path from {events}) e group by 1, 2, 3"""


@register("structure_pattern", "with t as (" + _TREES.replace("{events}", "events") + """), f as (select *, ext not in ('txt') as ready, ext in ('parquet', 'shp') as v, ext = 'tif' as r, nullif(array_to_string(list_filter(string_split(path, '/')[1:-2], lambda s: not contains(s, '=')), '/'), '') as own from t),
  g as (select tree, bool_or(ready) as ready, count(distinct case when ready then own end) as collections, bool_or(v) as v, bool_or(r) as r, avg(case when ready then len(string_split(path, '/')) - 1 end) as depth, coalesce(bool_or(case when ready then contains(own, '/') end), false) as nested from f group by tree)
  select tree, case when not ready then 'empty' when collections = 0 then 'flat' when r and not v then case when depth >= 2 then 'raster_items' else 'raster_collection' end when v and not r then 'vector_collection' when v then 'mixed' when collections = 1 then 'single_collection' else 'multiple_collections' end as pattern, cast(collections as bigint) as collections, nested from g""")
def structure_pattern_q(spark: SparkSession, sf: str) -> DataFrame:
    return structure_pattern(spark.sql(_TREES, events=view(spark, sf, "events")), ["tree"])


def catalog_totals(status: DataFrame, by: tuple[str, ...] = ("collection",)) -> DataFrame:
    """Tracked, untracked, modified and deleted counts at every level (null: all)."""
    return status.rollup(*by).agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("tracked", "untracked", "modified", "deleted")])


@register("catalog_totals", sql("stored", f"select collection, {', '.join(f"cast(count(case when status = '{s}' then 1 end) as bigint) as {s}" for s in ('tracked', 'untracked', 'modified', 'deleted'))} from ({_STATUS}) x group by rollup (collection)"))
def catalog_totals_q(spark: SparkSession, sf: str) -> DataFrame:
    return catalog_totals(asset_status(_files(spark, sf), _stored(spark, sf)))


@register("status_filter", sql("stored", f"select collection, cast(count(*) as bigint) as n from ({_STATUS}) x where status = 'untracked' group by collection"))
def status_filter_q(spark: SparkSession, sf: str) -> DataFrame:
    return status_filter(asset_status(_files(spark, sf), _stored(spark, sf)), "untracked").groupBy("collection").agg(F.count("*").alias("n"))


def status_filter(status: DataFrame, keep: str) -> DataFrame:
    """Rows of one status; groups left empty vanish, since this comes before any roll-up."""
    return status.where(F.col("status") == keep)


#: Roles that a catalog can do without.
OPTIONAL_ROLES = ("visual", "thumbnail", "style", "mirror", "overview")


def missing_asset_policy(roles: Column, name: Column) -> Column:
    """warn when all roles but ``default`` are optional, else error; without roles a generated file's name decides."""
    rest = F.array_except(F.array_remove(roles, "default"), F.array(*[F.lit(r) for r in OPTIONAL_ROLES]))
    known = F.size(F.array_remove(F.coalesce(roles, F.array().cast("array<string>")), "default")) > 0
    made = name.rlike(r"(?i)(thumbnail|\.pmtiles$|^style.*\.json$|items\.parquet$)")
    return F.when(F.when(known, F.size(rest) == 0).otherwise(made), "warn").otherwise("error")


@register("missing_asset_policy", sql("files", "select path, case when size_bytes % 3 = 0 then 'warn' when size_bytes % 3 = 1 then 'error' else case when regexp_matches(lower(name), '(thumbnail|[.]pmtiles$|^style.*[.]json$|items[.]parquet$)') then 'warn' else 'error' end end as policy from files"))
def missing_asset_policy_q(spark: SparkSession, sf: str) -> DataFrame:
    roles = F.expr("case size_bytes % 3 when 0 then array('visual', 'default') when 1 then array('data', 'visual') end")
    return _files(spark, sf).select("path", missing_asset_policy(roles, F.col("name")).alias("policy"))


def extraction_summary(results: DataFrame, by: list[str]) -> DataFrame:
    return results.groupBy(*by).agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("success", "failed", "skipped")], F.coalesce(F.sum("features"), F.lit(0)).alias("features"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.round(F.coalesce(F.sum("seconds"), F.lit(0.0)), 6).alias("seconds"))


_RES = "select path, collection, case size_bytes % 4 when 0 then 'failed' when 1 then 'skipped' else 'success' end as status, case when size_bytes % 4 > 1 then size_bytes end as features, size_bytes as bytes, size_bytes * 0.25e0 as seconds from files"


def _results(spark: SparkSession, sf: str) -> DataFrame:
    return _files(spark, sf).selectExpr("path", "collection", "case size_bytes % 4 when 0 then 'failed' when 1 then 'skipped' else 'success' end as status", "case when size_bytes % 4 > 1 then size_bytes end as features", "size_bytes as bytes", "size_bytes * 0.25D as seconds")


@register("extraction_summary", sql("files", f"select collection, {', '.join(f"cast(count(case when status = '{s}' then 1 end) as bigint) as {s}" for s in ('success', 'failed', 'skipped'))}, cast(coalesce(sum(features), 0) as bigint) as features, cast(coalesce(sum(bytes), 0) as bigint) as bytes, round(coalesce(sum(seconds), 0), 6) as seconds from ({_RES}) r group by collection"))
def extraction_summary_q(spark: SparkSession, sf: str) -> DataFrame:
    return extraction_summary(_results(spark, sf), ["collection"])


def conversion_summary(results: DataFrame, by: list[str]) -> DataFrame:
    states = ["success", "failed", "skipped", "invalid", "unsupported"]
    return results.groupBy(*by).pivot("status", states).agg(F.count(F.lit(1))).na.fill(0, states)


@register("conversion_summary", sql("files", f"select collection, {', '.join(f"cast(count(case when status = '{s}' then 1 end) as bigint) as {s}" for s in ('success', 'failed', 'skipped', 'invalid', 'unsupported'))} from ({_RES}) r group by collection"))
def conversion_summary_q(spark: SparkSession, sf: str) -> DataFrame:
    return conversion_summary(_results(spark, sf), ["collection"])


def transfer_metrics(results: DataFrame, by: list[str]) -> DataFrame:
    """Bytes, seconds and speed of merged workers; the elapsed time is preferred to the sum of seconds."""
    return results.groupBy(*by).agg(F.sum("bytes").alias("bytes"), F.sum("seconds").alias("busy"), F.max("elapsed").alias("elapsed")).select(*by, "bytes", F.round("busy", 6).alias("busy"), F.round(F.col("bytes") / F.nullif(F.coalesce("elapsed", "busy"), F.lit(0.0)), 6).alias("speed"))


@register("transfer_metrics", sql("files", f"select collection, cast(sum(bytes) as bigint) as bytes, round(sum(seconds), 6) as busy, round(sum(bytes) / nullif(coalesce(case when collection = 'c1' then null else max(seconds) end, sum(seconds)), 0), 6) as speed from ({_RES}) r group by collection"))
def transfer_metrics_q(spark: SparkSession, sf: str) -> DataFrame:
    return transfer_metrics(_results(spark, sf).withColumn("elapsed", F.expr("case when collection <> 'c1' then seconds end")), ["collection"])


@register("item_lookup", sql("items", "select l_orderkey, ln, round(lon, 6) as lon, round(lat, 6) as lat from items where l_orderkey = 5979 and ln = 6"))
def item_lookup_q(spark: SparkSession, sf: str) -> DataFrame:
    return item_lookup(view(spark, sf, "items"), {"l_orderkey": 5979, "ln": 6}).select("l_orderkey", "ln", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


def item_lookup(items: DataFrame, key: dict) -> DataFrame:
    """Point look-up; an unknown key gives no row (readers raise on it)."""
    out = items
    for k, v in key.items():
        out = out.where(F.col(k) == v)
    return out


@register("resume_filter", sql("files", f"select path from files f where path not in (select path from ({_RES}) r where status <> 'failed' and bytes % 2 = 1) and name <> ''"))
def resume_filter_q(spark: SparkSession, sf: str) -> DataFrame:
    return resume_filter(_files(spark, sf).select("path", "name"), _results(spark, sf).where("bytes % 2 = 1"), ["path"]).select("path")


def resume_filter(work: DataFrame, report: DataFrame, key: list[str]) -> DataFrame:
    """Work not yet done: success and skipped go, failed is tried again, what has no name goes."""
    return work.where("coalesce(name, '') <> ''").join(report.where("status in ('success', 'skipped')"), key, "left_anti")


@register("glob_filter", sql("files", "select path from files where (regexp_matches(lower(name), '^view_.*$') or regexp_matches(lower(name), '^.*[.]csv$') or regexp_matches(lower(name), '^.*_[5-7][.][^a-m].*$')) and not regexp_matches(lower(name), '^.*_1[!0-4][.].*$')"))
def glob_filter_q(spark: SparkSession, sf: str) -> DataFrame:
    return glob_filter(_files(spark, sf), "name", ["VIEW_*", "*.csv", "*_[5-7].[!a-m]*"], ["*_1[0-4!].*"], case=False).select("path")


def glob_filter(df: DataFrame, col: str, include: list[str] | None, exclude: list[str] | None, case: bool = True) -> DataFrame:
    """Include, then exclude by globs, which become anchored patterns at plan time."""
    c = F.col(col)
    df = df.where(T.any_glob(c, include, case)) if include else df
    return df.where(~T.any_glob(c, exclude, case)) if exclude else df


@register("layer_filter", "select p_partkey from part where (p_partkey = 7 or p_partkey = 12 or regexp_matches(p_name, '^red .*$')) and not (p_partkey = 12 or regexp_matches(p_name, '^.*bolt$'))")
def layer_filter_q(spark: SparkSession, sf: str) -> DataFrame:
    return layer_filter(view(spark, sf, "part"), "p_partkey", "p_name", ["7", "12", "red *"], ["12", "*bolt"]).select("p_partkey")


def layer_filter(df: DataFrame, id: str, name: str, include: list[str], exclude: list[str]) -> DataFrame:
    """Include and exclude by numeric id or name glob in one pattern list."""
    hit = lambda ps: (F.col(id).isin(*[int(p) for p in ps if p.isdigit()]) if any(p.isdigit() for p in ps) else F.lit(False)) | T.any_glob(F.col(name), [p for p in ps if not p.isdigit()])
    df = df.where(hit(include)) if include else df
    return df.where(~hit(exclude)) if exclude else df


@register("path_exclude", sql("files", "select path from files where not (list_contains(string_split(path, '/'), 'c3') or regexp_matches(name, '^.*[.]zip$') or name = 'view_1.csv')"))
def path_exclude_q(spark: SparkSession, sf: str) -> DataFrame:
    return path_exclude(_files(spark, sf), "path", ["c3/", "*.zip", "view_1.csv"]).select("path")


def path_exclude(df: DataFrame, col: str, patterns: list[str]) -> DataFrame:
    """Drop by directory (``x/``), glob on the name, or exact name."""
    name, hit = F.regexp_replace(F.col(col), "^.*/", ""), F.lit(False)
    for p in patterns:
        hit = hit | (F.array_contains(F.split(col, "/"), p[:-1]) if p.endswith("/") else name.rlike(T.glob_to_regex(p)) if any(c in p for c in "*?[") else name == p)
    return df.where(~hit)


@register("should_partition", sql("files", "select collection, path, size_bytes from files where size_bytes > 4000 and ext in ('parquet', 'geojson', 'shp')"))
def should_partition_q(spark: SparkSession, sf: str) -> DataFrame:
    return partition_candidates(_files(spark, sf), 4000).select("collection", "path", "size_bytes")


def partition_candidates(files: DataFrame, threshold: int = 2 << 30) -> DataFrame:
    """Vector files over the threshold (2 GB)."""
    return files.where((F.col("size_bytes") > threshold) & F.col("ext").isin("parquet", "geojson", "shp", "gpkg"))


@register("preview_limit", sql("stored", ", m as (select collection, path, row_number() over (partition by collection order by path) as rn, count(*) over (partition by collection) as n from stored s where not exists (select 1 from files f where f.path = s.path)) select collection, string_agg(path, ', ' order by path) || case when max(n) > 5 then ' and ' || cast(max(n) - 5 as varchar) || ' more' else '' end as preview from m where rn <= 5 group by collection"))
def preview_limit_q(spark: SparkSession, sf: str) -> DataFrame:
    gone = _stored(spark, sf).join(_files(spark, sf), "path", "left_anti")
    return preview_limit(gone, ["collection"], "path")


def preview_limit(df: DataFrame, by: list[str], name: str, k: int = 5) -> DataFrame:
    """The first k names of a group and how many more there are; ranks keep a large group from being gathered."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*by)
    top = df.withColumn("_rn", F.row_number().over(w.orderBy(name))).groupBy(*by).agg(F.collect_list(F.when(F.col("_rn") <= k, F.col(name))).alias("x"), F.count("*").alias("n"))
    more = F.when(F.col("n") > k, F.concat(F.lit(" and "), (F.col("n") - k).cast("string"), F.lit(" more"))).otherwise("")
    return top.select(*by, F.concat(F.array_join(F.sort_array("x"), ", "), more).alias("preview"))


@register("distinct_links", sql("stored", "select collection, name, min(path) as path from files group by collection, name"))
def distinct_links_q(spark: SparkSession, sf: str) -> DataFrame:
    return distinct_links(_files(spark, sf), ["collection", "name"], "path")


def distinct_links(links: DataFrame, key: list[str], first: str) -> DataFrame:
    """One link a key, the first kept."""
    return links.groupBy(*key).agg(F.min(first).alias(first))


@register("collections_union", sql("stored", "select collection from files where size_bytes % 2 = 0 union select collection from stored"))
def collections_union_q(spark: SparkSession, sf: str) -> DataFrame:
    return collections_union(_files(spark, sf).where("size_bytes % 2 = 0").select("collection"), _stored(spark, sf).select("collection"))


def collections_union(local: DataFrame, remote: DataFrame) -> DataFrame:
    return local.union(remote).distinct().orderBy("collection")


def ancestor_catalogs(ids: DataFrame, col: str) -> DataFrame:
    """Every ancestor path of nested ids, once."""
    segs = F.split(col, "/")
    return ids.where(F.size(segs) > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.size(segs) - 1), lambda n: F.array_join(F.slice(segs, F.lit(1), n), "/"))).alias("catalog")).distinct()


@register("ancestor_catalogs", sql("files", "select distinct split_part(path, '/', 1) as catalog from files union select distinct split_part(path, '/', 1) || '/' || split_part(path, '/', 2) from files where len(string_split(path, '/')) > 2"))
def ancestor_catalogs_q(spark: SparkSession, sf: str) -> DataFrame:
    return ancestor_catalogs(_files(spark, sf), "path")


@register("null_geometry_reject", sql("items", "select collection, cast(count(*) as bigint) as n from (select collection, case when collection % 6 = 0 then null else lon end as g from items) i group by collection having count(g) = 0"))
def null_geometry_reject_q(spark: SparkSession, sf: str) -> DataFrame:
    df = view(spark, sf, "items").select("collection", F.expr("case when collection % 6 = 0 then null else lon end").alias("g"))
    return null_geometry_reject(df, ["collection"], "g")


def null_geometry_reject(df: DataFrame, by: list[str], geometry: str) -> DataFrame:
    """Sources without features, or of which every geometry is null."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.count(geometry).alias("_g")).where("n = 0 or _g = 0").drop("_g")
