"""Collections that file names suggest, and whether files are still what a manifest says."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataspark.functions import text as T
from strataspark.plans.views import sql, view
from strataspark.registry import register
from strataspark.session import ship

#: Name markers in the order tried, and the shortest prefix that counts.
MARKERS = (("return_period", "rp"), ("level", "L"), ("version", "v"))
LEAST_PREFIX = 3


def infer_collections(files: DataFrame, by: list[str], least: float = 0.5) -> DataFrame:
    """Suggested collections of each group of files (columns ``by``, name, path), best first by ``place``.

    * marker (0.9): the first marker (return period, level, version) that two names or more end in with a number, if all those
      names have one base; one a group;
    * numeric (0.5 + 0.1 a name, at most 0.8): names that end in a number, by base, unless the marker has that base;
    * prefix (0.6): what all names of the group begin with, without trailing marks, three characters or more, unless a rule
      above has it. The common prefix of a group is that of its least and its greatest stem, so it is an aggregate.

    ``names``: distinct names, ``files``: paths. Files of one name in several directories are one name.
    """
    names = files.groupBy(*by, "name").agg(F.count("*").alias("files")).withColumn("stem", T.stem(F.col("name")))
    base = lambda mark: F.regexp_extract("stem", rf"^(.+?)_?{mark}(\d+)$", 1)
    marks = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(kind).alias("kind"), base(mark).alias("base")) for i, (kind, mark) in enumerate(MARKERS)])
    hit = names.select(*by, "files", F.explode(F.filter(marks, lambda m: m["base"] != "")).alias("m"))
    per = hit.groupBy(*by, "m.i", "m.kind").agg(F.count("*").alias("names"), F.sum("files").alias("files"), F.min("m.base").alias("suggested_name"), F.max("m.base").alias("_last"))
    per = per.where("names >= 2 and suggested_name = _last").groupBy(*by).agg(F.min_by(F.struct("suggested_name", F.col("kind").alias("pattern_type"), "names", "files"), "i").alias("r"))
    marker = per.select(*by, "r.*", F.lit(0.9).alias("confidence"), F.lit("").alias("_first"), F.lit(0).alias("_kind"))

    numeric = names.withColumn("suggested_name", F.regexp_extract("stem", r"^(.+?)[-_]?(\d+)$", 1)).where("suggested_name <> ''")
    numeric = numeric.groupBy(*by, "suggested_name").agg(F.count("*").alias("names"), F.sum("files").alias("files"), F.min("name").alias("_first")).where("names >= 2")
    numeric = numeric.join(marker.select(*by, "suggested_name"), [*by, "suggested_name"], "left_anti")
    numeric = numeric.select(*by, "suggested_name", F.lit("numeric").alias("pattern_type"), "names", "files", F.round(F.least(F.lit(0.8), 0.5 + 0.1 * F.col("names")), 6).alias("confidence"), "_first", F.lit(1).alias("_kind"))

    every = names.groupBy(*by).agg(F.count("*").alias("names"), F.sum("files").alias("files"), F.min("stem").alias("a"), F.max("stem").alias("b")).where("names >= 2")
    every = every.withColumn("suggested_name", F.regexp_replace(common_prefix("a", "b"), "[-_]+$", "")).where(F.length("suggested_name") >= LEAST_PREFIX)
    taken = marker.select(*by, "suggested_name").union(numeric.select(*by, "suggested_name"))
    prefix = every.join(taken, [*by, "suggested_name"], "left_anti").select(*by, "suggested_name", F.lit("prefix").alias("pattern_type"), "names", "files", F.lit(0.6).alias("confidence"), F.lit("").alias("_first"), F.lit(2).alias("_kind"))

    found = marker.unionByName(numeric).unionByName(prefix).where(F.col("confidence") >= least)
    place = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("confidence"), "_kind", "_first"))
    return found.withColumn("place", place.cast("long")).drop("_first", "_kind")


def common_prefix(a: str, b: str) -> Column:
    """The longest common prefix of two columns."""
    size = F.expr(f"size(filter(sequence(1, greatest(1, least(length({a}), length({b})))), i -> substring({a}, 1, i) = substring({b}, 1, i) and i <= length({a})))")
    return F.substring(F.col(a), F.lit(1), size)


_NAMES = """select cast(user_id % 12 as bigint) as grp, concat('d', cast(event_id % 3 as string), '/', name) as path, name from (
  select user_id, event_id, case user_id % 12 when 0 then concat('flood_rp', cast(event_id % 30 as string), '.tif') when 1 then concat('admin', cast(event_id % 2 as string), '_L', cast(event_id % 5 as string), '.shp')
    when 2 then concat(event_type, '_', cast(event_id % 23 as string), '.csv') when 3 then concat('rivers-', event_type, '.parquet') when 4 then concat('roads_v', cast(event_id % 4 as string), '.gpkg') when 5 then concat(event_type, '.tif')
    when 6 then concat('zone_L', cast(event_id % 6 as string), case when event_id % 2 = 0 then '.tif' else '.shp' end) when 7 then case when event_id % 2 = 0 then concat('soil_rp', cast(event_id % 7 as string), '.tif') else concat('soil_v', cast(event_id % 9 as string), '.tif') end
    when 8 then case when event_id % 5 = 0 then 'ab12.csv' else concat('ab', cast(event_id % 4 as string), 'x.csv') end when 9 then 'only_one.tif' when 10 then concat('.hidden', cast(event_id % 3 as string)) else concat('2', cast(event_id % 5 as string), '.tar.gz') end as name
  from {events}) e group by 1, 2, 3"""


@register("infer_collections", "with f as (" + _NAMES.replace("{events}", "events") + r"""), n as (
  select grp, name, count(*) as files, case when regexp_matches(name, '^.+\.[^.]+$') then regexp_extract(name, '^(.+)\.[^.]+$', 1) else name end as stem from f group by grp, name),
m as (select grp, files, i, kind, base from (
    select grp, files, 0 as i, 'return_period' as kind, regexp_extract(stem, '^(.+?)_?rp([0-9]+)$', 1) as base from n union all select grp, files, 1, 'level', regexp_extract(stem, '^(.+?)_?L([0-9]+)$', 1) from n
    union all select grp, files, 2, 'version', regexp_extract(stem, '^(.+?)_?v([0-9]+)$', 1) from n) x where base <> ''),
mk as (select grp, suggested_name, pattern_type, names, files from (
    select grp, min(base) as suggested_name, kind as pattern_type, count(*) as names, sum(files) as files, row_number() over (partition by grp order by i) as r from m group by grp, i, kind having count(*) >= 2 and count(distinct base) = 1) x where r = 1),
nu as (select * from (select grp, base as suggested_name, 'numeric' as pattern_type, count(*) as names, sum(files) as files, min(name) as first from (select *, regexp_extract(stem, '^(.+?)[-_]?([0-9]+)$', 1) as base from n) x where base <> '' group by grp, base having count(*) >= 2) y
    where not exists (select 1 from mk where mk.grp = y.grp and mk.suggested_name = y.suggested_name)),
pa as (select grp, rtrim(substr(a, 1, len(list_filter(range(1, least(length(a), length(b)) + 1), lambda i: substr(a, 1, i) = substr(b, 1, i)))), '-_') as suggested_name, 'prefix' as pattern_type, names, files
    from (select grp, min(stem) as a, max(stem) as b, count(*) as names, sum(files) as files from n group by grp having count(*) >= 2) x),
al as (select grp, suggested_name, pattern_type, names, files, 0.9e0 as confidence, '' as first, 0 as k from mk union all select grp, suggested_name, pattern_type, names, files, round(least(0.8e0, 0.5e0 + 0.1e0 * names), 6), first, 1 from nu
    union all select grp, suggested_name, pattern_type, names, files, 0.6e0, '', 2 from pa where length(suggested_name) >= 3 and not exists (select 1 from mk where mk.grp = pa.grp and mk.suggested_name = pa.suggested_name) and not exists (select 1 from nu where nu.grp = pa.grp and nu.suggested_name = pa.suggested_name))
select grp, suggested_name, pattern_type, cast(names as bigint) as names, cast(files as bigint) as files, confidence, row_number() over (partition by grp order by confidence desc, k, first) as place from al""")
def infer_collections_q(spark: SparkSession, sf: str) -> DataFrame:
    return infer_collections(spark.sql(_NAMES, events=view(spark, sf, "events")), ["grp"])


def hash_files(files: DataFrame, piece: int = 1 << 22) -> DataFrame:
    """(path, sha256) of the files named by ``path`` (URIs that Arrow's file systems open), read in pieces; spread over tasks by the
    paths. A file that is not there has no hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            for path in b.column(0).to_pylist():
                store, name = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
                digest = None
                if store.get_file_info(name).type == fs.FileType.File:
                    digest = hashlib.sha256()
                    with store.open_input_stream(name) as f:
                        while data := f.read(piece):
                            digest.update(data)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([digest and digest.hexdigest()], pa.string())], names=["path", "sha256"])

    ship(files.sparkSession)
    return files.select("path").repartition("path").mapInArrow(run, "path string, sha256 string")


def is_current(files: DataFrame, stored: DataFrame, by: list[str], hashes: Callable[[DataFrame], DataFrame] = hash_files, tolerance: float = 2.0) -> DataFrame:
    """path, current: is each file what the newest version of its collection holds?

    ``files``: the columns ``by``, path, item (its directory's name), name, size_bytes, mtime, and if there are any asset_key and
    is_dir. ``stored``: ``by``, key, size_bytes, mtime, sha256 (a row a key). The stored state is that of the first key that
    exists: the asset key, item/name, name, the converted name (stem.parquet), item/stem.parquet.

    A modification time within ``tolerance`` seconds and an equal size say yes; another size says no; what is left, and every
    directory, is told by its hash: ``hashes`` gives (path, sha256) of just those paths. No stored state: no.
    """
    own = lambda c, default: F.col(c) if c in files.columns else F.lit(default)
    parquet = F.concat(T.stem(F.col("name")), F.lit(".parquet"))
    forms = [own("asset_key", None).cast("string"), F.concat_ws("/", "item", "name"), F.col("name"), parquet, F.concat_ws("/", F.col("item"), parquet)]
    keys = F.array(*[F.struct(F.lit(i).alias("i"), k.alias("key")) for i, k in enumerate(forms)])
    state = F.struct(F.lit(True).alias("there"), F.col("size_bytes").alias("size"), "mtime", "sha256")
    found = files.select(*by, "path", F.explode(keys).alias("k")).select(*by, "path", "k.*").join(stored.select(*by, "key", state.alias("s")), [*by, "key"]).groupBy("path").agg(F.min_by("s", "i").alias("s"))
    both = files.select("path", "size_bytes", "mtime", own("is_dir", False).alias("is_dir")).join(found, "path", "left")
    no = lambda c: F.coalesce(c, F.lit(False))
    same_size = F.col("size_bytes") == F.col("s.size")
    told = F.when(F.col("s").isNull(), False).when(F.col("is_dir"), None).when(no(F.abs(F.col("mtime") - F.col("s.mtime")) < tolerance) & no(same_size), True).when(no(~same_size), False)
    both = both.select("path", told.alias("told"), F.col("s.sha256").alias("was"))
    hashed = hashes(both.where("told is null").select("path")).select("path", F.col("sha256").alias("is"))
    return both.join(hashed, "path", "left").select("path", F.coalesce("told", no(F.col("was") == F.col("is"))).alias("current"))


_TREE = """, t as (select path, collection, name, regexp_replace(dir, '^.*/', '') as item, size_bytes, mtime, case when size_bytes % 6 = 0 then concat('k/', path) end as asset_key, size_bytes % 37 = 5 as is_dir,
    case when name like '%.%' then regexp_replace(name, '[.][^.]*$', '') else name end as st from files)"""
_KEPT = """select collection, key, max(size_bytes) as size_bytes, max(mtime) as mtime, max(sha256) as sha256 from (
  select collection, case size_bytes % 6 when 0 then asset_key when 1 then concat(item, '/', name) when 2 then name when 3 then concat(st, '.parquet') when 4 then concat(item, '/', st, '.parquet') end as key,
    case when size_bytes % 9 = 0 then null when size_bytes % 4 = 0 then size_bytes + 1 else size_bytes end as size_bytes, case when size_bytes % 8 = 3 then null when size_bytes % 3 = 0 then mtime - 10 else mtime + 1 end as mtime,
    sha2(concat(name, case when size_bytes % 7 = 0 then 'old' else '' end, cast(size_bytes % 5 as string)), 256) as sha256 from {t}) s where key is not null group by collection, key"""


@register("is_current", sql("files", _TREE + ", kept as (" + _KEPT.replace("{t}", "t").replace("sha2(", "sha256(").replace(", 256)", ")") + """),
k as (select path, collection, unnest([0, 1, 2, 3, 4]) as i, unnest([asset_key, item || '/' || name, name, st || '.parquet', item || '/' || st || '.parquet']) as key from t),
s as (select * from (select k.path, kept.size_bytes, kept.mtime, kept.sha256, row_number() over (partition by k.path order by i) as r from k join kept on kept.collection = k.collection and kept.key = k.key) x where r = 1)
select t.path, case when s.path is null then false when not t.is_dir and coalesce(abs(t.mtime - s.mtime) < 2, false) and coalesce(t.size_bytes = s.size_bytes, false) then true when not t.is_dir and coalesce(t.size_bytes <> s.size_bytes, false) then false
  else s.sha256 = sha256(t.name || cast(t.size_bytes % 5 as varchar)) end as current from t left join s on s.path = t.path"""))
def is_current_q(spark: SparkSession, sf: str) -> DataFrame:
    """Files of every key form, states that the time, the size or the hash decides; contents are derived from the rows."""
    t = spark.sql("with" + _TREE[1:].replace("from files", "from {files}") + " select * from t", files=view(spark, sf, "files"))
    content = t.select("path", F.sha2(F.concat("name", (F.col("size_bytes") % 5).cast("string")), 256).alias("sha256"))
    return is_current(t, spark.sql(_KEPT, t=t), ["collection"], lambda paths: paths.join(content, "path"))

