"""Version history as rows: snapshots, changes, pruning, and the diffs between a local and a remote manifest.

A row of version assets is (collection, asset, ord, version, sha256, size_bytes, removed): the state an asset got in a
version. Versions are ordered by ``ord``, or by the numbers of their semantic version, never by text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataspark.functions.text import parse_semver
from strataspark.plans.views import sql, view
from strataspark.registry import register

BY = ("collection", "asset")


def _assets(spark: SparkSession, sf: str, name: str = "assets") -> DataFrame:
    return view(spark, sf, name)


def snapshot_at(assets: DataFrame, upto: Column | int, by: tuple[str, ...] = BY) -> DataFrame:
    """The state at a version: of every asset the newest row up to it, without removed ones."""
    state = F.max_by(F.struct("ord", "version", "sha256", "size_bytes", "removed"), "ord")
    return assets.where(F.col("ord") <= upto).groupBy(*by).agg(state.alias("s")).select(*by, "s.*").where("not removed").drop("removed")


_SNAP = "select collection, asset, ord, version, sha256, size_bytes from (select *, row_number() over (partition by collection, asset order by ord desc) as rn from assets where ord <= {v}) s where rn = 1 and not removed"


@register("snapshot_at", sql("assets", _SNAP.format(v=4)))
def snapshot_at_q(spark: SparkSession, sf: str) -> DataFrame:
    return snapshot_at(_assets(spark, sf), 4)


@register("latest_version", sql("assets", "select collection, max(ord) as ord, '1.' || cast(max(ord) - 1 as varchar) || '.0' as version from assets group by collection"))
def latest_version_q(spark: SparkSession, sf: str) -> DataFrame:
    return latest_version(_assets(spark, sf))


def latest_version(assets: DataFrame, by: tuple[str, ...] = ("collection",)) -> DataFrame:
    return assets.groupBy(*by).agg(F.max("ord").alias("ord"), F.max_by("version", "ord").alias("version"))


@register("list_versions", sql("assets", "select collection, ord, version, cast(count(*) as bigint) as assets, cast(sum(size_bytes) as bigint) as size_bytes from assets group by collection, ord, version"))
def list_versions_q(spark: SparkSession, sf: str) -> DataFrame:
    return list_versions(_assets(spark, sf))


def list_versions(assets: DataFrame) -> DataFrame:
    """The version history, oldest first."""
    return assets.groupBy("collection", "ord", "version").agg(F.count("*").alias("assets"), F.sum("size_bytes").alias("size_bytes")).orderBy("collection", "ord")


def version_changes(assets: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """Assets that are new, or have another checksum than in their previous version."""
    before = F.lag("sha256").over(W.partitionBy(*by).orderBy("ord"))
    return assets.withColumn("before", before).where(~F.col("sha256").eqNullSafe(F.col("before"))).select(*by, "ord", "version", F.when(F.col("before").isNull(), "added").otherwise("changed").alias("change"))


_CHANGES = "select collection, asset, ord, version, case when b is null then 'added' else 'changed' end as change from (select *, lag(sha256) over (partition by collection, asset order by ord) as b from assets) x where b is null or b <> sha256"


@register("version_changes", sql("assets", _CHANGES))
def version_changes_q(spark: SparkSession, sf: str) -> DataFrame:
    return version_changes(_assets(spark, sf))


def noop_versions(assets: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """(collection, asset, ord) of versions that change nothing: what a publish drops unless it has a message, break or schema."""
    return assets.select(*by, "ord").join(version_changes(assets, by).select(*by, "ord"), [*by, "ord"], "left_anti")


@register("noop_version", sql("assets", f"select collection, asset, ord from assets except select collection, asset, ord from ({_CHANGES}) c"))
def noop_version_q(spark: SparkSession, sf: str) -> DataFrame:
    return noop_versions(_assets(spark, sf))


def next_version(version: Column, breaking: Column) -> Column:
    """None: 1.0.0; breaking: next major; else next minor."""
    v = parse_semver(version)
    up = F.when(breaking, F.concat_ws(".", (v["major"] + 1).cast("string"), F.lit("0"), F.lit("0"))).otherwise(F.concat_ws(".", v["major"].cast("string"), (v["minor"] + 1).cast("string"), F.lit("0")))
    return F.when(version.isNull(), "1.0.0").otherwise(up)


def patch_version(version: Column) -> Column:
    """The next version of generated assets: patch + 1; a pre-release counts its last number up, or gets .1."""
    pre = F.regexp_extract(version, r"^([^-]*)-(.*)$", 2)
    base = F.regexp_extract(version, r"^([^-]*)", 1)
    number = F.regexp_extract(pre, r"\.(\d+)$", 1)
    bumped = F.when(number != "", F.concat(F.regexp_replace(pre, r"\d+$", ""), (number.try_cast("long") + 1).cast("string"))).otherwise(F.concat(pre, F.lit(".1")))
    v = parse_semver(base)
    plain = F.concat_ws(".", v["major"].cast("string"), v["minor"].cast("string"), (v["patch"] + 1).cast("string"))
    return F.when(F.coalesce(version, F.lit("")) == "", "0.0.1").when(version.contains("-"), F.concat(base, F.lit("-"), bumped)).otherwise(plain)


@register("next_version", sql("assets", """select collection, asset, ord, '1.' || cast(ord as varchar) || '.0' as minor, '2.0.0' as major, '1.' || cast(ord - 1 as varchar) || '.1' as patch, '1.0.0' as first, version || '-rc.' || cast(ord + 1 as varchar) as pre from assets"""))
def next_version_q(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("version")
    pre = F.concat(v, F.lit("-rc."), F.col("ord").cast("string"))
    return _assets(spark, sf).select("collection", "asset", "ord", next_version(v, F.lit(False)).alias("minor"), next_version(v, F.lit(True)).alias("major"), patch_version(v).alias("patch"), next_version(F.lit(None).cast("string"), F.lit(False)).alias("first"), patch_version(pre).alias("pre"))


def rollback(versions: DataFrame, target: int) -> DataFrame:
    """The version log with a pointer row to the target appended: ``current`` says which ordinal readers see. Collections
    without the target have none (an error row: current is null)."""
    has = F.max(F.when(F.col("ord") == target, F.col("ord")))
    return versions.groupBy("collection").agg((F.max("ord") + 1).alias("ord"), has.alias("current"))


@register("rollback", sql("assets", """, p as (select collection, max(case when ord = 3 then ord end) as cur from assets group by collection)
  select a.collection, cast(count(*) as bigint) as assets, min(p.cur) as cur from (select *, row_number() over (partition by collection, asset order by ord desc) as rn from assets where ord <= 3) a join p on p.collection = a.collection where rn = 1 and not removed group by a.collection"""))
def rollback_q(spark: SparkSession, sf: str) -> DataFrame:
    a = _assets(spark, sf)
    log = rollback(list_versions(a), 3).select("collection", F.col("current").alias("cur"))
    return snapshot_at(a.join(log, "collection").withColumn("ord", F.when(F.col("ord") <= F.col("cur"), F.col("ord"))).where("ord is not null"), F.lit(1 << 40)).join(log, "collection").groupBy("collection").agg(F.count("*").alias("assets"), F.min("cur").alias("cur"))


def prune(versions: DataFrame, keep: int, by: tuple[str, ...] = ("collection",)) -> DataFrame:
    """Versions beyond the newest ``keep`` of each group: what a dry run lists."""
    return versions.withColumn("rn", F.row_number().over(W.partitionBy(*by).orderBy(F.col("ord").desc()))).where(F.col("rn") > keep).drop("rn")


@register("prune", sql("assets", "select collection, ord from (select collection, ord, row_number() over (partition by collection order by ord desc) as rn from (select distinct collection, ord from assets) d) x where rn > 3"))
def prune_q(spark: SparkSession, sf: str) -> DataFrame:
    return prune(_assets(spark, sf).select("collection", "ord").distinct(), 3)


def version_set_diff(local: DataFrame, remote: DataFrame, key: list[str]) -> DataFrame:
    """Every version with ``side``: local_only, remote_only or common. Remote-only versions are a conflict for a push."""
    a, b = local.select(*key).distinct().withColumn("_a", F.lit(True)), remote.select(*key).distinct().withColumn("_b", F.lit(True))
    both = a.join(b, key, "full")
    return both.select(*key, F.when(F.col("_b").isNull(), "local_only").when(F.col("_a").isNull(), "remote_only").otherwise("common").alias("side"))


@register("version_set_diff", sql("local remote", "select coalesce(l.collection, r.collection) as collection, coalesce(l.ord, r.ord) as ord, case when r.ord is null then 'local_only' when l.ord is null then 'remote_only' else 'common' end as side from (select distinct collection, ord from local) l full join (select distinct collection, ord from remote) r on l.collection = r.collection and l.ord = r.ord"))
def version_set_diff_q(spark: SparkSession, sf: str) -> DataFrame:
    return version_set_diff(_assets(spark, sf, "local"), _assets(spark, sf, "remote"), ["collection", "ord"])


@register("versions_except", sql("local remote", "select collection, ord, 'local' as only_in from (select distinct collection, ord from local) l where not exists (select 1 from remote r where r.collection = l.collection and r.ord = l.ord) union all select collection, ord, 'remote' from (select distinct collection, ord from remote) r where not exists (select 1 from local l where r.collection = l.collection and r.ord = l.ord)"))
def versions_except_q(spark: SparkSession, sf: str) -> DataFrame:
    return versions_except(_assets(spark, sf, "local").select("collection", "ord"), _assets(spark, sf, "remote").select("collection", "ord"))


def versions_except(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b).withColumn("only_in", F.lit("local")).union(b.subtract(a).withColumn("only_in", F.lit("remote")))


@register("versions_intersect", sql("local remote", "select distinct l.collection, l.ord from local l join remote r on r.collection = l.collection and r.ord = l.ord"))
def versions_intersect_q(spark: SparkSession, sf: str) -> DataFrame:
    return _assets(spark, sf, "local").select("collection", "ord").intersect(_assets(spark, sf, "remote").select("collection", "ord"))


def pull_diff(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Assets to download per collection: at the remote's newest state, new or with another checksum than the local one; and
    how the sides stand by version."""
    now = lambda df: snapshot_at(df, 1 << 40)
    l, r = now(local).select(*BY, F.col("sha256").alias("mine")), now(remote).select(*BY, "sha256", "size_bytes")
    get = r.join(l, list(BY), "left").where(~F.col("sha256").eqNullSafe(F.col("mine")))
    sums = get.groupBy("collection").agg(F.count("*").alias("downloads"), F.sum("size_bytes").alias("bytes"))
    state = sync_state(latest_version(local), latest_version(remote))
    return state.join(sums, "collection", "left").select("collection", "state", F.coalesce("downloads", F.lit(0)).alias("downloads"), F.coalesce("bytes", F.lit(0)).alias("bytes"))


_NOW = "select collection, asset, sha256, size_bytes from (select *, row_number() over (partition by collection, asset order by ord desc) as rn from {t}) s where rn = 1 and not removed"


def sync_state(local: DataFrame, remote: DataFrame) -> DataFrame:
    """unknown, behind, in_sync or ahead, by semantic version order of the current versions."""
    l = local.select("collection", F.col("version").alias("lv"))
    r = remote.select("collection", F.col("version").alias("rv"))
    a, b = parse_semver(F.col("lv")), parse_semver(F.col("rv"))
    state = F.when(F.col("lv").isNull() | F.col("rv").isNull(), "unknown").when(a < b, "behind").when(a > b, "ahead").otherwise("in_sync")
    return l.join(r, "collection", "full").select("collection", state.alias("state"))


@register("sync_state", sql("local remote", "select coalesce(l.collection, r.collection) as collection, case when l.o is null or r.o is null then 'unknown' when l.o < r.o then 'behind' when l.o > r.o then 'ahead' else 'in_sync' end as state from (select collection, max(ord) as o from local where collection % 4 <> 1 group by collection) l full join (select collection, max(ord) as o from remote where ord <= 3 + collection % 3 group by collection) r on l.collection = r.collection"))
def sync_state_q(spark: SparkSession, sf: str) -> DataFrame:
    r = _assets(spark, sf, "remote").where("ord <= 3 + collection % 3")
    return sync_state(latest_version(_assets(spark, sf, "local").where("collection % 4 <> 1")), latest_version(r))


@register("pull_diff", sql("local remote", f""", l as ({_NOW.format(t='local')}), r as ({_NOW.format(t='remote')}),
  g as (select r.collection, cast(count(*) as bigint) as downloads, cast(sum(r.size_bytes) as bigint) as bytes from r left join l on l.collection = r.collection and l.asset = r.asset where l.sha256 is null or l.sha256 <> r.sha256 group by r.collection),
  s as (select coalesce(a.collection, b.collection) as collection, case when a.o is null or b.o is null then 'unknown' when a.o < b.o then 'behind' when a.o > b.o then 'ahead' else 'in_sync' end as state from (select collection, max(ord) as o from local group by collection) a full join (select collection, max(ord) as o from remote group by collection) b on a.collection = b.collection)
  select s.collection, s.state, coalesce(g.downloads, 0) as downloads, coalesce(g.bytes, 0) as bytes from s left join g on g.collection = s.collection"""))
def pull_diff_q(spark: SparkSession, sf: str) -> DataFrame:
    return pull_diff(_assets(spark, sf, "local"), _assets(spark, sf, "remote"))


def upload_diff(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Assets of the local versions whose (asset, checksum) no remote version has; the earliest version's row stands for several."""
    new = local.where("not removed").join(remote.select("asset", "sha256", "collection").distinct(), ["collection", "asset", "sha256"], "left_anti")
    return new.groupBy("collection", "asset", "sha256").agg(F.min("ord").alias("ord"), F.min_by("size_bytes", "ord").alias("size_bytes"))


@register("upload_diff", sql("local remote", "select collection, asset, sha256, ord, size_bytes from (select *, row_number() over (partition by collection, asset, sha256 order by ord) as rn from local l where not removed and not exists (select 1 from remote r where r.collection = l.collection and r.asset = l.asset and r.sha256 = l.sha256)) x where rn = 1"))
def upload_diff_q(spark: SparkSession, sf: str) -> DataFrame:
    return upload_diff(_assets(spark, sf, "local"), _assets(spark, sf, "remote"))


def pull_conflicts(uncommitted: DataFrame, download: DataFrame, key: list[str]) -> DataFrame:
    """Uncommitted local changes that a pull would overwrite."""
    return uncommitted.join(download, key, "left_semi")


@register("pull_conflicts", sql("local remote", f", l as ({_NOW.format(t='local')}), r as ({_NOW.format(t='remote')}) select l.collection, l.asset from l join r on l.collection = r.collection and l.asset = r.asset where l.sha256 <> r.sha256 and l.size_bytes % 3 = 0"))
def pull_conflicts_q(spark: SparkSession, sf: str) -> DataFrame:
    l, r = snapshot_at(_assets(spark, sf, "local"), 1 << 40), snapshot_at(_assets(spark, sf, "remote"), 1 << 40)
    get = r.select(*BY, "sha256").join(l.select(*BY, F.col("sha256").alias("mine")), list(BY)).where("sha256 <> mine").select(*BY)
    return pull_conflicts(l.where("size_bytes % 3 = 0").select(*BY), get, list(BY))


def merge_assets(old: DataFrame, new: DataFrame, removed: DataFrame, key: list[str]) -> DataFrame:
    """The next version's asset map: the old one carried forward, new rows in, removed keys out."""
    cols = [c for c in old.columns if c not in key]
    n = new.select(*key, *[F.col(c).alias(f"n_{c}") for c in cols], F.lit(True).alias("_n"))
    both = old.join(n, key, "full").join(removed.select(*key), key, "left_anti")
    return both.select(*key, *[F.when(F.col("_n"), F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) for c in cols])


@register("merge_assets", sql("assets", """, o as (select collection, asset, sha256, size_bytes from assets where ord = 2), n as (select collection, asset, sha256, size_bytes from assets where ord = 3 and size_bytes % 2 = 0), d as (select collection, asset from assets where ord = 4 and size_bytes % 5 = 0 and collection % 2 = 0)
  select coalesce(n.collection, o.collection) as collection, coalesce(n.asset, o.asset) as asset, coalesce(n.sha256, o.sha256) as sha256, coalesce(n.size_bytes, o.size_bytes) as size_bytes from o full join n on o.collection = n.collection and o.asset = n.asset
  where not exists (select 1 from d where d.collection = coalesce(n.collection, o.collection) and d.asset = coalesce(n.asset, o.asset))"""))
def merge_assets_q(spark: SparkSession, sf: str) -> DataFrame:
    a = _assets(spark, sf)
    cols = (*BY, "sha256", "size_bytes")
    return merge_assets(a.where("ord = 2").select(*cols), a.where("ord = 3 and size_bytes % 2 = 0").select(*cols), a.where("ord = 4 and size_bytes % 5 = 0 and collection % 2 = 0").select(*BY), list(BY))


def merge_records(old: DataFrame, new: DataFrame, key: list[str], machine: list[str], human: list[str], mode: str = "smart") -> DataFrame:
    """Field-wise merge: smart takes machine fields from the new side and human ones from the old; keep and overwrite prefer
    one side for all. A side's null yields to the other."""
    cols = [*machine, *human]
    n = new.select(*key, *[F.col(c).alias(f"n_{c}") for c in cols])
    pick = lambda c: F.coalesce(F.col(f"n_{c}"), F.col(c)) if mode == "overwrite" or (mode == "smart" and c in machine) else F.coalesce(F.col(c), F.col(f"n_{c}"))
    return old.select(*key, *cols).join(n, key, "full").select(*key, *[pick(c).alias(c) for c in cols])


@register("merge_records", sql("assets", """, o as (select collection, asset, sha256, size_bytes from assets where ord = 2), n as (select collection, asset, sha256, size_bytes from assets where ord = 5)
  select coalesce(o.collection, n.collection) as collection, coalesce(o.asset, n.asset) as asset, coalesce(n.size_bytes, o.size_bytes) as size_bytes, coalesce(o.sha256, n.sha256) as sha256 from o full join n on o.collection = n.collection and o.asset = n.asset"""))
def merge_records_q(spark: SparkSession, sf: str) -> DataFrame:
    a = _assets(spark, sf)
    return merge_records(a.where("ord = 2"), a.where("ord = 5"), list(BY), ["size_bytes"], ["sha256"])


@register("asset_version_lookup", sql("assets", "select a.collection, a.asset, coalesce(max(case when e.k is not null then a.ord end), max(a.ord)) as ord from assets a left join (select collection, asset, 1 as k from assets where ord = 2) e on e.collection = a.collection and e.asset = a.asset and a.ord = 2 where a.ord <= 5 group by a.collection, a.asset"))
def asset_version_lookup_q(spark: SparkSession, sf: str) -> DataFrame:
    a = _assets(spark, sf).where("ord <= 5")
    scoped = a.where("ord = 2").select("collection", "asset", "ord")
    return asset_version_lookup(a.select(*BY).distinct(), scoped, a.groupBy(*BY).agg(F.max("ord").alias("ord")), list(BY))


def asset_version_lookup(paths: DataFrame, scoped: DataFrame, bare: DataFrame, key: list[str]) -> DataFrame:
    """Which version holds a path: by its item-scoped key, else by its bare name (two equi-joins for one OR)."""
    one = paths.join(scoped.withColumnRenamed("ord", "_s"), key, "left")
    return one.join(bare.withColumnRenamed("ord", "_b"), key, "left").select(*key, F.coalesce("_s", "_b").alias("ord"))


def untrack_assets(snapshot: DataFrame, files: DataFrame, version: int) -> DataFrame:
    """Tombstone rows, a new version, for the listed files that the snapshot holds by href, else by the converted ``.parquet``."""
    wanted = files.select(F.explode(F.array("asset", F.concat(F.regexp_replace("asset", r"\.[^.]*$", ""), F.lit(".parquet")))).alias("asset"), "collection").distinct()
    return snapshot.join(wanted, ["collection", "asset"], "left_semi").select("collection", "asset", F.lit(version).cast("long").alias("ord"), F.lit(True).alias("removed"))


@register("untrack_assets", sql("assets", "select collection, asset, cast(8 as bigint) as ord, true as removed from (select *, row_number() over (partition by collection, asset order by ord desc) as rn from assets) s where rn = 1 and not removed and collection % 5 = 0"))
def untrack_assets_q(spark: SparkSession, sf: str) -> DataFrame:
    s = snapshot_at(_assets(spark, sf), 1 << 40)
    return untrack_assets(s, s.where("collection % 5 = 0"), 8)


def catalog_rollup(assets: DataFrame) -> DataFrame:
    """Per collection: current version, assets and bytes in it."""
    s = snapshot_at(assets, 1 << 40)
    return s.groupBy("collection").agg(F.max_by("version", "ord").alias("version"), F.count("*").alias("assets"), F.sum("size_bytes").alias("size_bytes"))


@register("catalog_rollup", sql("assets", f"select collection, '1.' || cast(max(ord) - 1 as varchar) || '.0' as version, cast(count(*) as bigint) as assets, cast(sum(size_bytes) as bigint) as size_bytes from ({_SNAP.format(v=99)}) s group by collection"))
def catalog_rollup_q(spark: SparkSession, sf: str) -> DataFrame:
    return catalog_rollup(_assets(spark, sf))


@register("collection_info", sql("assets items", f"select i.collection, i.items, s.size_bytes, i.mirror from (select collection, cast(count(*) as bigint) as items, collection % 2 = 0 as mirror from items group by collection) i join (select collection, cast(sum(size_bytes) as bigint) as size_bytes from ({_SNAP.format(v=99)}) s group by collection) s on s.collection = i.collection"))
def collection_info_q(spark: SparkSession, sf: str) -> DataFrame:
    items = view(spark, sf, "items").withColumn("mirror", F.col("collection") % 2 == 0)
    return collection_info(items, _assets(spark, sf))


def collection_info(items: DataFrame, assets: DataFrame) -> DataFrame:
    """Item count, bytes of the current version, mirror flag."""
    i = items.groupBy("collection").agg(F.count("*").alias("items"), F.first("mirror").alias("mirror"))
    return i.join(catalog_rollup(assets).select("collection", "size_bytes"), "collection")


def catalog_provenance(collections: DataFrame, by: list[str]) -> DataFrame:
    """Per catalog (columns ``by``) the newest update, only if every collection is a mirror."""
    return collections.groupBy(*by).agg(F.bool_and("mirror").alias("all_mirrors"), F.max("updated").alias("updated")).select(*by, "all_mirrors", F.when(F.col("all_mirrors"), F.col("updated")).alias("updated"))


@register("catalog_provenance", sql("assets", ", c as (select collection, max(ord) as updated from assets group by collection) select g as catalog, bool_and(collection % 10 <> 4 or g <> 1) as all_mirrors, case when bool_and(collection % 10 <> 4 or g <> 1) then max(updated) end as updated from c, (select unnest([0, 1, 2]) as g) s where collection % 3 = g group by g"))
def catalog_provenance_q(spark: SparkSession, sf: str) -> DataFrame:
    """Three catalogs of the collections; one of them holds a collection that is no mirror."""
    c = _assets(spark, sf).groupBy("collection").agg(F.max("ord").alias("updated")).withColumn("catalog", (F.col("collection") % 3).cast("int"))
    c = c.withColumn("mirror", (F.col("collection") % 10 != 4) | (F.col("catalog") != 1))
    return catalog_provenance(c, ["catalog"])
