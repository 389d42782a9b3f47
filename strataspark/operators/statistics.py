"""Statistics of columns, bands and geometries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataspark.plans.views import sql, view
from strataspark.registry import register
from strataspark.session import scratch

NESTED = ("array", "map", "struct", "binary", "variant")


def column_statistics(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Long table (column, min, max, null_count as text and count) of the flat columns, in one aggregation of the scan."""
    by = by or []
    cols = [c for c, t in df.dtypes if c not in by and not t.startswith(NESTED)]
    agg = df.groupBy(*by).agg(*[x for c in cols for x in (F.min(f"`{c}`").cast("string").alias(f"{c}__min"), F.max(f"`{c}`").cast("string").alias(f"{c}__max"), F.count_if(F.col(f"`{c}`").isNull()).alias(f"{c}__null"))])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}__min").alias("min"), F.col(f"{c}__max").alias("max"), F.col(f"{c}__null").alias("null_count")) for c in cols])
    return agg.select(*by, F.explode(rows).alias("r")).select(*by, "r.*").where("min is not null")


@register("column_statistics", """select c as "column", mn as "min", mx as "max", n as null_count from (
  select 'l_orderkey' as c, cast(min(l_orderkey) as varchar) as mn, cast(max(l_orderkey) as varchar) as mx, cast(count(*) - count(l_orderkey) as bigint) as n from lineitem
  union all select 'l_returnflag', min(l_returnflag), max(l_returnflag), cast(count(*) - count(l_returnflag) as bigint) from lineitem
  union all select 'l_linenumber', cast(min(l_linenumber) as varchar), cast(max(l_linenumber) as varchar), cast(count(*) - count(l_linenumber) as bigint) from lineitem
  union all select 'half', cast(min(case when l_linenumber % 2 = 0 then l_partkey end) as varchar), cast(max(case when l_linenumber % 2 = 0 then l_partkey end) as varchar), cast(count(*) - count(case when l_linenumber % 2 = 0 then l_partkey end) as bigint) from lineitem) s""")
def column_statistics_q(spark: SparkSession, sf: str) -> DataFrame:
    df = view(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", "l_linenumber", F.expr("case when l_linenumber % 2 = 0 then l_partkey end").alias("half"), F.array("l_tax").alias("nested"))
    return column_statistics(df)


def band_statistics(pixels: DataFrame, by: list[str], nodata: float | None = None, fraction: float | None = None) -> DataFrame:
    """Min, max, mean, standard deviation and valid percent per band; ``fraction`` samples pixels (the approximate mode)."""
    p = pixels.sample(fraction, seed=7) if fraction else pixels
    bad = F.isnan("value") | F.col("value").isNull() | (F.col("value") == F.lit(nodata) if nodata is not None else F.lit(False))
    v = F.when(~F.coalesce(bad, F.lit(True)), F.col("value"))
    return p.groupBy(*by).agg(F.min(v).alias("min"), F.max(v).alias("max"), F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_pop(v), 6).alias("stddev"), F.round(100 * F.count(v) / F.count("*"), 6).alias("valid_percent"))


@register("band_statistics", sql("pixels", "select band, min(v) as \"min\", max(v) as \"max\", round(avg(v), 6) as mean, round(stddev_pop(v), 6) as stddev, round(100.0e0 * count(v) / count(*), 6) as valid_percent from (select band, case when round(value, 1) <> 0.1e0 then round(value, 1) end as v from pixels) p group by band"))
def band_statistics_q(spark: SparkSession, sf: str) -> DataFrame:
    return band_statistics(view(spark, sf, "pixels").select("band", F.round("value", 1).alias("value")), ["band"], nodata=0.1)


MOMENTS = ("pixels", "valid", "mean", "m2", "min", "max")


def band_moments(pixels: DataFrame, by: list[str], nodata: float | None = None) -> DataFrame:
    """Mergeable statistics per group: pixels, valid ones, their mean, the sum of squared deviations from it, and extremes."""
    bad = F.isnan("value") | F.col("value").isNull() | (F.col("value") == F.lit(nodata) if nodata is not None else F.lit(False))
    v = F.when(~F.coalesce(bad, F.lit(True)), F.col("value"))
    return pixels.groupBy(*by).agg(F.count("*").alias("pixels"), F.count(v).alias("valid"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count(v)).alias("m2"), F.min(v).alias("min"), F.max(v).alias("max"))


def merge_moments(moments: DataFrame, by: list[str]) -> DataFrame:
    """The moments of groups from those of their parts. Deviations are taken from the common mean, not as a difference of squares."""
    common = moments.where("valid > 0").groupBy(*by).agg((F.sum(F.col("valid") * F.col("mean")) / F.sum("valid")).alias("_mean"))
    off = F.col("mean") - F.col("_mean")
    return moments.join(common, by, "left").groupBy(*by).agg(
        F.sum("pixels").alias("pixels"), F.sum("valid").alias("valid"), F.first("_mean").alias("mean"), F.sum(F.col("m2") + F.col("valid") * off * off).alias("m2"), F.min("min").alias("min"), F.max("max").alias("max"))


def band_statistics_cached(pixels: DataFrame, files: DataFrame, store: str, by: list[str], file: str = "file", nodata: float | None = None) -> DataFrame:
    """Statistics per band from stored moments: only the pixels of files that the store lacks, or has with another stamp, are read.

    ``files``: a row a file (``file``, stamp); files that are gone no longer count. ``pixels`` is a table partitioned by the
    file's column, so that the join with the new files reads their partitions alone. ``store`` is a folder of Parquet to which
    the new files' moments (a row per file and band) are added; the newest of a file's stamp counts.
    """
    spark = pixels.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    kept = spark.read.parquet(store) if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path) else None
    new = files.select(file, "stamp")
    new = new if kept is None else new.join(kept.select(file, "stamp").distinct(), [file, "stamp"], "left_anti")
    at = scratch(spark, "new_files")
    new.withColumn("n", F.lit(1)).write.parquet(at)
    new = spark.read.parquet(at).where("n > 0").drop("n")
    if not new.isEmpty():
        band_moments(pixels.join(new, file), [file, "stamp", *by], nodata).withColumn("added", F.current_timestamp()).write.mode("append").parquet(store)
    newest = spark.read.parquet(store).groupBy(file, "stamp", *by).agg(F.max_by(F.struct(*MOMENTS), "added").alias("m")).select(file, "stamp", *by, "m.*")
    whole = merge_moments(newest.join(files.select(file, "stamp"), [file, "stamp"], "left_semi"), by)
    return whole.select(*by, "min", "max", F.round("mean", 6).alias("mean"), F.round(F.sqrt(F.col("m2") / F.col("valid")), 6).alias("stddev"), F.round(100 * F.col("valid") / F.col("pixels"), 6).alias("valid_percent"))


@register("band_statistics_cached", sql("pixels", "select band, min(v) as \"min\", max(v) as \"max\", round(avg(v), 6) as mean, round(stddev_pop(v), 6) as stddev, round(100.0e0 * count(v) / count(*), 6) as valid_percent from (select band, case when round(value, 1) <> 0.1e0 then round(value, 1) end as v from pixels where image % 16 <> 3) p group by band"))
def band_statistics_cached_q(spark: SparkSession, sf: str) -> DataFrame:
    """Three runs over one store: half of the files; all; all with one file changed and one gone."""
    path, store = scratch(spark, "tiles"), scratch(spark, "moments")
    view(spark, sf, "pixels").select((F.col("image") % 16).alias("file"), "band", F.round("value", 1).alias("value")).hint("rebalance", "file").write.partitionBy("file").parquet(path)
    tiles = spark.read.schema("band bigint, value double, file bigint").parquet(path)
    files = spark.range(16).select(F.col("id").alias("file"), F.lit("a").alias("stamp"))
    band_statistics_cached(tiles, files.where("file < 8"), store, ["band"], nodata=0.1)
    band_statistics_cached(tiles, files, store, ["band"], nodata=0.1)
    changed = files.where("file <> 3").withColumn("stamp", F.when(F.col("file") == 5, "b").otherwise("a"))
    return band_statistics_cached(tiles, changed, store, ["band"], nodata=0.1)


GRID = 1024  # cells of a sketch; a pass leaves about three of them
INSIDE = 100_000  # values of a bracket that are counted one by one


def exact_quantiles(df: DataFrame, by: list[str], value: str, quantiles: list[float], inside: int = INSIDE) -> DataFrame:
    """(by, i, v): the i-th quantile of each group, interpolated between its two ranks, exactly, with no buffer that grows.

    Every rank has a bracket of values, at first all. While a bracket holds more than ``inside`` values, a pass narrows it: a
    mergeable sketch of the values inside gives a grid of their quantiles, and the cells about the rank are the next bracket
    (a pass leaves about 3 / GRID of the values; one value that fills a bracket ends it). Then the distinct values inside are
    counted, and the rank found by adding up. Nulls and NaN have no rank; groups without values, and null groups, no row.
    """
    spark, keys = df.sparkSession, by
    by = [f"_k{j}" for j in range(len(keys))]
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*[F.col(k).alias(b) for k, b in zip(keys, by)], F.col(value).cast("double").alias("_v"))
    wanted = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(q)).alias("q")) for i, q in enumerate(quantiles)])).alias("w")
    at = rows.groupBy(*by).agg(F.count("*").alias("n")).select(*by, "n", wanted).select(*by, "w.i", ((F.col("n") - 1) * F.col("w.q")).alias("pos"), "n")
    at = at.select(*by, "i", F.floor("pos").alias("r0"), F.least(F.floor("pos") + 1, F.col("n") - 1).alias("r1"), (F.col("pos") - F.floor("pos")).alias("part"), F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"), F.lit(0).cast("long").alias("below"), F.col("n").alias("held"))

    def written(x: DataFrame) -> DataFrame:
        path = scratch(spark, "brackets")
        x.write.parquet(path)
        return spark.read.parquet(path)

    at = written(at)
    within = (F.col("_v") >= F.col("lo")) & (F.col("_v") <= F.col("hi"))
    names = [*by, "i", "r0", "r1", "part"]
    while not at.where((F.col("held") > inside) & (F.col("lo") < F.col("hi"))).isEmpty():
        wide = at.where((F.col("held") > inside) & (F.col("lo") < F.col("hi")))
        grid = F.percentile_approx(F.when(within, F.col("_v")), [k / GRID for k in range(GRID + 1)], 10 * GRID)
        cells = rows.join(wide, by).groupBy(*names).agg(grid.alias("g"), F.first("below").alias("below"), F.first("held").alias("held"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
        cell = lambda r, more: F.floor((F.col(r) - F.col("below")) * GRID / F.col("held")) + more
        low, high = F.greatest(cell("r0", -1), F.lit(0)), F.least(cell("r1", 3), F.lit(GRID))
        next_ = cells.select(*names, F.when(cell("r0", -1) > 0, F.element_at("g", (low + 1).cast("int"))).otherwise(F.col("lo")).alias("lo"), F.when(cell("r1", 3) < GRID, F.element_at("g", (high + 1).cast("int"))).otherwise(F.col("hi")).alias("hi"), F.col("held").alias("_before"))
        counted = rows.join(next_, by).groupBy(*names, "lo", "hi", "_before").agg(F.count_if(F.col("_v") < F.col("lo")).alias("below"), F.count_if(within).alias("held"))
        # A bracket that does not shrink holds few distinct values, or values that fill many cells: they are counted.
        counted = counted.withColumn("held", F.when(F.col("held") < F.col("_before"), F.col("held")).otherwise(F.lit(0)))
        at = written(counted.select(*names, "lo", "hi", "below", "held").union(at.where((F.col("held") <= inside) | (F.col("lo") >= F.col("hi"))).select(*names, "lo", "hi", "below", "held")))
    held = rows.join(at.drop("held"), by).where(within).groupBy(*names, "below", "_v").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(W.partitionBy(*by, "i").orderBy("_v")) + F.col("below")
    first = lambda r: F.min(F.when(F.col("_upto") > F.col(r), F.col("_v")))
    return held.withColumn("_upto", upto).groupBy(*by, "i", "part").agg(first("r0").alias("a"), first("r1").alias("b")).select(*[F.col(b).alias(k) for k, b in zip(keys, by)], "i", F.when(F.col("part") == 0, F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * F.col("part")).alias("v"))


def percentile_stretch(pixels: DataFrame, by: list[str], low: float = 0.02, high: float = 0.98, inside: int = INSIDE) -> DataFrame:
    """Values stretched from the low and high percentile of their group to 0..255, not rounded; invalid values to 0."""
    q = exact_quantiles(pixels, by, "value", [low, high], inside).groupBy(*by).agg(F.max(F.when(F.col("i") == 0, F.col("v"))).alias("lo"), F.max(F.when(F.col("i") == 1, F.col("v"))).alias("hi"))
    x = F.least(F.greatest((F.col("value") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0)) * 255
    return pixels.join(q, by, "left").withColumn("stretched", F.coalesce(F.when(F.isnan("value"), 0.0).otherwise(x), F.lit(0.0))).drop("lo", "hi")


@register("percentile_stretch", sql("pixels", ", q as (select band, quantile_cont(value, 0.02) as lo, quantile_cont(value, 0.98) as hi from pixels group by band) select image, idx, cast(floor(coalesce(least(greatest((value - lo) / nullif(hi - lo, 0), 0), 1) * 255, 0) + 1e-9) as bigint) as stretched from pixels p join q on q.band = p.band"))
def percentile_stretch_q(spark: SparkSession, sf: str) -> DataFrame:
    return percentile_stretch(view(spark, sf, "pixels"), ["band"]).select("image", "idx", F.floor(F.col("stretched") + 1e-9).alias("stretched"))


@register("exact_quantiles", sql("pixels", "select band, 0 as i, round(min(value), 9) as v from pixels group by band union all " + " union all ".join(f"select band, {i}, round(quantile_cont(value, {q}), 9) from pixels group by band" for i, q in ((1, 0.02), (2, 0.5), (3, 0.98), (4, 1.0)))))
def exact_quantiles_q(spark: SparkSession, sf: str) -> DataFrame:
    """Brackets are narrowed here from a few hundred values on, so that every size of the table takes passes."""
    return exact_quantiles(view(spark, sf, "pixels"), ["band"], "value", [0.0, 0.02, 0.5, 0.98, 1.0], 300).select("band", "i", F.round("v", 9).alias("v"))


def geometry_profile(features: DataFrame, by: list[str]) -> DataFrame:
    """Dominant geometry category, features, and the density class (200 and 2000 features) that drives marker size and opacity."""
    n = features.groupBy(*by, "category").agg(F.count("*").alias("n"))
    top = n.groupBy(*by).agg(F.max_by("category", F.struct("n", "category")).alias("category"), F.sum("n").alias("features"))
    return top.withColumn("density", F.when(F.col("features") < 200, "sparse").when(F.col("features") < 2000, "medium").otherwise("dense")).withColumn("opacity", F.when(F.col("features") < 200, 0.9).when(F.col("features") < 2000, 0.7).otherwise(0.4))


@register("geometry_profile", sql("items", ", n as (select collection, case ln % 3 when 0 then 'point' when 1 then 'line' else 'polygon' end as c, count(*) as n from items group by 1, 2), t as (select collection, sum(n) as f from n group by 1) select t.collection, (select c from n where n.collection = t.collection order by n desc, c desc limit 1) as category, cast(f as bigint) as features, case when f < 200 then 'sparse' when f < 2000 then 'medium' else 'dense' end as density, case when f < 200 then 0.9e0 when f < 2000 then 0.7e0 else 0.4e0 end as opacity from t"))
def geometry_profile_q(spark: SparkSession, sf: str) -> DataFrame:
    return geometry_profile(view(spark, sf, "items").select("collection", F.expr("case ln % 3 when 0 then 'point' when 1 then 'line' else 'polygon' end").alias("category")), ["collection"])
