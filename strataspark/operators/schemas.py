"""Schemas as rows: differences, unions, fingerprints, partition checks, extents of values by field.

A schema row is (table_name, version, element, dtype, nullable, crs, geometry_type, nodata).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspark.functions import text as T
from strataspark.plans.views import sql, view
from strataspark.registry import register

FIELDS = ("dtype", "nullable", "crs", "geometry_type", "nodata")


def _schemas(spark: SparkSession, sf: str, version: int | None = None) -> DataFrame:
    df = view(spark, sf, "schemas")
    return df if version is None else df.where(F.col("version") == version).drop("version")


def schema_diff(old: DataFrame, new: DataFrame, formats: DataFrame | None = None) -> DataFrame:
    """Breaking changes (table_name, element, change). ``formats`` (table_name, old_format, new_format): where a format changed,
    that is the only change. An added element, or a column that becomes nullable, breaks nothing; two NaN nodata values are equal."""
    n = new.select("table_name", "element", *[F.col(c).alias(f"n_{c}") for c in FIELDS], F.lit(True).alias("_n"))
    both = old.join(n, ["table_name", "element"], "left")
    there, differ = F.col("_n"), lambda c: ~F.col(c).eqNullSafe(F.col(f"n_{c}"))
    changes = F.array_compact(F.array(
        F.when(there.isNull(), "column_removed"), F.when(there & differ("dtype"), "type_changed"), F.when(there & differ("geometry_type"), "geometry_type_changed"),
        F.when(there & differ("crs"), "column_crs_changed"), F.when(there & F.col("nullable") & ~F.col("n_nullable"), "nullable_changed"), F.when(there & differ("nodata"), "nodata_changed")))
    out = both.select("table_name", "element", F.explode(changes).alias("change"))
    if formats is None:
        return out
    moved = formats.where("old_format <> new_format").select("table_name")
    return out.join(moved, "table_name", "left_anti").unionByName(moved.select("table_name", F.lit("format").alias("element"), F.lit("format_changed").alias("change")))


_DIFF = """, o as (select * from schemas where version = 0), n as (select * from schemas where version = 1), j as (select o.*, n.element as e, n.dtype as nd, n.geometry_type as ng, n.crs as nc, n.nullable as nn, n.nodata as nv from o left join n on o.table_name = n.table_name and o.element = n.element),
  c as (select table_name, element, 'column_removed' as change from j where e is null union all select table_name, element, 'type_changed' from j where dtype <> nd union all select table_name, element, 'geometry_type_changed' from j where geometry_type <> ng
    union all select table_name, element, 'column_crs_changed' from j where crs <> nc union all select table_name, element, 'nullable_changed' from j where nullable and not nn union all select table_name, element, 'nodata_changed' from j where e is not null and nodata is distinct from nv)
  select * from c where table_name <> 'Brand#3' union all select 'Brand#3', 'format', 'format_changed'"""


@register("schema_diff", sql("schemas", _DIFF))
def schema_diff_q(spark: SparkSession, sf: str) -> DataFrame:
    old = _schemas(spark, sf, 0)
    formats = _schemas(spark, sf).select("table_name").distinct().select("table_name", F.lit("geoparquet").alias("old_format"), F.when(F.col("table_name") == "Brand#3", "cog").otherwise("geoparquet").alias("new_format"))
    return schema_diff(old, _schemas(spark, sf, 1), formats)


def merge_table_columns(old: DataFrame, new: DataFrame) -> DataFrame:
    """The new schema with the old descriptions of columns that stay; vanished columns go."""
    return new.join(old.select("table_name", "element", "description"), ["table_name", "element"], "left")


@register("merge_table_columns", sql("schemas", "select n.table_name, n.element, n.dtype, o.geometry_type || ' ' || o.dtype as description from (select * from schemas where version = 1) n left join (select * from schemas where version = 0) o on o.table_name = n.table_name and o.element = n.element"))
def merge_table_columns_q(spark: SparkSession, sf: str) -> DataFrame:
    old = _schemas(spark, sf, 0).withColumn("description", F.concat_ws(" ", "geometry_type", "dtype"))
    return merge_table_columns(old, _schemas(spark, sf, 1).select("table_name", "element", "dtype"))


def union_schemas(schemas: DataFrame, order: str = "version") -> DataFrame:
    """Union of element names over tables: the first type wins, and whether others disagreed."""
    return schemas.groupBy("element").agg(F.min_by("dtype", F.struct(order, "table_name")).alias("dtype"), (F.countDistinct("dtype") > 1).alias("conflict"))


@register("union_schemas", sql("schemas", "select element, max(case when rn = 1 then dtype end) as dtype, count(distinct dtype) > 1 as conflict from (select *, row_number() over (partition by element order by version, table_name) as rn from schemas) s group by element"))
def union_schemas_q(spark: SparkSession, sf: str) -> DataFrame:
    return union_schemas(_schemas(spark, sf))


def aggregate_table_metadata(tables: DataFrame, by: list[str]) -> DataFrame:
    """Rows summed, boxes united, the first CRS and type, the number of types seen."""
    return tables.groupBy(*by).agg(F.sum("rows").alias("rows"), F.min("xmin").alias("xmin"), F.max("xmax").alias("xmax"), F.min_by("crs", "ord").alias("crs"), F.min_by("dtype", "ord").alias("dtype"), F.countDistinct("dtype").alias("types"))


@register("aggregate_table_metadata", sql("schemas", "select element, cast(sum(version * 10 + 1) as bigint) as rows, min(xm) as xmin, max(xm) as xmax, max(case when rn = 1 then crs end) as crs, max(case when rn = 1 then dtype end) as dtype, cast(count(distinct dtype) as bigint) as types from (select *, cast(length(table_name) as double) as xm, row_number() over (partition by element order by table_name, version) as rn from schemas) s group by element"))
def aggregate_table_metadata_q(spark: SparkSession, sf: str) -> DataFrame:
    t = _schemas(spark, sf).withColumn("rows", F.col("version") * 10 + 1).withColumn("xmin", F.length("table_name").cast("double")).withColumn("xmax", F.col("xmin")).withColumn("ord", F.struct("table_name", "version"))
    return aggregate_table_metadata(t, ["element"])


def crs_geometry_mismatch(schemas: DataFrame, by: list[str]) -> DataFrame:
    """Groups with more than one CRS or geometry type, and which."""
    texts = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    return schemas.groupBy(*by).agg(texts("crs").alias("crs"), texts("geometry_type").alias("geometry_types")).where(F.col("crs").contains(",") | F.col("geometry_types").contains(","))


@register("crs_geometry_mismatch", sql("schemas", "select table_name, crs, geometry_types from (select table_name, string_agg(distinct crs, ',' order by crs) as crs, string_agg(distinct geometry_type, ',' order by geometry_type) as geometry_types from schemas group by table_name) s where crs like '%,%' or geometry_types like '%,%'"))
def crs_geometry_mismatch_q(spark: SparkSession, sf: str) -> DataFrame:
    return crs_geometry_mismatch(_schemas(spark, sf), ["table_name"])


def partition_schema_check(footers: DataFrame, by: list[str]) -> DataFrame:
    """Columns that not every partition has, or has with one type. ``footers``: by, file, column, dtype."""
    files = footers.groupBy(*by).agg(F.countDistinct("file").alias("files"))
    cols = footers.groupBy(*by, "column").agg(F.countDistinct("file").alias("n"), F.countDistinct("dtype").alias("types"))
    problem = F.when(F.col("types") > 1, "type differs").when(F.col("n") < F.col("files"), "missing in some")
    return cols.join(files, by).select(*by, "column", problem.alias("problem")).where("problem is not null")


@register("partition_schema_check", sql("schemas", ", f as (select table_name, count(distinct version) as files from schemas group by table_name) select s.table_name, s.element as \"column\", case when count(distinct dtype) > 1 then 'type differs' else 'missing in some' end as problem from schemas s join f on f.table_name = s.table_name group by s.table_name, s.element, f.files having count(distinct dtype) > 1 or count(distinct version) < f.files"))
def partition_schema_check_q(spark: SparkSession, sf: str) -> DataFrame:
    return partition_schema_check(_schemas(spark, sf).select("table_name", F.col("version").alias("file"), F.col("element").alias("column"), "dtype"), ["table_name"])


def schema_fingerprint(schemas: DataFrame, by: list[str]) -> DataFrame:
    """First 16 hex digits of the SHA-256 over a schema's sorted name:type lines."""
    return schemas.groupBy(*by).agg(T.fingerprint(F.collect_list(F.concat_ws(":", "element", "dtype"))).alias("fingerprint"))


@register("schema_fingerprint", sql("schemas", "select table_name, version, substr(sha256(string_agg(element || ':' || dtype, '|' order by element || ':' || dtype)), 1, 16) as fingerprint from schemas group by table_name, version"))
def schema_fingerprint_q(spark: SparkSession, sf: str) -> DataFrame:
    return schema_fingerprint(_schemas(spark, sf), ["table_name", "version"])


#: Engine type to public type name.
TYPE_NAMES = {"bigint": "int64", "int": "int32", "smallint": "int16", "double": "float64", "float": "float32", "string": "string", "boolean": "boolean", "binary": "binary", "date": "date", "timestamp": "datetime", "timestamp_ntz": "datetime"}


def stac_type(c: Column) -> Column:
    """The public name of an engine type; unknown ones keep their own text."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in TYPE_NAMES.items() for x in kv]), c), c)


def stac_type_names(df: DataFrame) -> DataFrame:
    """A row per column: name, public type name, nullable."""
    rows = [(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, "element string, dtype string, nullable boolean").withColumn("dtype", stac_type(F.col("dtype")))


_KINDS = "case p_partkey % 8 when 0 then 'bigint' when 1 then 'int' when 2 then 'double' when 3 then 'timestamp_ntz' when 4 then 'array<int>' when 5 then 'binary' when 6 then 'date' else p_type end"


@register("stac_type_name", f"select p_brand, dtype, cast(count(*) as bigint) as columns from (select p_brand, case k when 'bigint' then 'int64' when 'int' then 'int32' when 'double' then 'float64' when 'timestamp_ntz' then 'datetime' else k end as dtype from (select p_brand, {_KINDS} as k from part) p) q group by p_brand, dtype")
def stac_type_name_q(spark: SparkSession, sf: str) -> DataFrame:
    """Columns of many tables, described by rows: how many there are of each public type."""
    return view(spark, sf, "part").select("p_brand", stac_type(F.expr(_KINDS)).alias("dtype")).groupBy("p_brand", "dtype").agg(F.count("*").alias("columns"))


#: Names of geometry columns, the first that is there counts.
GEOMETRY_NAMES = ("geometry", "geom")


def find_geometry_column(df: DataFrame) -> str | None:
    """``geometry``, then ``geom``, if binary; else none."""
    kinds = dict(df.dtypes)
    return next((c for c in GEOMETRY_NAMES if kinds.get(c) == "binary"), None)


def geometry_columns(columns: DataFrame, by: list[str]) -> DataFrame:
    """The geometry column of every table (columns ``by``) of many, described by rows (name, dtype); null where it has none."""
    place = F.when(F.col("dtype") == "binary", F.array_position(F.array(*[F.lit(n) for n in GEOMETRY_NAMES]), F.col("name")))
    return columns.groupBy(*by).agg(F.min_by("name", F.when(place > 0, place)).alias("found"))


_COLUMNS = "select p_brand, p_size, case p_partkey % 6 when 0 then 'geom' when 1 then 'geometry' when 2 then 'Geometry' else p_name end as name, case p_retailprice % 3 when 0 then 'binary' when 1 then 'string' else 'binary' end as dtype from {part}"


@register("find_geometry_column", "select p_brand, p_size, case when bool_or(name = 'geometry' and dtype = 'binary') then 'geometry' when bool_or(name = 'geom' and dtype = 'binary') then 'geom' end as found from (" + _COLUMNS.format(part="part") + ") c group by p_brand, p_size")
def find_geometry_column_q(spark: SparkSession, sf: str) -> DataFrame:
    return geometry_columns(spark.sql(_COLUMNS, part=view(spark, sf, "part")), ["p_brand", "p_size"])


def drop_derived(df: DataFrame) -> DataFrame:
    """Without the columns this engine derives (geohash_*, bbox_*)."""
    return df.select([c for c in df.columns if not c.startswith(("geohash_", "bbox_"))])


@register("drop_derived", sql("items", "select l_orderkey, ln, collection from items"))
def drop_derived_q(spark: SparkSession, sf: str) -> DataFrame:
    return drop_derived(view(spark, sf, "items").select("l_orderkey", "ln", "collection", F.col("xmin").alias("bbox_xmin"), F.lit("s").alias("geohash_4")))


def concat_promote(*dfs: DataFrame) -> DataFrame:
    """Tables stacked by name; columns that a table lacks are null."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


@register("concat_promote", "select c_custkey as id, c_name as name, c_acctbal as balance, cast(null as varchar) as segment, c_nationkey as nation from customer where c_custkey % 2 = 0 union all select s_suppkey, s_name, s_acctbal, 'S', cast(null as integer) from supplier")
def concat_promote_q(spark: SparkSession, sf: str) -> DataFrame:
    c = view(spark, sf, "customer").where("c_custkey % 2 = 0").selectExpr("c_custkey as id", "c_name as name", "c_acctbal as balance", "c_nationkey as nation")
    return concat_promote(c, view(spark, sf, "supplier").selectExpr("s_suppkey as id", "s_name as name", "s_acctbal as balance", "'S' as segment"))


def collection_summaries(rows: DataFrame, by: list[str], fields: list[str], ranges: list[str]) -> DataFrame:
    """Per field: the sorted distinct values, or (in ``ranges``) min and max; ``ns:field`` names are lists by nature."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").cast("string").alias("v"), F.col(f"`{f}`").cast("double").alias("x") if f in ranges else F.lit(None).cast("double").alias("x")) for f in fields])
    e = rows.select(*by, F.explode(pairs).alias("p")).select(*by, "p.*").where("v is not null")
    return e.groupBy(*by, "field").agg(F.array_join(F.sort_array(F.collect_set(F.when(~F.col("field").isin(*ranges), F.col("v")))), ",").alias("vals"), F.min("x").alias("low"), F.max("x").alias("high"))


@register("collection_summaries", sql("schemas", "select table_name, 'dtype' as field, string_agg(distinct dtype, ',' order by dtype) as vals, cast(null as double) as low, cast(null as double) as high from schemas group by table_name union all select table_name, 'crs', string_agg(distinct crs, ',' order by crs), null, null from schemas group by table_name union all select table_name, 'version', '', cast(min(version) as double), cast(max(version) as double) from schemas group by table_name"))
def collection_summaries_q(spark: SparkSession, sf: str) -> DataFrame:
    return collection_summaries(_schemas(spark, sf), ["table_name"], ["dtype", "crs", "version"], ["version"])


def extensions_used(prefixes: Column) -> Column:
    """Extension names that the property prefixes (an array of keys) need, sorted."""
    spaces = F.transform(prefixes, lambda k: F.regexp_extract(k, "^([a-z]+):", 1))
    return F.array_compact(F.array(*[F.when(F.array_contains(spaces, n), n) for n in ("eo", "proj", "raster", "table", "vector")]))


@register("extensions_used", sql("schemas", "select table_name, version, element, concat_ws(',', case when nullable then 'proj' end, case when nodata is not null then 'raster' end, 'table') as extensions from schemas"))
def extensions_used_q(spark: SparkSession, sf: str) -> DataFrame:
    keys = F.array_compact(F.array(F.when(F.col("nullable"), "proj:epsg"), F.when(F.col("nodata").isNotNull(), "raster:bands"), F.lit("table:columns"), F.lit("title")))
    return _schemas(spark, sf).select("table_name", "version", "element", F.array_join(extensions_used(keys), ",").alias("extensions"))


def raster_bands(images: DataFrame, key: list[str]) -> DataFrame:
    """A row per band: name band_i, data_type, nodata; mean resolution. ``images``: key, band_count, data_type, nodata, px, py."""
    return images.select(*key, F.explode(F.sequence(F.lit(1), F.col("band_count").cast("int"))).alias("i"), "data_type", "nodata", "px", "py").select(
        *key, F.concat(F.lit("band_"), F.col("i").cast("string")).alias("band"), "data_type", "nodata", ((F.abs("px") + F.abs("py")) / 2).alias("resolution"))


@register("raster_bands", "select p_partkey, 'band_' || cast(i as varchar) as band, case when p_size % 2 = 0 then 'uint8' else 'float32' end as data_type, cast(p_size as double) as nodata, round((p_size * 0.1e0 + p_retailprice) / 2, 6) as resolution from (select *, unnest(range(1, p_size % 4 + 2)) as i from part) p")
def raster_bands_q(spark: SparkSession, sf: str) -> DataFrame:
    im = view(spark, sf, "part").selectExpr("p_partkey", "p_size % 4 + 1 as band_count", "case when p_size % 2 = 0 then 'uint8' else 'float32' end as data_type", "cast(p_size as double) as nodata", "p_size * 0.1D as px", "-p_retailprice as py")
    return raster_bands(im, ["p_partkey"]).withColumn("resolution", F.round("resolution", 6))


def nodata_default(bands: DataFrame, default: float | list[float], strict: bool = False) -> DataFrame:
    """Missing nodata from one default, or by band number from a list; a short list repeats its last value, or raises when strict."""
    if isinstance(default, list):
        lst = F.array(*[F.lit(float(x)) for x in default])
        over = F.col("i") > len(default)
        value = F.element_at(lst, F.least(F.col("i"), F.lit(len(default))).cast("int"))
        value = F.when(over, F.raise_error(F.lit("more bands than nodata values"))).otherwise(value) if strict else value
    else:
        value = F.lit(float(default))
    return bands.withColumn("nodata", F.coalesce("nodata", value))


@register("nodata_default", sql("schemas", "select table_name, version, element, coalesce(nodata, case version when 0 then 7.0e0 else 9.0e0 end) as nodata from schemas"))
def nodata_default_q(spark: SparkSession, sf: str) -> DataFrame:
    return nodata_default(_schemas(spark, sf).withColumn("i", F.col("version") + 1), [7.0, 9.0]).select("table_name", "version", "element", "nodata")


def temporal_default(items: DataFrame) -> DataFrame:
    """Item datetime: its own, else January 1 of ``year``, else ``start``; null leaves the provisional flag."""
    dt = F.coalesce("datetime", F.make_timestamp_ntz(F.col("year").cast("int"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)), F.col("start"))
    return items.withColumn("datetime", dt).withColumn("provisional", F.col("datetime").isNull())


@register("temporal_default", "select o_orderkey, case when o_orderkey % 4 = 0 then o_orderdate when o_orderkey % 4 = 1 then make_timestamp(2000 + o_orderkey % 20, 1, 1, 0, 0, 0) when o_orderkey % 4 = 2 then o_orderdate + interval 1 day end as datetime, o_orderkey % 4 = 3 as provisional from orders")
def temporal_default_q(spark: SparkSession, sf: str) -> DataFrame:
    o = view(spark, sf, "orders").selectExpr("o_orderkey", "case when o_orderkey % 4 = 0 then o_orderdate end as datetime", "case when o_orderkey % 4 = 1 then 2000 + o_orderkey % 20 end as year", "case when o_orderkey % 4 <= 2 then o_orderdate + interval 1 day end as start")
    return temporal_default(o).select("o_orderkey", "datetime", "provisional")


def classify_by_match(value: Column, cases: dict[str, str], default: str) -> Column:
    """Class of a value, compared as text, by a match expression with default."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in cases.items() for x in kv]), value.cast("string")), F.lit(default))


@register("classify_by_match", "select p_partkey, case p_type when 'ECONOMY' then '#ff0000' when 'SMALL' then '#00ff00' else '#cccccc' end as colour from part")
def classify_by_match_q(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "part").select("p_partkey", classify_by_match(F.col("p_type"), {"ECONOMY": "#ff0000", "SMALL": "#00ff00"}, "#cccccc").alias("colour"))
