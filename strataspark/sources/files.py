"""Sources and sinks: Hive-partitioned Parquet, GeoJSON, delimited text, catalog items, version manifests, listings, footers,
versioned tables, exports."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from strataspark.functions.text import parse_nodata
from strataspark.operators.schemas import drop_derived
from strataspark.operators.versions import merge_assets
from strataspark.sources.footers import scan_parquet_footers  # noqa: F401


def scan_hive_table(spark: SparkSession, root: str) -> DataFrame:
    """A Hive-partitioned Parquet data set of any keys and depth; filters on the keys prune at the scan."""
    return spark.read.option("basePath", root).option("recursiveFileLookup", "false").parquet(root)


MOST_NAMES = 10_000  # property names that are found without being given


def scan_geojson(spark: SparkSession, path: str, properties: list[str] | None = None) -> DataFrame:
    """A row per feature: properties as columns, geometry_type, and geometry as JSON text. A file that is not JSON gives one row
    with ``corrupt``; collections without features give none. ``properties`` names the columns; without it they are found in a
    first pass, which refuses more than MOST_NAMES of them."""
    raw = spark.read.option("wholetext", True).text(path).withColumn("file", F.input_file_name())
    ok = F.get_json_object("value", "$.type").isNotNull()
    feats = F.filter(F.from_json(F.get_json_object("value", "$.features"), "array<string>"), lambda f: f.isNotNull())
    # Whether a file is JSON is told by the rows themselves: a column beside the explode would parse the whole file for every feature.
    none = F.array(F.lit(None).cast("string"))
    rows = raw.select("file", F.explode(F.when(ok, feats).otherwise(none)).alias("f")).select("file", F.col("f").isNull().alias("corrupt"), "f")
    props = F.get_json_object("f", "$.properties")
    keys = properties
    if keys is None:
        keys = [r[0] for r in rows.select(F.explode(F.json_object_keys(props)).alias("k")).distinct().orderBy("k").limit(MOST_NAMES + 1).collect()]
        if len(keys) > MOST_NAMES:
            raise ValueError(f"more than {MOST_NAMES} distinct property names: give the names")
    m = F.from_json(props, "map<string,string>")
    geo = F.get_json_object("f", "$.geometry")
    return rows.select("file", "corrupt", F.get_json_object(geo, "$.type").alias("geometry_type"), geo.alias("geometry"), *[F.try_element_at(m, F.lit(k)).alias(k if k not in ("file", "corrupt", "geometry", "geometry_type") else f"properties.{k}") for k in keys])


def scan_tabular(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """CSV or TSV with a header and inferred types."""
    return spark.read.csv(path, header=True, inferSchema=True, sep=sep)


ITEM = "id string, type string, bbox array<double>, collection string, properties map<string, string>, geometry string, assets map<string, struct<href: string, type: string, title: string, roles: array<string>>>, links array<struct<rel: string, href: string>>"


def scan_stac_items(spark: SparkSession, root: str) -> DataFrame:
    """Every item under a root, with ``datetime`` and its file: documents of one item, and item collections. Others are left out."""
    df = spark.read.schema(f"{ITEM}, features array<struct<{ITEM}>>").option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(root)
    names = [c for c in df.columns if c != "features"]
    own = F.when(F.col("type") == "Feature", F.array(F.struct(*names))).when(F.col("type") == "FeatureCollection", F.col("features"))
    df = df.select(F.input_file_name().alias("file"), F.explode(own).alias("item")).select("item.*", "file")
    return df.where("type = 'Feature'").withColumn("datetime", F.try_to_timestamp(F.col("properties")["datetime"]))


MANIFEST = "spec_version string, current_version string, versions array<struct<version: string, created: timestamp, breaking: boolean, message: string, changes: array<string>, schema: struct<type: string, fingerprint: string>, assets: map<string, struct<sha256: string, size_bytes: bigint, href: string, source_path: string, source_mtime: double, mtime: double, feature_count: bigint, schema_fingerprint: string>>>>, _corrupt_record string"


def scan_versions(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(versions, assets, errors) of the manifests under a root; a manifest that is no JSON or lacks a field is an error row."""
    raw = spark.read.schema(MANIFEST).option("multiLine", True).option("mode", "PERMISSIVE").option("recursiveFileLookup", True).json(root).withColumn("file", F.input_file_name())
    problem = F.when(F.col("_corrupt_record").isNotNull(), "not JSON").when(F.col("versions").isNull(), "versions missing").when(F.col("current_version").isNull(), "current_version missing")
    marked = raw.withColumn("problem", problem)
    good = marked.where("problem is null").select("file", "current_version", F.posexplode("versions").alias("ord", "v"))
    versions = good.select("file", (F.col("ord") + 1).cast("long").alias("ord"), "v.version", "v.created", F.coalesce("v.breaking", F.lit(False)).alias("breaking"), "v.message", "v.changes", (F.col("v.version") == F.col("current_version")).alias("current"))
    assets = good.select("file", (F.col("ord") + 1).cast("long").alias("ord"), "v.version", F.explode("v.assets").alias("asset", "a")).select("file", "ord", "version", "asset", "a.*")
    return versions, assets, marked.where("problem is not null").select("file", "problem")


def scan_files(spark: SparkSession, root: str, max_depth: int | None = None, hidden: bool = False) -> DataFrame:
    """path, size_bytes, mtime, depth, ext of the files under a root. Contents are not read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime"))
    rel = F.regexp_replace("path", r"^.*?" + root.rstrip("/").split("/")[-1].replace(".", r"\.") + "/", "")
    df = df.withColumn("rel", rel).withColumn("depth", F.size(F.split("rel", "/"))).withColumn("ext", F.lower(F.regexp_extract("rel", r"\.([A-Za-z0-9]+)$", 1)))
    df = df.where(F.col("depth") <= max_depth) if max_depth else df
    return df if hidden else df.where(~F.col("rel").rlike(r"(^|/)\."))


def sink_hive_partitioned(df: DataFrame, root: str, cell: str, sort: list[str] | None = None) -> None:
    """Write with the cell as partition key, sorted within; Spark's commit protocol leaves nothing behind a failed job. Small
    cells share a task and a hot one is split over several (a rebalance), so it gets more than one file."""
    keyed = df.hint("rebalance", cell)
    (keyed.sortWithinPartitions(cell, *sort) if sort else keyed).write.mode("errorifexists").partitionBy(cell).parquet(root)


def sink_items_mirror(items: DataFrame, targets: DataFrame, path: str) -> None:
    """All items as one index, in box order; raises where an item's href has no target."""
    stale = items.join(targets.select("href"), "href", "left_anti").limit(5).collect()
    if stale:
        raise ValueError("stale links: " + ", ".join(r["href"] for r in stale))
    items.repartitionByRange("xmin", "ymin").sortWithinPartitions("xmin", "ymin", "xmax", "ymax").write.mode("overwrite").parquet(path)


def publish(spark: SparkSession, root: str, collection: str, df: DataFrame, assets: DataFrame, version: str, breaking: bool = False, message: str = "", removed: list[str] | None = None, replace_asset: bool = False, attempts: int = 20) -> int:
    """Append a batch to a versioned table; returns the version's number. Data first, in a folder of its own, the log entry last, so
    readers see complete versions only.

    The log entry of a version holds its assets, its schema and its folder. It is made beside the log and renamed into place, which
    fails where another writer has taken the number: then the batch is rebased on that writer's state and tried again, without
    writing the data anew. A version that the log has is left as it is, so a stream may repeat its last batch; one that another
    writer publishes meanwhile raises. ``df`` has an ``asset`` column; ``assets`` is (asset, sha256, size_bytes) of the batch. Rows
    are appended; with ``replace_asset`` readers take only each asset's newest rows.
    """
    base = f"{root.rstrip('/')}/{collection}"
    folder, written = f"data/version={version}/batch={uuid.uuid4().hex}", False
    for _ in range(attempts):
        old = read_log(spark, root, collection)
        found = None if old is None else old.where(F.col("version") == version).select("ord").first()
        if found is not None:
            if written:
                raise ValueError(f"version {version} was published by another writer")
            return found["ord"]
        if not written:
            df.write.parquet(f"{base}/{folder}")
            written = True
        state, n = assets.select("asset", "sha256", "size_bytes").withColumn("version", F.lit(version)), 1
        if old is not None:
            last = old.agg(F.max("ord")).first()[0]
            before = old.where(F.col("ord") == last).select("asset", "sha256", "size_bytes", F.col("asset_version").alias("version"))
            gone = spark.createDataFrame([(a,) for a in removed or []], "asset string")
            state, n = merge_assets(before, state, gone, ["asset"]), last + 1
        log = state.withColumnRenamed("version", "asset_version").withColumns({"ord": F.lit(n).cast("long"), "breaking": F.lit(breaking), "message": F.lit(message), "replace_asset": F.lit(replace_asset), "version": F.lit(version), "folder": F.lit(folder), "schema": F.lit(df.schema.json())})
        if _commit(spark, log, base, n):
            return n
    raise RuntimeError(f"version {version} lost {attempts} times to other writers")


def _commit(spark: SparkSession, log: DataFrame, base: str, n: int) -> bool:
    """Write the log entry beside the log, then rename it to its number unless that is taken; was it free."""
    fs = spark._jvm.org.apache.hadoop.fs
    staged, place = fs.Path(f"{base}/_staging/{uuid.uuid4().hex}"), fs.Path(f"{base}/_log/ord={n}")
    log.coalesce(1).write.parquet(staged.toString())
    kind = getattr(fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.NONE
    conf = spark._jsc.hadoopConfiguration()
    place.getFileSystem(conf).mkdirs(place.getParent())
    context = fs.FileContext.getFileContext(place.getFileSystem(conf).getUri(), conf)
    try:
        context.rename(staged, place, how)
        return True
    except Py4JJavaError as e:
        if "exist" not in str(e.java_exception).lower() and "not empty" not in str(e.java_exception).lower():
            raise
        place.getFileSystem(conf).delete(staged, True)
        return False


def read_log(spark: SparkSession, root: str, collection: str) -> DataFrame | None:
    """The version log, a row per (version, asset); none before the first version."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{collection}/_log")
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(path) or not len(store.listStatus(path)):
        return None
    return spark.read.parquet(f"{path.toString()}/ord=*")


#: Types that a column of a later version may widen, narrowest first.
WIDER = (("byte", "short", "integer", "long"), ("float", "double"))


def united_schema(schemas: list[StructType]) -> StructType:
    """The columns of all schemas by name, in the order of their first appearance, as wide as the widest; other types must agree."""
    out: dict[str, StructField] = {}
    for f in (f for s in schemas for f in s.fields):
        known = out.get(f.name)
        if known is None or known.dataType == f.dataType:
            out[f.name] = StructField(f.name, f.dataType, True)
            continue
        line = next((w for w in WIDER if {known.dataType.typeName(), f.dataType.typeName()} <= set(w)), None)
        if line is None:
            raise ValueError(f"column {f.name} is {known.dataType.simpleString()} in one version and {f.dataType.simpleString()} in another")
        if line.index(f.dataType.typeName()) > line.index(known.dataType.typeName()):
            out[f.name] = StructField(f.name, f.dataType, True)
    return StructType(list(out.values()))


def read_version(spark: SparkSession, root: str, collection: str, ord: int | None = None) -> DataFrame:
    """The table at a version (default: the newest): rows of the assets that its log holds, columns united over the versions read.

    The log names the folders and schemas of the versions whose rows are live; only those are listed and read, and no footer is
    opened to find a column. What is collected is a row a live version.
    """
    log = read_log(spark, root, collection)
    if log is None:
        raise ValueError(f"{collection} has no version")
    n = ord or log.agg(F.max("ord")).first()[0]
    now = log.where(F.col("ord") == n).select("asset", F.col("asset_version").alias("newest"), F.col("replace_asset").alias("replaced"))
    if not log.where(F.col("ord") == n).limit(1).count():
        raise ValueError(f"{collection} has no version {n}")
    # A version's batch held the assets that its own entry dates to it.
    live = log.where((F.col("ord") <= n) & (F.col("asset_version") == F.col("version"))).join(now, "asset").where("not replaced or version = newest")
    live = live.groupBy("ord", "folder").agg(F.first("schema").alias("schema")).orderBy("ord").collect()
    schema = united_schema([StructType.fromJson(json.loads(r["schema"])) for r in live])
    base = f"{root.rstrip('/')}/{collection}"
    if not live:
        return spark.createDataFrame([], schema.add("version", "string"))
    data = spark.read.schema(schema.add("version", "string").add("batch", "string")).option("basePath", f"{base}/data").parquet(*[f"{base}/{r['folder']}" for r in live])
    return data.join(now, "asset").where("not replaced or version = newest").drop("newest", "replaced", "batch")


def export_snapshot(df: DataFrame, path: str) -> None:
    """The current snapshot as one data set without derived columns; an empty table still writes its schema."""
    drop_derived(df).write.mode("overwrite").parquet(path)


def export_schema(schema: DataFrame, path: str, fmt: str = "csv") -> None:
    """A schema (as rows) as an editable table."""
    w = schema.coalesce(1).write.mode("overwrite")
    w.option("header", True).csv(path) if fmt == "csv" else w.format(fmt).save(path)


SCHEMA_COLUMNS = ("name", "dtype", "nullable", "nodata", "description")


def import_schema(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """The edited table, typed; a missing required column raises; nodata is a number or null."""
    raw = spark.read.option("header", True).csv(path) if fmt == "csv" else spark.read.format(fmt).load(path)
    missing = [c for c in ("name", "dtype") if c not in raw.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    text = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) if c in raw.columns else F.lit(None).cast("string")
    nodata = parse_nodata(text("nodata"))
    return raw.select(text("name").alias("name"), text("dtype").alias("dtype"), F.coalesce(text("nullable").try_cast("boolean"), F.lit(True)).alias("nullable"), F.coalesce(nodata["integer"].cast("double"), nodata["real"]).alias("nodata"), text("description").alias("description"))


def split_layers(df: DataFrame, layer: str, root: str) -> DataFrame:
    """One output per layer, and a status row per layer."""
    df.hint("rebalance", layer).write.mode("overwrite").partitionBy(layer).parquet(root)
    return df.groupBy(layer).agg(F.count("*").alias("rows")).withColumn("status", F.lit("success"))


def partition_metadata(files: DataFrame) -> DataFrame:
    """Per root: partition keys in level order, files, and the kind of partitioning that the key names show."""
    keys = F.regexp_extract_all("path", F.lit("([^/=]+)="), F.lit(1))
    f = files.select(F.regexp_extract("path", r"^(.*?)/?[^/=]+=", 1).alias("root"), F.array_join(keys, ",").alias("keys")).where("keys <> ''")
    kind = F.when(F.col("keys").rlike("geohash|quadkey|kdtree|h3|s2"), "spatial").when(F.col("keys").rlike("year|month|day|date"), "temporal").otherwise("attribute")
    return f.groupBy("root", "keys").agg(F.count("*").alias("files")).withColumn("strategy", kind)


