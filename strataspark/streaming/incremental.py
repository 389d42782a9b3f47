"""Incremental work as structured streams: ingest of new files, running extents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspark.plans.views import sql, view
from strataspark.registry import register
from strataspark.session import scratch
from strataspark.sources import files


def incremental_ingest(spark: SparkSession, source: str, schema: str, checkpoint: str, publish: Callable[[DataFrame, int], None], files_per_batch: int = 1000) -> None:
    """Every new Parquet file under ``source`` goes into exactly one micro-batch, and each batch to ``publish(df, batch_id)``.

    The batch id is the version's key: a batch that is retried after a failure has the same id and files, so a publish that
    takes a version once (as ``sources.files.publish`` does) is exactly once. Returns when all files now there are done; run again for later ones.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    stream.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def incremental_extent(items: DataFrame, by: list[str]) -> DataFrame:
    """Running box and item count per group; four numbers of state a group, so no watermark is needed. Final state equals the batch union."""
    return items.groupBy(*by).agg(F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"), F.count("*").alias("items"))


def _stage(spark: SparkSession, sf: str) -> tuple[str, str]:
    path = scratch(spark, "arrivals")
    it = view(spark, sf, "items").select("collection", F.col("lon").alias("xmin"), F.col("lat").alias("ymin"), F.col("lon").alias("xmax"), F.col("lat").alias("ymax"))
    it.repartition(6, "ymin").write.parquet(path)
    return path, it.schema.simpleString()[7:-1].replace(":", " ")


@register("incremental_ingest", sql("items", "select collection, cast(count(*) as bigint) as n from items group by collection"))
def incremental_ingest_q(spark: SparkSession, sf: str) -> DataFrame:
    source, schema = _stage(spark, sf)
    target = scratch(spark, "ingested")

    def put(df: DataFrame, n: int) -> None:
        rows = df.withColumn("asset", F.col("collection").cast("string"))
        assets = rows.groupBy("asset").agg(F.sha2(F.concat_ws(",", F.count("*").cast("string"), F.lit(n)), 256).alias("sha256"), F.count("*").alias("size_bytes"))
        files.publish(df.sparkSession, target, "items", rows, assets, f"1.{n}.0")

    incremental_ingest(spark, source, schema, scratch(spark, "checkpoint"), put, files_per_batch=2)
    return files.read_version(spark, target, "items").groupBy("collection").agg(F.count("*").alias("n"))


@register("incremental_extent", sql("items", "select collection, round(min(lon), 6) as xmin, round(min(lat), 6) as ymin, round(max(lon), 6) as xmax, round(max(lat), 6) as ymax, cast(count(*) as bigint) as items from items group by collection"))
def incremental_extent_q(spark: SparkSession, sf: str) -> DataFrame:
    source, schema = _stage(spark, sf)
    target = scratch(spark, "extents")

    def put(df: DataFrame, n: int) -> None:
        df.write.mode("overwrite").parquet(f"{target}/batch={n}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(source)
    incremental_extent(stream, ["collection"]).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", scratch(spark, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(target).groupBy("collection").agg(F.max_by(F.struct("xmin", "ymin", "xmax", "ymax", "items"), "batch").alias("s"))
    return last.select("collection", *[F.round(F.col("s")[c], 6).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")], F.col("s.items").alias("items"))
