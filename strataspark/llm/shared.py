"""What the corpus operators share: tables in the cluster's shared folder, row packing, union-find on links."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspark.session import shared_dir, ship


COLLECT = 2.0  # seconds between calls of the driver's collector
_collected = 0.0


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors.

    The driver's collector is asked to run now and then, since Spark frees finished steps' shuffle files only when it does.
    """
    global _collected
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/strataspark-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    if time.monotonic() - _collected > COLLECT:
        spark.sparkContext._jvm.System.gc()
        _collected = time.monotonic()
    out = spark.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def stable(docs: DataFrame) -> DataFrame:
    """``docs`` such that monotonically_increasing_id gives a row the same number in every job: a plain scan of files does,
    anything else is written first. Scans are split by the number of cores alive unless a number is set, so the present one
    is set for the session: an executor that is lost or joins between jobs must not move rows between splits."""
    spark = docs.sparkSession
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark._jsparkSession.leafNodeDefaultParallelism()))
    plan = docs._jdf.queryExecution().optimizedPlan().toString()
    kinds = {line.lstrip(" :+-*").split(" ")[0].split("[")[0] for line in plan.splitlines() if line.strip()}
    return docs if kinds <= {"Project", "Filter", "Relation"} else table(docs, "rows")


def drop(df: DataFrame) -> None:
    """Delete a table written by ``table`` that no later step reads."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.shared_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def matching(docs: DataFrame, ids: DataFrame, *keys: str) -> DataFrame:
    """Rows of ``docs`` whose ``keys`` are in ``ids`` (one row a key), for reading the texts of a few documents.

    The ids are written first, with a column to filter on: that is what Spark's runtime Bloom filter asks of a join's small
    side (it also checks its size), so that texts nobody asks for are dropped before the shuffle. It works for keys that are
    columns of the file.
    """
    docs.sparkSession.conf.set("spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", "1MB")
    few = table(ids.select(*keys).withColumn("n", F.lit(1)), "ids")
    return docs.join(few.where("n > 0").select(*keys), list(keys))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``links`` (a, b: long): one row (node, root) per linked node, root the smallest node.

    Alternating large-star and small-star steps: each step is a min per node (pre-aggregated, then written) and an
    equi-join of two plain scans, so that a node with very many links is never gathered and its share of the join can be
    split; the edge table is written to the shared folder after each step. Nulls and self-links are ignored; repeated links do no harm; no links give no rows.
    """

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(
            F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = table(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "low")
        near = both.join(low, "a")
        out = near.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if large else near.select(
            F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        out = table(out.where("a <> b").distinct(), "links")
        drop(low)
        drop(edges)
        return out

    edges = table(links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").distinct(), "links")
    for _ in range(rounds):
        edges = star(star(edges, True), False)
        # Done when every edge points from a node to a root: no node has two targets, no target has one.
        ends = edges.select("a", F.lit(1).alias("out"), F.lit(0).alias("in")).union(edges.select("b", F.lit(0), F.lit(1)))
        open_ends = ends.groupBy("a").agg(F.sum("out").alias("out"), F.max("in").alias("in")).where("out > 1 or (out > 0 and in > 0)")
        if open_ends.isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
