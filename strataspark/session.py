"""Session settings, and the way Python workers find this package."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from the driver's own source folder.

    Enough where executors see that folder (local mode, a shared home); elsewhere submit the package with --py-files.
    """
    here = str(Path(__file__).resolve().parent.parent)
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if here not in paths:
        env["PYTHONPATH"] = ":".join([*paths, here])
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def session(app: str = "strataspark", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow; on a cluster leave master and partitions to the submitter."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        b = b.master(master)
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    spark = b.getOrCreate()
    ship(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where it is unset, in local mode, a temporary one; a cluster
    must name it."""
    import tempfile

    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="strataspark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    import uuid

    return f"{shared_dir(spark)}/strataspark-{uuid.uuid4().hex}/{name}"
