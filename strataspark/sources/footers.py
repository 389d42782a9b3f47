"""What Parquet footers can answer: statistics of columns, places of row groups, spread samples that read few row groups.

Footers are read by seeking, spread over tasks by file; data pages only where a footer has no statistics, or where rows are asked
for. Paths are URIs that Arrow's file systems open.
"""

from __future__ import annotations

import decimal
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataspark.session import scratch, ship

NESTED = ("array", "map", "struct", "binary", "variant")
CHUNKS = "path string, row_group long, column string, min string, max string, null_count long, rows long, type string, geo string"


def _schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64()}
    return pa.schema([(n, kinds[t]) for n, t in (c.split(" ") for c in ddl.split(", "))])


def _open(path: str, content: bytes | None = None):
    from pyarrow import fs

    if content is not None:
        return io.BytesIO(content)
    store, name = fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


def listing(spark: SparkSession, path: str) -> DataFrame:
    """The Parquet files under a path, one a row; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path).select("path")


def scan_parquet_footers(files: DataFrame) -> DataFrame:
    """A row per (path, row group, column): min, max, null_count, rows, type, and the file's ``geo`` metadata.

    ``files`` has a path a row, and is spread over tasks by its own partitioning; only footers are read. For stores that Spark
    alone reads, ``files`` has ``content`` too, as the binaryFile source gives it. Values are text; a chunk without statistics, or
    with some that the reader cannot type, has no min and max.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        schema = _schema(CHUNKS)
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with _open(path, content) as f:
                    meta = pq.read_metadata(f)
                geo = (meta.metadata or {}).get(b"geo")
                rows = []
                for g in range(meta.num_row_groups):
                    group = meta.row_group(g)
                    for c in range(group.num_columns):
                        col = group.column(c)
                        s = col.statistics
                        known = s is not None and s.has_min_max and not (s.logical_type.type == "DECIMAL" and not isinstance(s.min, decimal.Decimal))
                        rows.append((path, g, col.path_in_schema, str(s.min) if known else None, str(s.max) if known else None, s.null_count if s is not None and s.has_null_count else None, group.num_rows, col.physical_type, geo.decode() if geo else None))
                yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows) if rows else [()] * len(schema), schema.types)], schema=schema)

    content = F.col("content") if "content" in files.columns else F.lit(None).cast("binary").alias("content")
    return files.select("path", content).mapInArrow(run, CHUNKS)


def scan_column_chunks(chunks: DataFrame) -> DataFrame:
    """The same rows for chunks (path, row_group, column), from their data: just those chunks are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        schema = _schema(CHUNKS)
        for b in batches:
            for path, g, name in zip(*(c.to_pylist() for c in b.columns[:3])):
                with _open(path) as f:
                    file = pq.ParquetFile(f)
                    col = file.read_row_group(g, columns=[name]).column(0)
                    values = col.filter(pc.invert(pc.is_nan(col))) if pa.types.is_floating(col.type) else col
                    both = pc.min_max(values).as_py()
                    text = [None if v is None else str(v) for v in (both["min"], both["max"])]
                    row = (path, g, name, *text, col.null_count, len(col), None, None)
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, schema.types)], schema=schema)

    return chunks.select("path", "row_group", "column").mapInArrow(run, CHUNKS)


def column_statistics(spark: SparkSession, path: str) -> DataFrame:
    """(column, min, max as text, null_count) of the flat columns of a Parquet table, from its footers.

    Row groups' statistics are merged in the columns' own types; chunks without statistics are read, and nothing else. NaN is no
    minimum or maximum; columns of nulls alone, partition keys and nested columns have no row.
    """
    ship(spark)
    flat = [(f.name, f.dataType.simpleString()) for f in spark.read.parquet(path).schema if not f.dataType.simpleString().startswith(NESTED)]
    at = scratch(spark, "footers")
    scan_parquet_footers(listing(spark, path)).where(F.col("column").isin(*[n for n, _ in flat])).drop("geo").write.parquet(at)
    found = spark.read.parquet(at)
    lacking = F.col("min").isNull() & (F.col("null_count").isNull() | (F.col("null_count") < F.col("rows")))
    read = scan_column_chunks(found.where(lacking).repartition("path", "row_group", "column"))
    columns = ("column", "min", "max", "null_count")
    every = found.where(~lacking).select(*columns).union(read.select(*columns))

    def typed(c: str, kind: str) -> F.Column:
        v = F.col(c).cast(kind)
        return F.when(v == 0, F.lit(0).cast(kind)).when(~F.isnan(v), v) if kind in ("float", "double") else v  # footers may have -0 for 0

    of = lambda i, c: F.when(F.col("column") == flat[i][0], c)
    aggs = [x for i, (_, kind) in enumerate(flat) for x in (F.min(of(i, typed("min", kind))).cast("string").alias(f"min{i}"), F.max(of(i, typed("max", kind))).cast("string").alias(f"max{i}"), F.sum(of(i, F.col("null_count"))).alias(f"null{i}"))]
    rows = F.array(*[F.struct(F.lit(n).alias("column"), F.col(f"min{i}").alias("min"), F.col(f"max{i}").alias("max"), F.col(f"null{i}").alias("null_count")) for i, (n, _) in enumerate(flat)])
    return every.agg(*aggs).select(F.explode(rows).alias("r")).select("r.*").where("min is not null")


def scan_row_groups(files: DataFrame) -> DataFrame:
    """A row per row group (path, row_group, rows), from footers."""
    kind = "path string, row_group long, rows long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        for b in batches:
            for path in b.column(0).to_pylist():
                with _open(path) as f:
                    meta = pq.read_metadata(f)
                rows = [meta.row_group(g).num_rows for g in range(meta.num_row_groups)]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), pa.array(range(len(rows)), pa.int64()), pa.array(rows, pa.int64())], schema=_schema(kind))

    return files.select("path").mapInArrow(run, kind)


def evenly(i: str, n: int, k: int) -> F.Column:
    """Is i (below n) one of the k places j * (n - 1) div (k - 1): spread evenly, both ends in. In integers."""
    if k >= n:
        return F.lit(True)
    if k == 1:
        return F.col(i) == 0
    return F.expr(f"(({i} * {k - 1}L + {n - 2}L) div {n - 1}L) * {n - 1}L div {k - 1}L = {i}")


def sample_row_groups(spark: SparkSession, path: str, k: int, columns: list[str] | None = None) -> DataFrame:
    """Exactly k rows (all, if there are fewer) of a Parquet table in file order, from few row groups spread evenly over it, the
    first and the last among them; the rows are spread evenly over those, both ends in.

    About k / rows of the row groups are read, by seeking, just the named columns; places come from footers, without a sort.
    A table of one row group is read whole. The windows here run over files, and over at most k chosen row groups.
    """
    ship(spark)
    table = spark.read.parquet(path).select(*columns or ["*"])
    at = scratch(spark, "row_groups")
    scan_row_groups(listing(spark, path)).where("rows > 0").write.parquet(at)
    groups = spark.read.parquet(at)
    n, total = groups.agg(F.count("*"), F.coalesce(F.sum("rows"), F.lit(0))).first()
    if total <= k or k < 1:
        return table if k >= 1 else table.limit(0)
    files = groups.groupBy("path").agg(F.count("*").alias("own"))
    before = files.select("path", F.coalesce(F.sum("own").over(W.orderBy("path").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rank = F.row_number().over(W.partitionBy("path").orderBy("row_group"))
    groups = groups.withColumn("_r", rank).join(before, "path").withColumn("place", F.col("before") + F.col("_r") - 1)
    few = min(n, max(2, -(-n * k // total)))
    while True:
        chosen = groups.where(evenly("place", n, few))
        held = chosen.agg(F.sum("rows")).first()[0]
        if held >= k or few == n:
            break
        few = min(n, max(few + 1, -(-few * k // held)))
    start = F.coalesce(F.sum("rows").over(W.orderBy("place").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    chosen = chosen.select("path", "row_group", "rows", start.alias("start")).repartition("path", "row_group")

    from pyspark.sql.pandas.types import to_arrow_schema

    schema, names = to_arrow_schema(table.schema), table.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        for b in batches:
            for path, g, rows, start in zip(*(c.to_pylist() for c in b.columns)):
                j = np.arange(-(-start * (k - 1) // (held - 1)), (start + rows - 1) * (k - 1) // (held - 1) + 2) if k > 1 else np.array([0])
                places = j * (held - 1) // max(1, k - 1)
                places = places[(places >= start) & (places < start + rows) & (j < k)] - start
                if len(places):
                    with _open(path) as f:
                        got = pq.ParquetFile(f).read_row_group(g, columns=names).select(names).take(pa.array(places))
                    yield from got.cast(schema, safe=False).to_batches()

    return chosen.mapInArrow(run, table.schema)
