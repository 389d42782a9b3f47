"""Footers: statistics without data pages, samples from few row groups."""

import datetime
import decimal
import math

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from strataspark.operators import layout
from strataspark.sources import footers


def spoil(path, keep=lambda group, column: False):
    """Overwrite the data pages of all chunks that are not kept, so that reading them fails."""
    meta = pq.read_metadata(path)
    raw = bytearray(path.read_bytes())
    for g in range(meta.num_row_groups):
        for c in range(meta.num_columns):
            col = meta.row_group(g).column(c)
            if not keep(g, col.path_in_schema):
                at = col.dictionary_page_offset or col.data_page_offset
                raw[at : at + col.total_compressed_size] = b"\xff" * col.total_compressed_size
    path.write_bytes(bytes(raw))


def table(n=1000):
    day = datetime.date(2024, 1, 1)
    return pa.table({
        "id": pa.array(range(9, 9 + n)), "name": pa.array([None if i % 3 == 0 else f"é{i}" for i in range(n)]), "x": pa.array([float("nan") if i == 5 else -i / 8 for i in range(n)]),
        "day": pa.array([day + datetime.timedelta(i) for i in range(n)]), "price": pa.array([decimal.Decimal(i) / 4 for i in range(n)], pa.decimal128(30, 2)), "yes": pa.array([i > 3 for i in range(n)]),
        "at": pa.array([datetime.datetime(2024, 1, 1, 0, 0, i % 60) for i in range(n)], pa.timestamp("us")), "none": pa.array([None] * n, pa.int64()), "list": pa.array([[i] for i in range(n)]), "raw": pa.array([b"x"] * n)})


WANT = {("id", "9", "1008", 0), ("name", "é1", "é998", 334), ("x", "-124.875", "0.0", 0), ("day", "2024-01-01", "2026-09-26", 0), ("price", "0.00", "249.75", 0), ("yes", "false", "true", 0), ("at", "2024-01-01 00:00:00", "2024-01-01 00:00:59", 0)}


def got(df):
    return {tuple(r) for r in df.select("column", "min", "max", "null_count").collect()}


def test_statistics_read_no_data_page(spark, tmp_path):
    t = table()
    for k in range(3):
        path = tmp_path / f"part-{k}.parquet"
        pq.write_table(t.slice(k * 400, 400), path, row_group_size=70)
        # Decimals of this width have statistics that the reader does not type: their chunks are read.
        spoil(path, lambda g, c: c == "price")
    assert got(footers.column_statistics(spark, str(tmp_path))) == WANT


def test_chunks_without_statistics_are_read_and_no_others(spark, tmp_path):
    for k, names in enumerate((["id", "yes"], True, False)):
        path = tmp_path / "d" / f"part-{k}.parquet"
        path.parent.mkdir(exist_ok=True)
        pq.write_table(table().slice(k * 400, 400), path, row_group_size=100, write_statistics=names)
        spoil(path, lambda g, c, names=names: names is False or c not in names if names is not True else c == "price")
    assert got(footers.column_statistics(spark, str(tmp_path / "d"))) == WANT


def test_statistics_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "a long, b string").write.parquet(str(tmp_path / "e"))
    assert got(footers.column_statistics(spark, str(tmp_path / "e"))) == set()


def test_statistics_of_named_odd_columns(spark, tmp_path):
    spark.createDataFrame([(1, math.inf), (2, None)], "`a.b` long, `c d` double").write.parquet(str(tmp_path / "o"))
    assert got(footers.column_statistics(spark, str(tmp_path / "o"))) == {("a.b", "1", "2", 0), ("c d", "Infinity", "Infinity", 1)}


@pytest.mark.parametrize("k", [1, 2, 7, 100, 999])
def test_sample_reads_few_row_groups(spark, tmp_path, k):
    """Row groups of unequal sizes in several files; those that the sample needs not are unreadable."""
    t, sizes, at, place, places = table(4000), (1000, 17, 983, 2000), 0, 0, []
    for i, n in enumerate(sizes):
        pq.write_table(t.slice(at, n), tmp_path / f"part-{i}.parquet", row_group_size=50)
        places += [(i, g, min(50, n - 50 * g)) for g in range(-(-n // 50))]
        at += n
    n = len(places)
    few = min(n, max(2, -(-n * k // 4000)))
    while True:
        chosen = {j * (n - 1) // (few - 1) for j in range(few)}
        if sum(places[c][2] for c in chosen) >= k:
            break
        few = min(n, max(few + 1, -(-few * k // sum(places[c][2] for c in chosen))))
    assert len(chosen) <= 1.2 * n * k / 4000 + 3
    for i in range(len(sizes)):
        spoil(tmp_path / f"part-{i}.parquet", lambda g, c, i=i: any(places[p][:2] == (i, g) for p in chosen))
    out = footers.sample_row_groups(spark, str(tmp_path), k)
    rows = sorted(r["id"] for r in out.collect())
    assert out.columns == t.column_names and len(rows) == len(set(rows)) == k
    assert rows[0] == 9 and (k == 1 or rows[-1] == 4008)
    assert footers.sample_row_groups(spark, str(tmp_path), k, ["day"]).columns == ["day"]


def test_sample_of_small_tables(spark, tmp_path):
    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "s"))
    for k, n in ((0, 0), (1, 1), (3, 3), (5, 5), (9, 5)):
        assert footers.sample_row_groups(spark, str(tmp_path / "s"), k).count() == n
    assert sorted(r["id"] for r in footers.sample_row_groups(spark, str(tmp_path / "s"), 3).collect()) == [0, 2, 4]


def test_spread_sample_with_further_columns(spark):
    df = spark.range(20_000).select((F.col("id") * 7919 % 20_000).alias("x"), F.col("id").alias("i"), F.lit("more").alias("a"), F.rand(3).alias("b"))
    for k in (0, 1, 2, 100, 30_000):
        rows = sorted(r["x"] for r in layout.spread_sample(df, ["x"], k).collect())
        want = list(range(20_000)) if k > 20_000 else [j * 19_999 // max(1, k - 1) for j in range(k)]
        assert rows == want
