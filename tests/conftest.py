from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    tmp = tmp_path_factory.mktemp("spark")
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.local.dir", str(tmp)).config("spark.checkpoint.dir", str(tmp / "shared")).config("spark.sql.warehouse.dir", str(tmp / "warehouse")).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def norm(v):
    import datetime
    import decimal
    import math

    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, list | tuple):
        return tuple(norm(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


@pytest.fixture(scope="session")
def agree(spark):
    """Run a registered query and its oracle at sf0.001; rows must agree."""
    import duckdb

    import __spark_entry__

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    queries, oracle = __spark_entry__.queries(), __spark_entry__.oracle_sql()

    def check(name: str) -> int:
        df = queries[name](spark, sf)
        cols = sorted(df.columns)
        mine = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
        if name not in oracle:
            return len(mine)
        cur = con.execute(oracle[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == cols
        theirs = sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)
        assert mine == theirs
        return len(mine)

    return check
