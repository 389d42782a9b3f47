"""Exact quantiles by narrowing brackets; statistics of bands."""

import numpy as np
import pytest

from strataspark.operators import statistics

QS = [0.0, 0.02, 0.25, 0.5, 0.98, 1.0]


@pytest.mark.parametrize("inside", [5, 50, 100_000])
def test_exact_quantiles(spark, inside):
    rng = np.random.default_rng(1)
    groups = {1: rng.normal(size=3000), 2: np.repeat([1.0, 2.0, 3.0], [2000, 3, 997]), 3: np.array([7.0]), 4: rng.integers(0, 40, 2500).astype(float), 5: np.array([-np.inf, 0.0, np.inf]), 6: np.full(400, 2.5), 7: np.sort(rng.pareto(1.0, 3000)) * 1e6, 8: np.array([1.0, 2.0])}
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [(1, None), (1, float("nan")), (9, None)]
    df = spark.createDataFrame(rows, "g long, x double")
    got = {(r["g"], r["i"]): r["v"] for r in statistics.exact_quantiles(df, ["g"], "x", QS, inside).collect()}
    assert {g for g, _ in got} == set(groups)
    for k, v in groups.items():
        if k != 5:
            assert [got[k, i] for i in range(len(QS))] == pytest.approx(np.quantile(v, QS).tolist(), rel=1e-12, abs=1e-12)
    assert got[5, 3] == 0.0 and got[5, 0] == -np.inf


def test_stretch(spark):
    df = spark.createDataFrame([(1, float(i)) for i in range(101)] + [(1, None), (1, float("nan")), (2, 5.0), (3, None)], "b long, value double")
    rows = [tuple(r) for r in statistics.percentile_stretch(df, ["b"], inside=10).collect()]
    got = {r[1]: r[2] for r in rows if r[0] == 1 and r[1] == r[1]}
    assert got[0.0] == got[2.0] == 0.0 and got[98.0] == got[100.0] == 255.0 and got[50.0] == pytest.approx(127.5)
    assert sorted(r[2] for r in rows if r[0] != 1) == [0.0, 0.0] and len(rows) == 105


def test_stretched_values_are_not_rounded(spark):
    """A value a little below a whole number stays below it, so its floor is not the next one."""
    df = spark.createDataFrame([(1, 0.0), (1, 255.0), (1, 66.9999998)], "b long, value double")
    got = {r["value"]: r["stretched"] for r in statistics.percentile_stretch(df, ["b"], 0.0, 1.0).collect()}
    assert got[66.9999998] == pytest.approx(66.9999998, abs=1e-9) and got[66.9999998] < 66.99999985


def test_cached_band_statistics_read_new_files_alone(spark, tmp_path):
    """Files whose moments are stored are made unreadable; a changed stamp reads a file again; merged moments equal recomputed ones."""
    rng = np.random.default_rng(2)
    rows = [(f, b, float(x)) for f in range(6) for b in (1, 2) for x in 1e6 + rng.normal(size=200) * (1 + f)] + [(0, 1, None), (1, 2, float("nan")), (2, 3, None), (3, 1, -9.0)]
    root, store = tmp_path / "p", str(tmp_path / "m")
    spark.createDataFrame(rows, "file long, band long, value double").write.partitionBy("file").parquet(str(root))
    pixels = spark.read.schema("band long, value double, file long").parquet(str(root))
    files = lambda stamps: spark.createDataFrame([(f, s) for f, s in stamps.items()], "file long, stamp string")
    run = lambda stamps: {r["band"]: tuple(r)[1:] for r in statistics.band_statistics_cached(pixels, files(stamps), store, ["band"], nodata=-9.0).collect()}
    spoil = lambda f: [p.write_bytes(b"no parquet") for p in (root / f"file={f}").glob("*.parquet")]

    def want(names):
        df = spark.createDataFrame([r for r in rows if r[0] in names], "file long, band long, value double")
        return {r["band"]: tuple(r)[1:] for r in statistics.band_statistics(df, ["band"], nodata=-9.0).collect()}

    def same(a, b):
        assert a.keys() == b.keys()
        for k in a:
            assert a[k] == b[k] or a[k] == pytest.approx(b[k], rel=1e-9)

    same(run({0: "a", 1: "a"}), want({0, 1}))
    spoil(0)
    same(run(dict.fromkeys(range(5), "a")), want(set(range(5))))
    for f in (1, 2, 3):
        spoil(f)
    same(run(dict.fromkeys(range(5), "a")), want(set(range(5))))
    same(run({0: "a", 2: "a", 4: "b", 5: "a"}), want({0, 2, 4, 5}))
    with pytest.raises(Exception, match="(?i)parquet"):
        run({1: "b"})
