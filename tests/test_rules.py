"""Rules of names, paths, records and listings against plain Python, on inputs that reach every branch."""

import fnmatch
import hashlib
import itertools
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from strataspark.functions import queries as Q
from strataspark.functions import text as T
from strataspark.operators import files as files_ops
from strataspark.operators import inference


def column(spark, values, expr, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i long, v {kind}").select("i", expr(F.col("v")).alias("r")).collect()
    return [r["r"] for r in sorted(rows)]


GLOBS = ["v[0-9]*", "[!a]*", "*", "?.tif", "a[]b]", "a[!]b]", "[ab", "x[a-c-e]", "[z-a]", "[!z-a]", "[^a]b", "a[[]b", "[&&x]", "[a\\]", "tile_??.*", "a.b", "[]", "[!]", "a]", "v[!0-9]", "[a-]", "[-a]", "(x|y)", "a[!", "{1}"]
NAMES = ["v1", "v5x", "v", "vx", "abc", "bcd", "!x", "a.tif", "a]", "ab", "aa", "a!", "[ab", "[", "xa", "xb", "xd", "x-", "xe", "^b", "ab", "b", "a[b", "&", "x", "a\\", "\\", "tile_01.png", "aXb", "a.b", "[]", "[!]", "", "a-", "-", "(x|y)", "a[!", "{1}", "n\nl", "é"]


def test_globs(spark):
    df = spark.createDataFrame([(n,) for n in NAMES], "n string")
    for g in GLOBS:
        got = {r["n"] for r in df.where(F.col("n").rlike(T.glob_to_regex(g))).collect()}
        assert got == {n for n in NAMES if fnmatch.fnmatchcase(n, g)}, g


@pytest.mark.parametrize("seed", range(3))
def test_sanitize_filename(spark, seed):
    import random

    rnd = random.Random(seed)
    part = ["é", "ň", "Ø", "ﬁ", "日本", "A", "b", " ", "-", ".", "_", "(", "]", "{", "/", "\\", "\t", "1", "ß", "..", "- ."]
    names = ["", "données.tif", "Plzeň", "...", ".x", "a.", "日本.shp"] + ["".join(rnd.choices(part, k=rnd.randint(1, 8))) for _ in range(150)]

    def plain(n):
        n = n.replace("/", "-").replace("\\", "-")
        at = n.rfind(".")
        stem = n[:at] if 0 < at < len(n) - 1 else n
        x = unicodedata.normalize("NFKD", stem).encode("ascii", "ignore").decode().lower()
        x = re.sub("-+", "-", re.sub(r"[\s()\[\]{}]", "-", x)).strip("-.")
        x = re.sub(r"\.-+", ".", re.sub(r"-+\.", ".", x))
        return (x or "file_" + hashlib.sha256(stem.encode()).hexdigest()[:6]) + re.sub(r"\s", "", n[len(stem) :].lower())

    assert column(spark, names, T.sanitize_filename) == [plain(n) for n in names]


def test_keywords(spark):
    words = {"land-use": True, "2024": True, "EU": True, "Vial_Nacional": False, "db120": False, "roads": True, "ns:roads": False, "covid19": True, "a1": False, "abc1234x": False, "abc1234xy": True, " ": False, None: False, "x12 y": True}
    assert column(spark, list(words), Q.meaningful_keyword) == list(words.values())


def test_nodata(spark):
    values = {"7": (7, None), " -12 ": (-12, None), "+3": (3, None), "1.0": (None, 1.0), "1e3": (None, 1000.0), ".5": (None, 0.5), "5.": (None, 5.0), "nan": (None, None), "NaN": (None, None), "inf": (None, None), "-Infinity": (None, None), "": (None, None), None: (None, None), "x": (None, None), "1 2": (None, None), "9" * 30: (None, 1e30)}
    got = column(spark, list(values), T.parse_nodata)
    assert [(r["integer"], r["real"]) for r in got] == list(values.values())


def test_paths(spark):
    paths = {"a/../b": None, "../x": "traversal", "a/../../b": "traversal", "../base/x": None, "/data/base/x": None, "/data/basement": "traversal", "/etc": "traversal", ".": None, "": None, "a/./b//c": None, "/data/base/../x": "traversal"}
    assert column(spark, list(paths), lambda c: Q.safe_path(c, "/data/base")) == list(paths.values())
    assert column(spark, ["/etc", "../.."], lambda c: Q.safe_path(c, "/")) == [None, None]
    items = {"scene-1.v2": None, "": "empty", None: "empty", "a\nb": "control", "a?b": "query", "a#b": "query", "%2e": "encoded", "a/b": "separator", "a\\b": "separator", "..": "separator"}
    assert column(spark, list(items), Q.item_id_problem) == list(items.values())
    urls = {"s3://b/p": None, "gs://b": None, "https://h/p?q=..": None, "": "empty", "b/p": "scheme", "ftp://b": "scheme", "s3:///p": "host", "s3:b": "host", "az://c/../x": "traversal", "http://h/\tx": "control"}
    assert column(spark, list(urls), Q.remote_url_problem) == list(urls.values())


def test_metadata_rules(spark):
    good = {"contact": {"name": "n", "email": "n@x.org"}, "license": "MIT"}
    cases = [
        (good, []), ({}, ["contact missing", "license missing"]), (good | {"contact": {"name": "n", "email": " "}}, ["contact.email empty", "contact.email format"]), (good | {"license": "other"}, ["license needs_url"]), (good | {"license": "other", "license_url": "https://x"}, []),
        (good | {"providers": [None, {"roles": ["host", None, "x"]}]}, ["providers[0] no mapping", "providers[1].name missing", "providers[1].roles null", "providers[1].roles x", "providers[1] unreachable host"]),
        (good | {"providers": [{"name": "a", "roles": ["host"], "email": "a@x.org"}, {"name": "b", "roles": ["producer"]}]}, []),
        (good | {"defaults": {"start": "2024-02-30", "end": "24", "nodata": [1.0, None]}}, ["defaults.start no date", "defaults.end format"]), (good | {"defaults": {"year": 2101}}, ["defaults.year range"]),
        (good | {"authors": [None, {"name": "a", "orcid": "0000-0002-1825-009X"}], "related_dois": [None], "citations": ["c\nd", None], "upstream_version_url": "https://x|y"}, ["authors[0] none", "related_dois[0] no text", "citations[1] no text", "upstream_version_url format"]),
    ]
    import json

    got = column(spark, [json.dumps(c) for c, _ in cases], lambda c: Q.metadata_rules(lambda f: F.from_json(c, Q.METADATA)[f]))
    assert got == [w for _, w in cases]


def infer(spark, names):
    df = spark.createDataFrame([(1, n.rpartition("/")[2], n) for n in names], "g long, name string, path string")
    return [(r["suggested_name"], r["pattern_type"], r["names"], r["files"], r["confidence"]) for r in inference.infer_collections(df, ["g"]).orderBy("place").collect()]


def test_infer_collections(spark):
    assert infer(spark, ["rain_rp5.tif", "rain_rp50.tif"]) == [("rain", "return_period", 2, 2, 0.9), ("rain_rp", "numeric", 2, 2, 0.7), ("rain_rp5", "prefix", 2, 2, 0.6)]
    assert infer(spark, ["x/adminL1.shp", "y/adminL1.shp", "adminL2.shp", "notes.txt"]) == [("admin", "level", 2, 3, 0.9), ("adminL", "numeric", 2, 3, 0.7)]
    assert infer(spark, ["pop_2010.csv", "pop-2011.csv", "pop2012.csv"]) == [("pop", "numeric", 3, 3, 0.8)]
    assert infer(spark, ["a_v1.x", "b_v2.x", "b_v3.x"]) == [("b_v", "numeric", 2, 2, 0.7)]  # two bases: no marker
    assert infer(spark, ["v1.x", "v2.x"]) == [("v", "numeric", 2, 2, 0.7)]
    assert infer(spark, ["roads_-a.x", "roads_-b.x"]) == [("roads", "prefix", 2, 2, 0.6)]
    assert infer(spark, ["ab1.x", "ab2.y"])[-1][1] == "numeric" and infer(spark, ["one.tif"]) == infer(spark, []) == []


def test_common_prefix(spark):
    pairs = [("", ""), ("a", ""), ("abc", "abd"), ("abc", "abc"), ("é1", "é2"), ("x", "y")]
    df = spark.createDataFrame(pairs, "a string, b string").withColumn("p", inference.common_prefix("a", "b"))
    assert [r["p"] for r in df.collect()] == ["", "", "ab", "abc", "é", ""]


def test_is_current_hashes_only_what_is_undecided(spark, tmp_path):
    """All key forms and all decisions; files that the size or the time decides are not there to be hashed."""
    real = tmp_path / "here.csv"
    real.write_bytes(b"some bytes")
    sha = hashlib.sha256(b"some bytes").hexdigest()
    kinds = {"explicit": "k1", "scoped": "it/f.csv", "name": "f.csv", "converted": "f.parquet", "scoped_converted": "it/f.parquet", "none": "other"}
    files, stored, want = [], [], {}
    states = {"same": (10, 100.0, True), "late_within": (10, 101.9, True), "size": (11, 100.0, False), "touched": (10, 200.0, True), "edited": (10, 200.0, False), "no_size": (None, 100.0, True), "no_time": (10, None, True)}
    for n, ((form, key), (state, (size, mtime, now))) in enumerate(itertools.product(kinds.items(), states.items())):
        undecided = form != "none" and state in ("touched", "edited", "no_size", "no_time")
        path = f"file://{tmp_path}/{n}.csv" if undecided else f"file://{tmp_path}/absent/{n}.csv"
        if undecided:
            (tmp_path / f"{n}.csv").write_bytes(b"some bytes")
        files.append((n, path, "it", "f.csv", 10, 100.0, "k1" if form == "explicit" else None, False))
        stored.append((n, key, size, mtime, sha if state != "edited" else "0" * 64))
        want[path] = now and form != "none"
    files += [(900, "dir", "it", "d.gdb", 10, 100.0, None, True), (901, f"file://{tmp_path}/gone", "it", "g", 10, 0.0, None, False)]
    stored += [(900, "d.gdb", 10, 100.0, "x"), (901, "g", 10, 100.0, sha), (0, "it/f.csv", 10, 100.0, sha)]
    want |= {"dir": False, f"file://{tmp_path}/gone": False}
    f = spark.createDataFrame(files, "c long, path string, item string, name string, size_bytes long, mtime double, asset_key string, is_dir boolean")
    s = spark.createDataFrame(stored, "c long, key string, size_bytes long, mtime double, sha256 string")
    asked = []

    def hashes(paths):
        asked.extend(r["path"] for r in paths.collect())
        return inference.hash_files(paths.where("path <> 'dir'"))

    got = {r["path"]: r["current"] for r in inference.is_current(f, s, ["c"], hashes).collect()}
    assert got == want
    assert sorted(asked) == sorted([p for p in want if "absent" not in p])
    told = inference.is_current(f.drop("asset_key", "is_dir").where("c = 14"), s, ["c"]).collect()
    assert [r["current"] for r in told] == [True]


def test_checklist_and_pattern(spark):
    kind = "path string, dir string, name string, stem string, ext string, collection string"
    row = lambda p: (p, p.rpartition("/")[0], p.rpartition("/")[2], p.rpartition("/")[2].rpartition(".")[0], p.rpartition(".")[2], "c")
    tree = [row(p) for p in ("README.md", "root.tif", "roads/roads_2020.parquet", "dem/other.tif", "dem/sub/sub.tif", "dem/two.tif", "Bad Dir/bad dir.shp")]
    got = {r["rule"]: (r["failures"], r["passed"]) for r in files_ops.structure_checklist(spark.createDataFrame(tree, kind)).collect()}
    assert got == {"root_catalog": (1, True), "root_readme": (0, True), "no_root_geo_assets": (1, False), "single_geo_asset_per_dir": (1, False), "no_mixed_structure": (1, False), "geo_asset_naming": (2, True), "valid_ids": (1, False)}
    none = files_ops.structure_checklist(spark.createDataFrame([], kind)).collect()
    assert all(r["passed"] for r in none) and len(none) == 7

    def pattern(*paths):
        df = spark.createDataFrame([row(p) for p in paths], kind)
        return tuple(files_ops.structure_pattern(df, ["collection"]).first())[1:]

    assert pattern("a.txt") == ("empty", 0, False) and pattern("a.tif") == ("flat", 0, False)
    assert pattern("c/i/a.tif") == ("raster_items", 1, True) and pattern("c/a.tif", "d/b.tif") == ("raster_collection", 2, False)
    assert pattern("c/a.parquet") == ("vector_collection", 1, False) and pattern("c/a.parquet", "c/a.tif") == ("mixed", 1, False)
    assert pattern("c/a.csv", "c/k=1/b.csv") == ("single_collection", 1, False) and pattern("c/a.csv", "d/a.pmtiles") == ("multiple_collections", 2, False)
