"""Near-duplicate documents by HyperMinHash.

A document is its set of distinct word shingles (64-bit hashes; a document with fewer words is one shingle of its whole
sequence). Each of REGISTERS buckets keeps the smallest hash of the set under the bucket's own multiplier, stored as its
count of leading zeros (6 bits) and the 10 bits that follow the leading one: two bytes a register. Bands of registers are
hashed; documents that agree in a band are candidates; candidates whose collision-corrected Jaccard estimate is clearly
below the threshold go; the rest are confirmed on their full sets.

How groups stay bounded. Documents with equal sets are one class before banding. Round A links every class with only one
partner, the band representative it meets most often, and joins what is confirmed into components. Round B looks only at
bands that still hold two or more components: their members are cut into blocks of about BLOCK classes, each pair of
blocks is compared in one task, first by registers, then on the full sets of pairs of different components that share a
band, and only confirmed links leave the task. So no task holds a whole group, a group of copies costs
one comparison a member, and no link between components is lost except by banding (below 1e-6 at the threshold).

Every row is a document of its own, told apart by a row number; doc_ids serve only to name components. Defined cases: null
and empty texts have an empty set, link with nothing and are kept; rows that repeat, and rows of one doc_id with different
texts, are compared like any others; of a component the row with the smallest (doc_id, row number) is kept, null doc_ids
last; a component without doc_ids has a null component_id; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataspark.llm import kernels as K
from strataspark.llm.shared import components, matching, stable, table

REGISTERS = 192
MANTISSA = 10
BLOCK = 512
GROUP = 4096  # classes that are compared as one group of blocks; larger groups go band by band
#: Standard errors of the estimate below the threshold at which a candidate is let go.
MARGIN = 6.0


@lru_cache
def banding(threshold: float) -> tuple[int, int]:
    """(bands, rows): the longest bands of REGISTERS registers that miss a pair at the threshold less than once in 1e6."""
    for r in range(16, 0, -1):
        if (1 - threshold**r) ** (REGISTERS // r) < 1e-6:
            return REGISTERS // r, r
    return REGISTERS, 1


def shingle_sets(data: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every document of a buffer, and each document's bounds in them."""
    low = K.lower(data)
    w = K.Words(low, off)
    h, first = K.shingles(K.Rolling(low, 1).of(w.start, w.end), w.first, size)
    sets = [np.unique(h[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
    bounds = np.zeros(len(off), dtype=np.int64)
    np.cumsum([len(s) for s in sets], out=bounds[1:])
    return (np.concatenate(sets) if sets else h[:0]), bounds


def registers(h: np.ndarray) -> np.ndarray:
    """The HyperMinHash registers of one set of 64-bit hashes."""
    mult = K.random_words(REGISTERS, 11) | K.U64(1)
    low = np.full(REGISTERS, np.iinfo(np.uint64).max, dtype=K.U64)
    with np.errstate(over="ignore"):
        for lo in range(0, len(h), 512):
            np.minimum(low, np.multiply.outer(mult, h[lo : lo + 512]).min(axis=1), out=low)
        top = np.frexp(np.maximum(low, K.U64(1)).astype(np.float64))[1]  # bits in use (a value rounded up counts one more)
        zeros = np.clip(64 - top, 0, 63)
        rest = (low << np.minimum(zeros + 1, 63).astype(K.U64)) >> K.U64(64 - MANTISSA)
    return (zeros.astype(np.uint16) << MANTISSA) | rest.astype(np.uint16)


@lru_cache(maxsize=4096)
def _chance(a: int, b: int) -> float:
    """The chance that a register of two disjoint sets of a and b shingles agrees: over all cells, both minima in the cell."""
    z = np.arange(0, 40, dtype=np.float64)[:, None]
    m = np.arange(0, 1 << MANTISSA, 8, dtype=np.float64)[None, :]
    step = 8.0 / (1 << MANTISSA)
    lo = 2.0 ** -(z + 1) * (1 + m / (1 << MANTISSA))
    hi = lo + 2.0 ** -(z + 1) * step
    cell = [np.exp(-n * lo) - np.exp(-n * hi) for n in (a, b)]
    return float((cell[0] * cell[1]).sum() / 8)


def estimate(equal: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard from the share of equal registers, less the collisions that sets of these sizes have by chance."""
    key = lambda n: np.maximum(1, 2 ** np.round(np.log2(np.maximum(n, 1)))).astype(int)  # noqa: E731  sizes to powers of two: the chance changes slowly
    ka, kb = key(a), key(b)
    pairs, back = np.unique(np.stack([ka, kb]), axis=1, return_inverse=True)
    c = np.array([_chance(int(x), int(y)) for x, y in pairs.T])[back.ravel()]
    return (equal - c) / (1 - c)


def numbered(docs: DataFrame, text: str = "text") -> DataFrame:
    """row (a number of the input row, the same in every job if ``docs`` is stable), doc_id, text."""
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def sketches(rows: DataFrame, size: int, threshold: float) -> DataFrame:
    """row, doc_id, n_shingles, set_hi and set_lo (a hash of the set), regs (binary), bands (one hash a band; none for an empty set)."""
    bands, width = banding(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = K.random_words(bands, 5)
        for b in batches:
            for lo, hi, data, off in K.chunks(b.column(2)):
                h, bounds = shingle_sets(data, off, size)
                n = np.diff(bounds)
                some = n > 0
                regs = np.array([registers(h[x:y]) for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist())])
                with np.errstate(over="ignore"):
                    sums = [K.per_doc_u64(K.splitmix(h + K.U64(s)), bounds) for s in (1, 2)]
                    key = np.broadcast_to(salt, (hi - lo, bands)).copy()
                    for j in range(width):
                        key = K.splitmix(key * K.U64(31) + regs[:, : bands * width].reshape(hi - lo, bands, width)[:, :, j])
                ends = np.zeros(hi - lo + 1, dtype=np.int32)
                np.cumsum(np.where(some, bands, 0), out=ends[1:])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(n), *(pa.array(s.view(np.int64)) for s in sums),
                     pa.array([r.tobytes() for r in regs], type=pa.binary()),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(key[some].ravel().view(np.int64)))],
                    names=["row", "doc_id", "n_shingles", "set_hi", "set_lo", "regs", "bands"])

    return rows.mapInArrow(run, "row long, doc_id long, n_shingles long, set_hi long, set_lo long, regs binary, bands array<long>")


def _sets(rows: DataFrame, ids: DataFrame, sk: DataFrame, size: int) -> DataFrame:
    """id (a row number) and its set, for the rows in ``ids``. They are met by doc_id and row: Spark's runtime filter needs a
    column of the file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, off in K.chunks(b.column(1)):
                h, bounds = shingle_sets(data, off, size)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(h.view(np.int64)))], names=["id", "set"])

    some = ids.toDF("row").join(sk.select("row", F.coalesce("doc_id", F.lit(0)).alias("key")), "row")
    return matching(rows.select("row", "text", F.coalesce("doc_id", F.lit(0)).alias("key")), some, "key", "row").select("row", "text").mapInArrow(run, "id long, set array<long>")


def _confirm(pairs: DataFrame, rows: DataFrame, sk: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of row numbers whose full sets have 100 * intersection >= percent * union."""
    sets = table(_sets(rows, pairs.select(F.explode(F.array("a", "b"))).distinct(), sk, size), "sets")
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
    n = F.size(F.array_intersect("x", "y"))
    return both.where(100 * n >= percent * (F.size("x") + F.size("y") - n)).select("a", "b")


def _near(pairs: DataFrame, sk: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose estimate is not clearly below the threshold."""
    left = sk.select(F.col("row").alias("a"), F.col("regs").alias("ra"), F.col("n_shingles").alias("na"))
    right = sk.select(F.col("row").alias("b"), F.col("regs").alias("rb"), F.col("n_shingles").alias("nb"))
    floor = cutoff(threshold)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            if len(p):
                x, y = (np.frombuffer(b"".join(p[c]), dtype=np.uint16).reshape(len(p), REGISTERS) for c in ("ra", "rb"))
                yield p.loc[estimate((x == y).mean(axis=1), p["na"].to_numpy(), p["nb"].to_numpy()) >= floor, ["a", "b"]]

    sized = pairs.join(left, "a").join(right, "b").where(f"least(na, nb) >= {threshold} * greatest(na, nb) - 1e-9")
    return sized.mapInPandas(run, "a long, b long")


def cutoff(threshold: float) -> float:
    return threshold - MARGIN * (threshold * (1 - threshold) / REGISTERS) ** 0.5


def links(rows: DataFrame, sk: DataFrame, size: int, percent: int) -> DataFrame:
    """Confirmed links (a, b) between classes, by row number, enough to connect every component; ``sk`` has one row a class."""
    threshold = percent / 100
    keys = sk.select(F.col("row").alias("id"), F.explode("bands").alias("key"))
    # Written first, so that the join reads two plain exchanges and a band with very many members can be split.
    full = table(keys.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("rep")).where("n > 1"), "keys")
    members = table(keys.join(full, "key"), "members")
    meets = members.where("id <> rep").groupBy("id", "rep").agg(F.count("*").alias("c"))
    best = meets.groupBy("id").agg(F.max(F.struct("c", (-F.col("rep")).alias("r"))).alias("m")).select(F.col("id").alias("a"), (-F.col("m.r")).alias("b"))
    one = table(_confirm(_near(best, sk, threshold), rows, sk, size, percent), "links_a")

    comp = components(one).select(F.col("node").alias("id"), "root")
    m = members.select("key", "id").join(comp, "id", "left").withColumn("root", F.coalesce("root", "id"))
    mixed = m.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    left = table(m.join(mixed, "key", "left_semi"), "mixed")
    # Bands that share classes are one group, unless that is a large one: then each band is.
    near = components(left.groupBy("key").agg(F.min("id").alias("b")).join(left, "key").select(F.col("id").alias("a"), "b")).select(F.col("node").alias("id"), F.col("root").alias("group"))
    sized = near.groupBy("group").agg(F.count("*").alias("n")).where(F.col("n") <= GROUP)
    near = near.join(sized, "group")
    of = left.join(near, "id", "left").select("id", "root", F.coalesce("group", F.xxhash64(F.lit("band"), "key")).alias("group")).distinct()
    blocks = of.groupBy("group").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    sets = table(_sets(rows, of.select("id").distinct(), sk, size), "sets_b")
    full = of.join(blocks, "group").join(sets, "id").join(sk.select(F.col("row").alias("id"), "regs", "bands"), "id")
    full = full.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    full = full.select("group", "id", "root", "regs", "bands", "set", "own", F.least("own", "other").alias("s"), F.greatest("own", "other").alias("t"))
    floor = cutoff(threshold)

    def compare(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        s, t = int(key[1]), int(key[2])
        p = p.drop_duplicates("id").sort_values("id", ignore_index=True)
        p["n"] = p["set"].map(len)
        x, y = p[p["own"] == s], p[p["own"] == t]
        out, joined = [], {}
        if len(x) and len(y):
            regs = np.frombuffer(b"".join(y["regs"]), dtype=np.uint16).reshape(len(y), REGISTERS)
            bands = np.stack(y["bands"].to_numpy())
            ids, roots, sizes, sets_y = (y[c].to_numpy() for c in ("id", "root", "n", "set"))
            for i, root, r, band, own_set, n in zip(x["id"], x["root"], x["regs"], x["bands"], x["set"], x["n"]):
                while root in joined:
                    root = joined[root]
                some = (roots != root) & (100 * np.minimum(sizes, n) >= percent * np.maximum(sizes, n))
                some &= (ids > i) if s == t else True
                at = np.flatnonzero(some)
                at = at[(bands[at] == band).any(axis=1)]
                if len(at):
                    j = estimate((regs[at] == np.frombuffer(r, dtype=np.uint16)).mean(axis=1), np.full(len(at), n), sizes[at])
                    at = at[j >= floor]
                if len(at):
                    every, own_set = np.concatenate(sets_y[at]).view(np.uint64), own_set.view(np.uint64)  # sorted as unsigned
                    place = np.minimum(np.searchsorted(own_set, every), n - 1)
                    hit = own_set[place] == every
                    common = np.add.reduceat(hit.astype(np.int64), np.cumsum(sizes[at]) - sizes[at])
                    linked = at[100 * common >= percent * (n + sizes[at] - common)]
                    for k in linked.tolist():
                        out.append((min(i, ids[k]), max(i, ids[k])))
                    for old in np.unique(roots[linked]).tolist():  # what is joined now needs no further comparison here
                        joined[old] = root
                        roots = np.where(roots == old, root, roots)
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return one.union(full.groupBy("group", "s", "t").applyInPandas(compare, "a long, b long"))


def _ledger(docs: DataFrame, size: int, percent: int, text: str) -> DataFrame:
    """row, doc_id, n_shingles, component_id, kept of every row of ``docs``, which is stable."""
    rows = numbered(docs, text)
    sk = table(sketches(rows, size, percent / 100), "sketches")
    group = ["n_shingles", "set_hi", "set_lo"]
    classes = table(sk.where("n_shingles > 0").groupBy(group).agg(F.min("row").alias("rep")), "reps")
    # Both sides of this join are plain scans, so that a class with very many rows can be split.
    of = table(sk.select("row", "doc_id", *group).join(classes, group, "left").select("row", "doc_id", "n_shingles", F.coalesce("rep", "row").alias("rep")), "classes")
    comp = components(links(rows, sk.join(classes.select(F.col("rep").alias("row")), "row"), size, percent))
    roots = table(of.join(comp, of["rep"] == comp["node"], "left").select("row", "doc_id", "n_shingles", F.coalesce("root", "rep").alias("root")), "roots")
    place = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "row")
    first = table(roots.groupBy("root").agg(F.min(place).alias("first")), "first")
    return roots.join(first, "root").select("row", "doc_id", "n_shingles", F.col("first.doc_id").alias("component_id"), (place == F.col("first")).alias("kept"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, text: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest doc_id reachable by links), kept (the component's one row)."""
    return _ledger(stable(docs), size, percent, text).drop("row")


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, text: str = "text") -> DataFrame:
    """The documents, one row of each component, with the input's columns."""
    docs = stable(docs)
    kept = _ledger(docs, size, percent, text).where("kept").select("row")
    return docs.select(F.struct("*").alias("in"), F.monotonically_increasing_id().alias("row")).join(kept, "row").select("in.*").select(*docs.columns)
