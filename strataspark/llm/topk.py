"""Exact top-k search by inner product with multi-resolution segment statistics.

Components are floor(scale * x). A vector cut into segments keeps, per segment of n components, its mean m and standard
deviation s; by Cauchy and Schwarz the squared distance of two vectors is at least the sum of n * ((m - m')**2 + (s - s')**2),
so their inner product (|q|**2 + |x|**2 - distance**2) / 2 has an upper bound. In each tile of queries and candidates the
bound is taken coarse to fine: COARSE equal segments, then the first FINE of the components one by one and the rest in
segments (a segment of one component is that component, so this level is a partial distance with a bound on what is left).
At every level the best candidates by its bound get exact scores, which raise the score that the k-th result has at least;
what the bound puts below it is dropped, and what survives the last level is scored exactly, pair by pair, in integers.

Queries meet all rows in tiles of bounded size (QUERIES by ROWS), dealt out by hash, so no task grows with the input; a
tile returns at most k rows a query. Inside a tile, strips of STRIP queries by COLUMNS rows bound the memory. Defined
cases: vectors that are null, empty or hold null or non-finite components, and rows without vec_id, take no part; vectors
meet only vectors of their own length; ties go to the smaller vec_id; repeated rows count as separate rows, each a query of
its own; an empty table gives no rows; other columns play no part. Components that are finite only before scaling count as
non-finite; scores that a long cannot hold stand at its ends.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataspark.llm.shared import table

COARSE = (4, 16)
FINE = 0.75
QUERIES = 4096
ROWS = 32768
LEAST = 2048  # rows of a tile, where there are fewer tiles than cores
STRIP = 128
COLUMNS = 8192
PAIRS = 1 << 15  # pairs whose vectors a tile gathers at once


def _levels(d: int) -> list[np.ndarray]:
    """Segment borders of each level for vectors of d components."""
    ones = int(d * FINE)
    rest = np.linspace(ones, d, max(1, (d - ones) // 4) + 1).astype(int)
    return [np.linspace(0, d, min(n, d) + 1).astype(int) for n in COARSE] + [np.concatenate([np.arange(ones), rest])]


def _summary(v: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Per vector, sqrt(n) * mean and sqrt(n) * deviation of each segment: dot products of these bound those of the vectors."""
    out = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        out.append(v[:, a:b].mean(axis=1) * np.sqrt(b - a))
        if b - a > 1:
            out.append(v[:, a:b].std(axis=1) * np.sqrt(b - a))
    return np.stack(out, axis=1)


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, exact: in doubles while every partial sum is below 2**53, else in Python integers."""
    if len(q) and float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1] < 2.0**53:
        return np.einsum("ij,ij->i", q, x).astype(np.int64)
    low, high = -(1 << 63), (1 << 63) - 1
    return np.array([min(high, max(low, sum(int(a) * int(b) for a, b in zip(u, v)))) for u, v in zip(q, x)], dtype=np.int64)


def search(q: np.ndarray, q_row: np.ndarray, x: np.ndarray, x_row: np.ndarray, x_id: np.ndarray, k: int, left: list[float] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, score) index arrays: the k best candidates of each query, ties to the smaller id. ``left``, if
    given, gets the number of pairs and of those that stay after each level added."""
    levels = [(_summary(q, c), _summary(x, c).T) for c in _levels(q.shape[1])]
    slack = 1e-9 * np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1).max() + 1e-6
    m = min(4 * k, len(x))
    out = []
    for lo in range(0, len(q), STRIP):
        at = slice(lo, min(len(q), lo + STRIP))
        least = np.full(at.stop - lo, -np.inf)
        for c in range(0, len(x), COLUMNS):
            cols = slice(c, min(len(x), c + COLUMNS))
            own = q_row[at, None] == x_row[None, cols]
            stay = ~own
            counts = [stay.size]
            for one, two in levels:
                bound = np.where(stay, one[at] @ two[:, cols], -np.inf)
                if bound.shape[1] >= m >= k:
                    best = np.argpartition(-bound, m - 1, axis=1)[:, :m]
                    first = _exact(np.repeat(q[at], m, axis=0), x[c + best.ravel()]).astype(np.float64).reshape(best.shape)
                    first[~np.take_along_axis(stay, best, axis=1)] = -np.inf
                    least = np.maximum(least, -np.partition(-first, k - 1, axis=1)[:, k - 1])
                stay &= ~(bound + slack[at, None] < least[:, None])  # a bound that overflows to no number leaves the pair in
                counts.append(np.count_nonzero(stay))
            if left is not None:
                left[:] = [a + b for a, b in zip(left or [0] * len(counts), counts)]
            a, b = np.nonzero(stay)
            for s in range(0, len(a), PAIRS):
                i, j = a[s : s + PAIRS], c + b[s : s + PAIRS]
                score = _exact(q[lo + i], x[j])
                good = score >= least[i]
                out.append((lo + i[good], j[good], score[good]))
    none = np.empty(0, dtype=np.int64)
    a, b, s = (np.concatenate(p) for p in zip(*out)) if out else (none, none, none)
    order = np.lexsort((x_row[b], x_id[b], -s, a))
    a, b, s = a[order], b[order], s[order]
    rank = np.arange(len(a)) - np.searchsorted(a, a)
    return a[rank < k], b[rank < k], s[rank < k]


def top_k(vectors: DataFrame, queries: Column, k: int = 20, scale: float = 64.0, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score for the rows where ``queries`` holds, against every other row."""
    v = F.col(vector).cast("array<double>")
    good = F.col(id).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) < float("inf")))
    rows = vectors.withColumn("_q", F.coalesce(queries, F.lit(False))).where(good).select(
        F.col(id).cast("long").alias("id"), "_q", F.size(v).alias("dim"), v.alias("v"))
    rows = table(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    n, nq = rows.agg(F.count("*"), F.count_if("_q")).first()
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    cells, blocks = max(1, -(-n // ROWS), min(cores, n // LEAST)), max(1, -(-nq // QUERIES))
    at = F.xxhash64("row")
    q = rows.where("_q").withColumn("s", F.pmod(at, F.lit(blocks))).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(cells - 1)))).drop("_q")
    # Read a second time: the sides of a co-group must not share columns by their inner names.
    rows = rows.sparkSession.read.schema(rows.schema).parquet(rows.shared_path)
    x = rows.withColumn("t", F.pmod(at, F.lit(cells)).cast("int")).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).drop("_q")

    def tile(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"q": [], "query_id": [], "vec_id": [], "row": [], "score": []}).astype("int64")
        a, b = (np.floor(np.stack(p["v"].to_numpy()) * scale) for p in (left, right))
        i, j, s = search(a, left["row"].to_numpy(), b, right["row"].to_numpy(), right["id"].to_numpy(), k)
        return pd.DataFrame({"q": left["row"].to_numpy()[i], "query_id": left["id"].to_numpy()[i], "vec_id": right["id"].to_numpy()[j], "row": right["row"].to_numpy()[j], "score": s})

    found = q.withColumn("s", F.col("s").cast("int")).groupBy("dim", "s", "t").cogroup(x.groupBy("dim", "s", "t")).applyInPandas(tile, "q long, query_id long, vec_id long, row long, score long")
    best = W.partitionBy("q").orderBy(F.col("score").desc(), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
