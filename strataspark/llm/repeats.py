"""Repeated passages by distributed prefix doubling with fingerprint ranks.

The rank of a position at length h is a 64-bit name of the h bytes that start there; the name at 2h is the name of the
pair (rank at p, rank at p + h), so equal strings have equal ranks at every length and no suffix array is held anywhere.
Spark sorts (groups) the ranks and keeps a position only while its rank occurs again, until the length reaches SPAN.

The first round, at length BASE, is sparse: of the BASE-byte strings inside a window of SPAN bytes only the one with the
smallest rank stands for the window (about one position in 50 is ever chosen; equal windows choose at the same place).
A run of neighbouring windows with one such anchor is one row, with a fingerprint of all the bytes under it, its context.
 * An anchor rank that occurs once: none of its windows occurs again; the rows go.
 * An anchor rank with one context: every window under it occurs again; the run is settled as a whole.
 * Otherwise the distinct contexts go on: one occurrence of each gives the ranks of its windows at length SPAN (doubled
   from BASE), these are counted, and windows whose rank occurs again are settled.
Spans of settled windows are merged per document.

Scale: rows are a small fraction of the bytes; copies of a passage are one context however many they are; counts are
pre-aggregated and met by equi-joins, so no task holds a group. Texts are read by Arrow maps and are shuffled only where a
document has something to look at. Fingerprints have 64 bits and are compared only within equal anchor ranks, of 64 bits too.

Defined cases: null and empty texts have no bytes; repeated rows of one doc_id are documents of their own; a text shorter
than SPAN bytes loses nothing; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataspark.llm import kernels as K
from strataspark.llm.shared import drop, stable, table

SPAN = 200
BASE = 100  # SPAN is BASE doubled once; a shorter one makes fewer anchors but leaves more windows unsettled at edges
PLACE = K.U64(32)  # bits of a place in a buffer; an Arrow string column has less than 2 ** 31 bytes


def _window_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbouring values (block prefix and suffix minima)."""
    n = len(v) - w + 1
    pad = -len(v) % w
    x = np.concatenate([v, np.full(pad, np.iinfo(v.dtype).max, dtype=v.dtype)]).reshape(-1, w)
    left = np.minimum.accumulate(x, axis=1).ravel()
    right = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def anchors(data: np.ndarray, off: np.ndarray, span: int = SPAN, base: int = BASE) -> tuple[np.ndarray, ...]:
    """(document, first window, last window, rank, context) of every run of windows with one anchor; windows are numbered
    by their start in the document, the context covers all bytes of the run and where the anchor lies in it."""
    none = np.empty(0, dtype=np.int64)
    if len(data) < span:
        return none, none, none, none, none
    roll = K.Rolling(data, 9)
    g = roll.grams(base)
    # The leftmost of the smallest, by the rank's high half whatever the buffer's length: equal windows have equal anchors.
    key = (g >> PLACE << PLACE) | np.arange(len(g), dtype=K.U64)
    at = (_window_min(key, span - base + 1) & ((K.U64(1) << PLACE) - K.U64(1))).astype(np.int64)
    doc = K.rows_of(off)
    start = np.arange(len(at))
    inside = doc[: len(at)] == doc[span - 1 :]
    new = np.empty(len(at), dtype=bool)
    new[:1] = True
    new[1:] = (at[1:] != at[:-1]) | ~inside[:-1]
    lo = np.flatnonzero(new & inside)
    ends = np.flatnonzero(inside & np.append(new[1:] | ~inside[1:], True))
    a = at[lo]
    with np.errstate(over="ignore"):
        ctx = K.splitmix(roll.of(lo, ends + span) + (a - lo).astype(K.U64) * K.U64(0x9E3779B97F4A7C15))
    d = doc[lo]
    return d, start[lo] - off[d], start[ends] - off[d], g[a].view(np.int64), ctx.view(np.int64)


def ranks(data: np.ndarray, base: int = BASE, span: int = SPAN) -> np.ndarray:
    """The rank at length span of every position that has span bytes after it, doubled from length base."""
    g = K.Rolling(data, 10).grams(base)
    h = base
    with np.errstate(over="ignore"):
        while h < span:
            g = K.splitmix(g[: len(g) - h] * K.U64(0x9E3779B97F4A7C15) + g[h:])
            h *= 2
    return g


def _scan(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id"), F.col(text).cast("string").alias("text"))


def runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """row, lo, hi, rank, ctx: the runs of windows of every document (row numbers the rows of the scan)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, end, data, off in K.chunks(b.column(1)):
                d, lo, hi, rank, ctx = anchors(data, off)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, end - first).take(pa.array(d)), *map(pa.array, (lo.astype(np.int32), hi.astype(np.int32), rank, ctx))], names=["row", "lo", "hi", "rank", "ctx"])

    return _scan(docs, text).select("row", "text").where(f"octet_length(text) >= {SPAN}").mapInArrow(run, "row long, lo int, hi int, rank long, ctx long")


def _windows(docs: DataFrame, contexts: DataFrame, text: str) -> DataFrame:
    """name (rank at SPAN), row, at, n: a row per window of each distinct context."""
    wanted = contexts.groupBy("row").agg(F.collect_list(F.struct("lo", "hi", "n")).alias("want"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, want = b.column(0).to_numpy(), b.column(2)
            for first, end, data, off in K.chunks(b.column(1)):
                name = ranks(data)
                w = want.slice(first, end - first)
                item = w.flatten()
                lo, hi, n = (item.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
                d = np.repeat(np.arange(end - first), w.value_lengths().to_numpy())
                size = hi - lo + 1
                step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                at = np.repeat(lo, size) + step
                d, n = np.repeat(d, size), np.repeat(n, size)
                for s in range(0, len(at), 1 << 17):
                    c = slice(s, s + (1 << 17))
                    yield pa.RecordBatch.from_arrays([pa.array(name[off[d[c]] + at[c]].view(np.int64)), pa.array(row[first:end][d[c]]), pa.array(at[c].astype(np.int32)), pa.array(n[c].astype(np.int32))], names=["name", "row", "at", "n"])

    return _scan(docs, text).select("row", "text").join(wanted, "row").mapInArrow(run, "name long, row long, at int, n int")


def repeated_windows(docs: DataFrame, text: str = "text") -> DataFrame:
    """row, lo, hi: runs of windows (by start) of SPAN bytes that occur again anywhere."""
    r = runs(docs, text)
    # Written first, so that the join reads two plain exchanges and a rank with very many rows can be split.
    seen = table(r.groupBy("rank").agg(F.count("*").alias("c"), F.min("ctx").alias("c0"), F.max("ctx").alias("c1")).where("c > 1").select("rank", (F.col("c0") != F.col("c1")).alias("mixed")), "ranks")
    again = table(r.join(seen, "rank"), "anchors")
    whole = again.where("not mixed").select("row", "lo", "hi")
    first = F.min(F.struct("row", "lo", "hi")).alias("at")
    contexts = table(again.where("mixed").groupBy("rank", "ctx").agg(F.least(F.count("*"), F.lit(2)).cast("int").alias("n"), first).select("rank", "ctx", "n", "at.*"), "contexts")
    copied = again.where("mixed").join(contexts.where("n > 1").select("rank", "ctx"), ["rank", "ctx"], "left_semi").select("row", "lo", "hi")
    w = table(_windows(docs, contexts, text), "windows")
    often = w.groupBy("name").agg(F.sum("n").alias("c")).where("c > 1").select("name")
    single = table(w.where("n = 1").join(often, "name", "left_semi").select("row", F.col("at").alias("lo"), F.col("at").alias("hi")), "settled")
    drop(w)
    return whole.union(copied).union(single)


def spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """row and ``cut``: the settled runs of a document, as an array (a document's own, so bounded by its length)."""
    return repeated_windows(docs, text).groupBy("row").agg(F.collect_list(F.struct("lo", "hi")).alias("cut"))


def remove_repeats(docs: DataFrame, text: str = "text", with_text: bool = False) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the remaining bytes, on request)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cut = b.column(2)
            for first, end, data, off in K.chunks(b.column(1)):
                c = cut.slice(first, end - first)
                item = c.flatten()
                lo, hi = (item.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2))
                sizes = np.nan_to_num(c.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
                base = np.repeat(off[:-1], sizes)
                edge = np.zeros(len(data) + 1, dtype=np.int32)
                np.add.at(edge, base + lo, 1)
                np.add.at(edge, base + hi + SPAN, -1)
                gone = np.cumsum(edge[:-1]) > 0
                begin = gone.copy()
                begin[1:] &= ~gone[:-1]
                head = off[:-1][off[:-1] < len(data)]
                begin[head] = gone[head]  # a run never crosses documents
                parts = [data[x:y][~gone[x:y]].tobytes() for x, y in zip(off[:-1].tolist(), off[1:].tolist())]
                cols = [b.column(0).slice(first, end - first), pa.array(np.diff(off)), pa.array(K.per_doc(gone, off)), pa.array(K.per_doc(begin, off)), pa.array([hashlib.sha256(p).hexdigest() for p in parts])]
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                if with_text:
                    cols.append(pa.array(parts, type=pa.binary()))
                    names.append("kept")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    docs = stable(docs)
    kind = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    both = _scan(docs, text).withColumn("doc_id", F.col("doc_id").cast("long")).join(spans(docs, text), "row", "left")
    return both.select("doc_id", "text", "cut").mapInArrow(run, kind)
