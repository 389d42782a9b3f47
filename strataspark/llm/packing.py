"""Packing documents into fixed windows by multiway Karmarkar-Karp differencing.

A document's ids are cut into full windows and tail pieces; each shard of pieces (a hash bucket of bounded expected
size) is split into the smallest possible number of windows by the differencing method: every piece starts as a partial
partition with one filled window, and the two partitions with the largest imbalance are merged again and again, the
fullest window of one with the emptiest of the other. If a window of the result exceeds the capacity, the number of
windows rises by one and the shard is split anew, so windows end near-equal and never overfull.

Only piece metadata is shuffled; ids are made, cut and summed in one Arrow map over the scan, whose result is written once
and counted, so that the number of shards follows from the pieces there are. A worker's memory is bounded by its buffers
(BUFFER bytes of text, or one longer document), slices of SLICE words in the tokenizer and a word memory of KNOWN_WORDS.

Defined cases: a null or empty text is a document of the end id alone; repeated rows are packed as separate documents
(``copy`` tells them apart); an empty table gives no rows; the input's other columns play no part.
"""

from __future__ import annotations

import heapq
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataspark.llm import kernels as K
from strataspark.llm.shared import table

WINDOW = 2048
TAIL = 256
SHARD = 2048
END = 1
BUFFER = 1 << 18  # bytes of text a worker encodes at once
SLICE = 100  # words in one call of the tokenizer
_CLOSING = np.zeros(256, dtype=bool)
_CLOSING[list(b".,;:!?%&*$#|")] = True
_ASCII_WORD = np.zeros(256, dtype=bool)
_ASCII_WORD[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True
_LETTERS = np.zeros(256, dtype=bool)
_LETTERS[97:123] = True
KNOWN_WORDS = 500_000  # words whose ids a Python worker remembers


class WordIds:
    """Ids of whitespace-separated words. The tokenizer drops white space and never joins across it, so a document's ids
    are its words' ids in order, and each distinct word is encoded once per worker."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        self.tokenizer = Tokenizer.from_file(path)
        self.forget()

    def forget(self) -> None:
        self.keys = np.empty(0, dtype=K.U64)
        self.at = np.empty(0, dtype=np.int64)
        self.flat = np.empty(0, dtype=np.uint32)
        self.bounds = np.zeros(1, dtype=np.int64)

    def ids_of(self, words: list[str], plain: np.ndarray) -> Iterator[list[int]]:
        """Each word's ids. ``plain`` words, of the letters a to z alone, pass the tokenizer's normalizer and splitter
        unchanged and as one, so they go to its model at once; the others through all of it, a slice at a time."""
        other = [w for w, p in zip(words, plain.tolist()) if not p]
        slices = (other[i : i + SLICE] for i in range(0, len(other), SLICE))
        rest = (e.ids for s in slices for e in self.tokenizer.encode_batch_fast(s, add_special_tokens=False))
        model = self.tokenizer.model
        for w, p in zip(words, plain.tolist()):
            yield [t.id for t in model.tokenize(w)] if p else next(rest)

    def learn(self, keys: np.ndarray, words: list[str], plain: np.ndarray) -> None:
        size = np.empty(len(words), dtype=np.int64)

        def flat() -> Iterator[int]:
            for k, ids in enumerate(self.ids_of(words, plain)):
                size[k] = len(ids)
                yield from ids

        self.flat = np.concatenate([self.flat, np.fromiter(flat(), dtype=np.uint32)])
        at = np.arange(len(keys)) + len(self.bounds) - 1
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(size)])
        order = np.argsort(keys)
        place = np.searchsorted(self.keys, keys[order])
        self.keys, self.at = np.insert(self.keys, place, keys[order]), np.insert(self.at, place, at[order])

    def units(self, data: np.ndarray, w: K.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the units to encode, each document's first one, and the bytes. A unit is a word, or its body
        and its closing punctuation: the tokenizer splits there too, and lowers letters, so that fewer units differ.
        Words that may hold a special token ("<") stay as they are."""
        tag = K.per_doc_range(data == 60, w.start, w.end) > 0
        low = K.lower(data)
        for s, e in zip(w.start[tag].tolist(), w.end[tag].tolist()):
            low[s:e] = data[s:e]
        body = np.where(_CLOSING[data], -1, np.arange(len(data)))
        last = np.maximum.accumulate(body)[w.end - 1] + 1 if len(w.end) else w.end
        before = low[np.maximum(last - 1, 0)]
        # Only after a letter or digit that is one for sure: other marks would be of one piece with the closing ones.
        sure = _ASCII_WORD[before] | ((low[np.maximum(last - 2, 0)] == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7))
        cut = (last > w.start) & (last < w.end) & sure & ~tag
        n = np.cumsum(cut) - cut
        at = np.arange(len(w.start)) + n
        start, end = np.empty(len(at) + int(cut.sum()), dtype=np.int64), np.empty(len(at) + int(cut.sum()), dtype=np.int64)
        start[at], end[at] = w.start, np.where(cut, last, w.end)
        start[at[cut] + 1], end[at[cut] + 1] = last[cut], w.end[cut]
        first = w.first + np.concatenate([[0], np.cumsum(cut)])[w.first]
        return start, end, first, low

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a buffer's documents, each closed by END, and the document bounds."""
        w = K.Words(data, off)
        start, end, first_unit, data = self.units(data, w)
        h = K.Rolling(data, 3).of(start, end)
        keys, first, back = np.unique(h, return_index=True, return_inverse=True)
        for _ in range(2):
            place = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
            new = self.keys[place] != keys if len(self.keys) else np.ones(len(keys), dtype=bool)
            if not new.any():
                break
            if len(self.keys) + int(new.sum()) > KNOWN_WORDS:
                self.forget()
                new[:] = True
            raw, s0, e0 = data.tobytes(), start[first[new]], end[first[new]]
            plain = K.per_doc_range(_LETTERS[data], s0, e0) == e0 - s0
            self.learn(keys[new], [raw[s:e].decode("utf-8", "replace") for s, e in zip(s0.tolist(), e0.tolist())], plain)
        at = self.at[place][back] if len(back) else np.empty(0, dtype=np.int64)
        size = self.bounds[at + 1] - self.bounds[at]
        per = np.zeros(len(off), dtype=np.int64)
        np.cumsum(K.per_doc(size, first_unit) + 1, out=per[1:])
        out = np.empty(per[-1], dtype=np.uint32)
        # Unit i of document d goes to the running sum of sizes, shifted by the ends before it.
        to = np.cumsum(size) - size + np.repeat(np.arange(len(off) - 1), np.diff(first_unit))
        step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(to, size) + step] = self.flat[np.repeat(self.bounds[at], size) + step]
        out[per[1:] - 1] = END
        return out, per


_LOADED: dict[str, WordIds] = {}


def pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, tail: int = TAIL, text: str = "text", with_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, copy, start, length, ids_crc32, doc_tokens (and ids, on request)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _LOADED.get(tokenizer) or _LOADED.setdefault(tokenizer, WordIds(tokenizer))
        for b in batches:
            for lo, hi, data, off in K.chunks(b.column(2), BUFFER):
                ids, per = enc.encode(data, off)
                ids = ids.astype("<u4")
                raw = ids.view(np.uint8)
                rows, starts = [], []
                for d in range(hi - lo):
                    n = int(per[d + 1] - per[d])
                    full = n // window * window
                    cut = [*range(0, full, window), *range(full, n, tail)]
                    rows += [d] * len(cut)
                    starts += cut
                rows, starts = np.array(rows, dtype=np.int64), np.array(starts, dtype=np.int64)
                total = np.diff(per)[rows]
                length = np.minimum(np.where(starts + window <= total, window, tail), total - starts)
                at = per[:-1][rows] + starts
                crc = np.fromiter((zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(at.tolist(), (at + length).tolist())), dtype=np.int64, count=len(at))
                take = pa.array(rows)
                cols = [b.column(0).slice(lo, hi - lo).take(take), b.column(1).slice(lo, hi - lo).take(take), pa.array(starts), pa.array(length), pa.array(crc), pa.array(total)]
                names = ["doc_id", "copy", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    cols.append(pa.array([ids[s:e].astype(np.int64) for s, e in zip(at.tolist(), (at + length).tolist())], type=pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    kind = "doc_id long, copy long, start long, length long, ids_crc32 long, doc_tokens long" + (", ids array<long>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("copy"), F.col(text).cast("string").alias("text")).mapInArrow(run, kind)


def difference(sizes: np.ndarray, k: int) -> np.ndarray:
    """The window of every item when the items are split into k near-equal windows by multiway differencing."""
    n = len(sizes)
    if k == 1:
        return np.zeros(n, dtype=np.int64)
    sums, parts, heap = {}, {}, []
    for i in range(n):
        heap.append((-int(sizes[i]), i))
    heapq.heapify(heap)
    made = n
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        one, two = (sums.pop(x) if x >= n else np.array([sizes[x]], dtype=np.int64) for x in (a, b))
        # Sums are kept in falling order without trailing zeros; the fullest of one meets the emptiest of the other.
        x = np.zeros(k, dtype=np.int64)
        x[: len(one)] = one
        y = np.zeros(k, dtype=np.int64)
        y[k - len(two) :] = two[::-1]
        total = x + y
        order = np.argsort(-total, kind="stable")
        total = total[order]
        filled = int(np.count_nonzero(total))
        low = int(total[-1])  # a level that all windows share tells nothing about imbalance
        sums[made], parts[made] = total[:filled], (a, b, order)
        heapq.heappush(heap, (low - int(total[0]), made))
        made += 1
    out = np.empty(n, dtype=np.int64)
    stack = [(heap[0][1], np.arange(k))]
    while stack:
        node, slot = stack.pop()  # slot[j]: the final window of the node's j-th fullest
        if node < n:
            out[node] = slot[0]
            continue
        a, b, order = parts.pop(node)
        at = np.empty(k, dtype=np.int64)
        at[order] = slot
        stack.append((a, at))
        stack.append((b, at[::-1]))
    return out


def windows(sizes: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(window, offset) of every item; windows hold at most ``window`` and are as few as differencing allows."""
    out, offset = np.empty(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
    full = sizes >= window
    out[full] = np.arange(full.sum())
    rest = np.flatnonzero(~full)
    if len(rest):
        small = sizes[rest]
        k = max(1, -(-int(small.sum()) // window))
        while True:
            got = difference(small, k)
            if np.bincount(got, weights=small, minlength=k).max() <= window:
                break
            k += 1
        out[rest] = got + int(full.sum())
        order = rest[np.lexsort((np.arange(len(rest)), got))]
        run = np.cumsum(sizes[order]) - sizes[order]
        first = np.r_[True, out[order][1:] != out[order][:-1]]
        offset[order] = run - np.maximum.accumulate(np.where(first, run, 0))
    _, dense = np.unique(out, return_inverse=True)
    return dense, offset


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, tail: int = TAIL, shard: int = SHARD, text: str = "text", with_ids: bool = False) -> DataFrame:
    """Every piece with its ``sequence_id`` and ``offset``. ``shard`` is the expected number of pieces differenced together."""
    cut = table(pieces(docs, tokenizer, window, tail, text, with_ids), "pieces")
    shards = max(1, cut.count() // shard)
    keyed = cut.withColumn("shard", F.pmod(F.xxhash64("copy", "start"), F.lit(shards)))

    def fill(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["copy", "start"], ignore_index=True)
        seq, offset = windows(pdf["length"].to_numpy(), window)
        return pdf.drop(columns="shard").assign(sequence_id=(int(key[0]) << 32) + seq, offset=offset)

    kind = cut.schema.simpleString()[7:-1].replace(":", " ").replace("array<bigint>", "array<long>")
    return keyed.groupBy("shard").applyInPandas(fill, f"{kind}, sequence_id long, offset long")
