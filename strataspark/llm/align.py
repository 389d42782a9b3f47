"""Cross-tokenizer alignment: where the tokens of two tokenizers end together, and how common each pair of such tokens is.

Both tokenizers see the same bytes, a space and the text. A document's byte offsets at which a token ends are one rising list
for each tokenizer. The shorter list drives: each of its ends is sought in the longer one from a guessed rank by doubling steps
(either way) and then by halving the bracket, all ends of a buffer at once. Common ends cut both token lists into groups; the
differences of their ranks are the groups' lengths in tokens.

Tokens: texts are cut before white space where neither tokenizer can join across (before a space or line feed behind a character
that is certainly not white space), so a segment's tokens do not depend on its neighbours, and each distinct segment is encoded
once a worker (its bytes are compared at each use). A model with pieces that reach across such a place gets whole texts.

Scale: one Arrow map over the texts writes a row per document and, per block of about BLOCK bytes of text, the distinct id pairs
with their counts; a document's links are numbers of its block's pairs. Pairs are summed over the corpus by Spark, and each
block gets its own pairs' sums back in a co-group by block: no table of all pairs is sent anywhere, and no row is made per link.
A task holds a block, or one longer document.

Defined cases: texts that are null, empty, or that one of the tokenizers does not give back byte by byte have no tokens: zeros and
an empty string; special tokens' strings inside texts are text; repeated rows are documents of their own and count each; an empty
table gives no rows; the input's other columns play no part.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataspark.llm import kernels as K
from strataspark.llm.shared import table

BUFFER = 1 << 19  # bytes of text that are aligned at once
BLOCK = 1 << 23  # bytes of text whose pairs are counted together
KNOWN_SEGMENTS = 400_000  # segments whose ids a Python worker remembers
KNOWN_BYTES = 1 << 24
#: Lead bytes of characters that are certainly not white space for either tokenizer.
_SURE = np.zeros(256, dtype=bool)
_SURE[0x21:0x7F] = _SURE[0xC3:0xE0] = _SURE[0xE4:0xF5] = True


def gather(bounds: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The indices of the runs ``at`` of a flat array (run i is bounds[i]:bounds[i + 1]), and the runs' sizes."""
    size = bounds[at + 1] - bounds[at]
    return np.repeat(bounds[at] - (np.cumsum(size) - size), size) + np.arange(int(size.sum())), size


def gallop(short: np.ndarray, long: np.ndarray, guess: np.ndarray) -> np.ndarray:
    """For each of ``short`` the first place in ``long`` (rising) that is not less, from a guessed place by doubling steps and then
    by halving. The last of ``long`` is not less than any of ``short``."""
    up = long[guess] < short
    low, high = np.where(up, guess + 1, 0), np.where(up, len(long) - 1, guess)
    step, open_ = 1, np.arange(len(short))
    while len(open_):
        u = up[open_]
        probe = np.clip(np.where(u, guess[open_] + step, guess[open_] - step), 0, len(long) - 1)
        less = long[probe] < short[open_]
        low[open_[less]] = probe[less] + 1
        high[open_[~less]] = probe[~less]
        open_ = open_[(less == u) & ((probe > 0) | u)]
        step *= 2
    open_ = np.flatnonzero(low < high)
    while len(open_):
        mid = (low[open_] + high[open_]) // 2
        less = long[mid] < short[open_]
        low[open_[less]] = mid[less] + 1
        high[open_[~less]] = mid[~less]
        open_ = open_[low[open_] < high[open_]]
    return low


def common_ends(a: np.ndarray, b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` and ``b`` of the ends that both have. Both rise over all documents; ``first_*``: where each document
    begins, and the end. Each document's last ends are equal."""
    na, nb = np.diff(first_a), np.diff(first_b)
    found = []
    for flip in (False, True):
        drives = na > nb if flip else na <= nb
        sa, sb = np.flatnonzero(np.repeat(drives, na)), np.flatnonzero(np.repeat(drives, nb))
        if not len(sa):
            continue
        short, long, ns, nl = (b[sb], a[sa], nb[drives], na[drives]) if flip else (a[sa], b[sb], na[drives], nb[drives])
        doc = np.repeat(np.arange(len(ns)), ns)
        guess = (np.cumsum(nl) - nl)[doc] + (np.arange(len(short)) - (np.cumsum(ns) - ns)[doc]) * nl[doc] // ns[doc]
        at = gallop(short, long, guess)
        hit = np.flatnonzero(long[at] == short)
        found.append((sa[at[hit]], sb[hit]) if flip else (sa[hit], sb[at[hit]]))
    if not found:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    ia, ib = (np.sort(np.concatenate(x)) for x in zip(*found))
    return ia, ib


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level piece stands for: printable ones for themselves, the others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Aligner:
    """Ids of two tokenizers for the segments of texts. ``path_a``: a byte-level model of the tokenizers library, ``path_b``: a
    sentencepiece model that adds a space."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        decode = byte_level()
        vocab = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = {i: bytes(decode[c] for c in p) if all(c in decode for c in p) else p.encode() for p, i in vocab.items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
        self.len_a = np.zeros(max(self.bytes_a) + 1, dtype=np.int64)
        self.len_a[list(self.bytes_a)] = [len(x) for x in self.bytes_a.values()]
        self.len_b = np.array([len(x) for x in self.bytes_b], dtype=np.int64)
        #: Cutting before spaces and line feeds is right if no piece of b has one behind another character, nor a line feed at all.
        self.cuts = not any(re.search("[^▁]▁|\n", p) for p in pieces) and len(self.b.encode("\n")) == 2
        digits = [str(i) for i in range(max(len(self.len_a), len(self.len_b)))]
        self.digits = np.array([list(d.ljust(len(digits[-1])).encode()) for d in digits], dtype=np.uint8)
        self.n_digits = np.array([len(d) for d in digits], dtype=np.int64)
        self.forget()

    def forget(self) -> None:
        self.keys, self.at, self.n = np.empty(0, dtype=K.U64), np.empty(0, dtype=np.int64), 0
        self.flat = {k: np.empty(0, dtype=np.uint8 if k == "raw" else np.int32) for k in ("a", "b", "raw")}
        self.bounds = {k: np.zeros(1, dtype=np.int64) for k in self.flat}
        self.good = np.empty(0, dtype=bool)

    def encode(self, segments: list[bytes]) -> Iterator[tuple[list[int], list[int]]]:
        texts = [s.decode("utf-8", "replace") for s in segments]
        one = self.a.encode_batch_fast(texts, add_special_tokens=False)
        # Behind a line feed, which joins nothing, the model's own space is a token of its own.
        two = (x[2:] for x in self.b.encode(["\n" + t for t in texts])) if self.cuts else self.b.encode([t[1:] for t in texts])
        for x, y in zip(one, two):
            yield x.ids, y

    def learn(self, segments: list[bytes]) -> np.ndarray:
        """Remember the segments' ids; their numbers."""
        ids_a, ids_b, sizes, good = [], [], {"a": [], "b": [], "raw": []}, []
        for s, (x, y) in zip(segments, self.encode(segments)):
            ids_a += x
            ids_b += y
            for k, v in (("a", x), ("b", y), ("raw", s)):
                sizes[k].append(len(v))
            good.append(b"".join([self.bytes_a[i] for i in x]) == s == b"".join([self.bytes_b[i] for i in y]))
        for k, v in (("a", np.array(ids_a, dtype=np.int32)), ("b", np.array(ids_b, dtype=np.int32)), ("raw", np.frombuffer(b"".join(segments), dtype=np.uint8))):
            self.flat[k] = np.concatenate([self.flat[k], v])
            self.bounds[k] = np.concatenate([self.bounds[k], self.bounds[k][-1] + np.cumsum(np.array(sizes[k], dtype=np.int64))])
        self.good = np.concatenate([self.good, np.array(good, dtype=bool)])
        self.n += len(segments)
        return np.arange(self.n - len(segments), self.n)

    def segments(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the segments (and the end), and each document's first one (and the end)."""
        begins = np.zeros(len(data) + 1, dtype=bool)
        begins[off] = True
        if self.cuts and len(data):
            at = np.flatnonzero((data == 32) | (data == 10))
            at = at[at > 0]
            lead = data[at - 1]
            for back in (2, 3, 4):
                lead = np.where((lead >= 0x80) & (lead < 0xC0), data[np.maximum(at - back, 0)], lead)
            begins[at[_SURE[lead]]] = True
        begins[-1] = True
        starts = np.flatnonzero(begins)
        return starts, np.searchsorted(starts, off)

    def numbers(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The number of each segment; those that are not known yet are learnt."""
        if len(starts) < 2:
            return np.empty(0, dtype=np.int64)
        keys, first, back = np.unique(K.Rolling(data, 5).of(starts[:-1], starts[1:]), return_index=True, return_inverse=True)
        raw = data.tobytes()
        if self.n > KNOWN_SEGMENTS or len(self.flat["raw"]) > KNOWN_BYTES:
            self.forget()
        place = np.searchsorted(self.keys, keys)
        new = np.append(self.keys, K.U64(0))[place] != keys if len(self.keys) else np.ones(len(keys), dtype=bool)
        new |= place == len(self.keys)
        if new.any():
            got = self.learn([raw[s:e] for s, e in zip(starts[first[new]].tolist(), starts[first[new] + 1].tolist())])
            self.keys, self.at = np.insert(self.keys, place[new], keys[new]), np.insert(self.at, place[new], got)
        out = self.at[np.searchsorted(self.keys, keys)][back]
        # Segments tile the buffer, so do the known bytes if all keys stand for the segments they were learnt from.
        size = np.diff(starts)
        same = self.bounds["raw"][out + 1] - self.bounds["raw"][out] == size
        if same.all():
            wrong = np.flatnonzero(self.flat["raw"][gather(self.bounds["raw"], out)[0]] != data)
            same[np.searchsorted(starts, wrong, side="right") - 1] = False
        else:
            same = np.array([self.flat["raw"][self.bounds["raw"][o] : self.bounds["raw"][o + 1]].tobytes() == raw[s:e] for o, s, e in zip(out.tolist(), starts[:-1].tolist(), starts[1:].tolist())])
        if not same.all():
            odd = np.flatnonzero(~same)
            out[odd] = self.learn([raw[s:e] for s, e in zip(starts[odd].tolist(), starts[odd + 1].tolist())])
        return out

    def align(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """Per document: tokens of a, tokens of b, groups, and the groups' digest; and the pairs (a << 32 | b) of all links in order."""
        some = np.diff(off) > 0
        data = np.insert(data, off[:-1][some], 32)
        off = off + np.concatenate([[0], np.cumsum(some)])
        starts, first = self.segments(data, off)
        at = self.numbers(data, starts)
        docs = len(off) - 1
        doc = np.repeat(np.arange(docs), np.diff(first))
        fine = np.ones(docs, dtype=bool)
        fine[doc[~self.good[at]]] = False
        at, doc = at[fine[doc]], doc[fine[doc]]
        ids, per = {}, {}
        for k in ("a", "b"):
            index, size = gather(self.bounds[k], at)
            ids[k], per[k] = self.flat[k][index].astype(np.int64), np.bincount(doc, weights=size, minlength=docs).astype(np.int64)
        live = per["a"] > 0
        first_a, first_b = (np.concatenate([[0], np.cumsum(per[k][live])]) for k in ("a", "b"))
        ia, ib = common_ends(np.cumsum(self.len_a[ids["a"]]), np.cumsum(self.len_b[ids["b"]]), first_a, first_b)
        groups = np.zeros(docs, dtype=np.int64)
        groups[live] = np.diff(np.searchsorted(ia, first_a))
        digests = np.full(docs, "", dtype=object)
        digests[live] = self.digests(ids["a"], ids["b"], ia, ib, first_a, first_b)
        return per["a"], per["b"], groups, ids["a"][ia] << 32 | ids["b"][ib], digests.tolist()

    def digests(self, a: np.ndarray, b: np.ndarray, ia: np.ndarray, ib: np.ndarray, first_a: np.ndarray, first_b: np.ndarray) -> list[str]:
        """sha256 of ``a1,a2|b1;a3|b2,b3`` of each document: a token of a stands behind all groups' earlier tokens of both lists."""
        ra, rb = np.diff(ia, prepend=-1), np.diff(ib, prepend=-1)  # tokens of each group
        all_ids, mark = np.empty(len(a) + len(b), dtype=np.int64), np.full(len(a) + len(b), ord(","), dtype=np.uint8)
        to_a, to_b = np.arange(len(a)) + np.repeat(ib + 1 - rb, ra), np.arange(len(b)) + np.repeat(ia + 1, rb)
        all_ids[to_a], all_ids[to_b] = a, b
        mark[to_a[ia]], mark[to_b[ib]] = ord("|"), ord(";")
        size = self.n_digits[all_ids] + 1
        end = np.cumsum(size)
        out = np.empty(int(end[-1]) if len(end) else 0, dtype=np.uint8)
        begin = end - size
        for k in range(self.digits.shape[1]):
            some = np.flatnonzero(size > k + 1)
            out[begin[some] + k] = self.digits[all_ids[some], k]
        out[end - 1] = mark
        cut = np.concatenate([[0], end])[first_a + first_b]
        raw = out.tobytes()
        return [hashlib.sha256(raw[s : e - 1]).hexdigest() for s, e in zip(cut[:-1].tolist(), cut[1:].tolist())]


_LOADED: dict[tuple[str, str], Aligner] = {}
_ROW = "block string, doc_id long, row long, n_a long, n_b long, n_groups long, groups_sha256 string, links binary, pair long, k long"


def blocks(docs: DataFrame, path_a: str, path_b: str, text: str = "text", size: int = BLOCK) -> DataFrame:
    """A row per document (with its links as numbers of its block's pairs, in the pairs' order) and one per block and pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al = _LOADED.get((path_a, path_b)) or _LOADED.setdefault((path_a, path_b), Aligner(path_a, path_b))
        schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (c.split(" ") for c in _ROW.split(", "))])

        def flush() -> Iterator[pa.RecordBatch]:
            name = f"{held[0][1][0].as_py()}"  # the first document's row number
            pairs, at, k = np.unique(np.concatenate([h[5] for h in held]), return_inverse=True, return_counts=True)
            at = at.astype("<u4")
            for ids, rows, na, nb, groups, links, digests in held:
                own, at = at[: len(links)], at[len(links) :]
                ends = np.cumsum(groups)
                packed = [pa.compress(own[e - g : e].tobytes(), codec="zstd", asbytes=True) for e, g in zip(ends.tolist(), groups.tolist())]
                n = len(rows)
                cols = [pa.array([name] * n, pa.string()), ids, rows, pa.array(na), pa.array(nb), pa.array(groups), pa.array(digests, pa.string()), pa.array(packed, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, schema=schema)
            n = len(pairs)
            none = [pa.nulls(n, f.type) for f in schema][1:8]
            yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), *none, pa.array(pairs), pa.array(k.astype(np.int64))], schema=schema)

        held, read = [], 0
        for batch in batches:
            for lo, hi, data, off in K.chunks(batch.column(2), BUFFER):
                held.append((batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), *al.align(data, off)))
                read += len(data)
                if read >= size:
                    yield from flush()
                    held, read = [], 0
        if held:
            yield from flush()

    return docs.select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("row"), F.col(text).cast("string").alias("text")).mapInArrow(run, _ROW)


def pair_counts(pairs: DataFrame) -> DataFrame:
    """pair, count (links that hold it), best (no pair with the same id of b has more)."""
    sums = table(pairs.groupBy("pair").agg(F.sum("k").alias("count")).withColumn("b", F.expr("cast(pair & 4294967295 as int)")), "sums")
    most = sums.groupBy("b").agg(F.max("count").alias("most"))
    return sums.join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def _look_up(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    order = np.argsort(pairs.column("pair").to_numpy())
    count, best = pairs.column("count").to_numpy()[order], pairs.column("best").to_numpy(zero_copy_only=False)[order]
    groups = docs.column("n_groups").to_pylist()
    n_best, total = [], []
    for raw, n in zip(docs.column("links"), groups):
        at = np.frombuffer(pa.decompress(raw.as_py(), decompressed_size=4 * n, codec="zstd", asbytes=True), dtype="<u4") if n else np.empty(0, dtype=np.int64)
        n_best.append(int(best[at].sum()))
        total.append(int(count[at].sum()))
    out = docs.select(["doc_id", "n_a", "n_b", "n_groups"])
    for name, values in (("n_links", groups), ("n_best", n_best), ("count_sum", total)):
        out = out.append_column(name, pa.array(values, pa.int64()))
    return out.append_column("groups_sha256", docs.column("groups_sha256"))


def align_tokens(docs: DataFrame, path_a: str, path_b: str, text: str = "text", size: int = BLOCK) -> DataFrame:
    """A row per document: doc_id, n_a, n_b (tokens), n_groups, n_links, n_best (links whose pair is the commonest of its id of b),
    count_sum (how often the links' pairs are linked in the corpus, summed), groups_sha256."""
    every = table(blocks(docs, path_a, path_b, text, size), "aligned")
    pairs = every.where("pair is not null").select("block", "pair", "k")
    counts = table(pair_counts(pairs), "pair_counts")
    # Read a second time: the sides of a co-group must not share columns by their inner names.
    again = every.sparkSession.read.schema(every.schema).parquet(every.shared_path)
    known = again.where("pair is not null").select("block", "pair").join(counts, "pair").select("block", "pair", "count", "best")
    aligned = every.where("pair is null").select("block", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links")
    kind = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return aligned.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_look_up, kind)
