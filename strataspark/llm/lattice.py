"""Language-model scores from a subword lattice.

The pieces are those of an existing public subword vocabulary. A word (closed by an end-of-word step) is spelt by every
path of pieces, single characters included; the weights of all segmentations are summed in log space by the forward
recursion, so a word's score is its marginal probability over segmentations, and a text's score is the sum over its
words and its end, since no piece spans white space. The vocabulary's own scores (its ranks) give the first piece
probabilities; expectation-maximisation over the words of the training documents, each as often as it occurs, adapts them.
Every word is scored by this marginal, whether the training documents hold it or not. ``mixture_score`` is a further
column: there a word that the training documents hold has one more path, the word as a single unit, whose mass follows its
count; the share of mass kept for the spelt paths is that of words seen once (Good and Turing).

Scale: counting is a map-side count per batch and one aggregation by word. Words, not texts, go through the lattice, each
once an iteration. Scores reach the texts by chunks of documents (a hash of the row, about CHUNK bytes of text each): a
chunk's distinct words are joined to the word table and meet the chunk's texts in one task. What returns to the driver is
bounded by the vocabulary (its expected counts), never by the corpus.

Defined cases: null and empty texts are the end alone; repeated rows are counted and scored as often as they occur; a null
doc_id counts as held out (it has no checksum); an empty training set scores by the vocabulary's own ranks; words of more than
LONG characters go through the same recursion by slices of positions, in bounded memory (where probabilities are learnt, they
count as words of LONG characters); other columns play no part.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataspark.llm.shared import stable, table

ITERATIONS = 2
CHUNK = 12 << 20
LONG = 4096  # characters of a word from which its lattice is not built at once
FLUSH = 400_000  # distinct words a counting task holds before it emits them
LETTERS = 1 << 21  # the flat alphabet behind single characters: code points and the end of a word
FLOOR = 1e-4  # share of mass for single characters that are no pieces


def _split(text: bytes) -> list[bytes]:
    """Words of a text with A-Z in lower case; bytes.split and bytes.lower know ASCII white space and letters only."""
    return text.lower().split()


def train_column(doc_id: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(7)) != 2, F.lit(False))


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """word, c: how often the training documents hold each word of the corpus (words of other documents count 0 times)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(list(seen), type=pa.binary()), pa.array(list(seen.values()), type=pa.int64())], names=["word", "c"])
            seen.clear()
            return b

        for b in batches:
            for x, train in zip(b.column(0), b.column(1).to_pylist()):
                words = _split((x.as_py() or "").encode())
                seen.update(words if train else dict.fromkeys(words, 0))
                if len(seen) > FLUSH:
                    yield out()
        yield out()

    return docs.select(F.col(text).cast("string").alias("text"), "train").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Pieces:
    """The piece table: strings by their 64-bit hash, their log probabilities, and the length of the longest."""

    def __init__(self, names: list[str], logp: np.ndarray):
        self.names, self.logp = names, logp
        code, length = codes(names)
        self.longest = int(length.max(initial=1))
        self.key = _hashes(code, length)[np.arange(len(names)), 0, length - 1]
        order = np.argsort(self.key)
        self.key, self.order = self.key[order], order

    def weights(self, h: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece number or -1, log weight) of every substring (word, start, length - 1)."""
        at = np.minimum(np.searchsorted(self.key, h), len(self.key) - 1)
        hit = self.key[at] == h
        i = np.where(hit, self.order[at], -1)
        w = np.where(hit, self.logp[self.order[at]], -np.inf)
        single = w[:, :, 0]
        w[:, :, 0] = np.logaddexp(single, np.log(FLOOR / LETTERS))
        n = h.shape[1]
        start, size = np.arange(n)[None, :, None], np.arange(1, h.shape[2] + 1)[None, None, :]
        beyond = start + size > length[:, None, None]
        w[beyond] = -np.inf
        i[beyond] = -1
        return i, w


def codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of words, padded with zeros, and the words' lengths."""
    length = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out = np.zeros((len(words), max(1, int(length.max(initial=1)))), dtype=np.uint32)
    out[np.arange(out.shape[1])[None, :] < length[:, None]] = flat
    return out, length


def _hashes(code: np.ndarray, length: np.ndarray | None, longest: int | None = None) -> np.ndarray:
    """Hash of every substring (of up to ``longest`` characters) by (word, start, length - 1)."""
    n, m = code.shape
    out = np.zeros((n, m, min(longest or m, m)), dtype=np.uint64)
    run = np.zeros((n, m), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(out.shape[2]):
            run[:, : m - k] = (run[:, : m - k] ^ (code[:, k:].astype(np.uint64) + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
            run[:, : m - k] ^= run[:, : m - k] >> np.uint64(29)
            out[:, :, k] = run
    return out


def forward(w: np.ndarray, length: np.ndarray, stop: float) -> tuple[np.ndarray, np.ndarray]:
    """(log marginal of each word, forward log sums): log space, over all segmentations; ``stop`` is the log weight of going on or ending."""
    n, m, k = w.shape
    a = np.full((n, m + 1), -np.inf)
    a[:, 0] = 0
    for j in range(1, m + 1):
        terms = np.stack([a[:, j - s] + w[:, j - s, s - 1] for s in range(1, min(k, j) + 1)])
        top = terms.max(axis=0)
        safe = np.where(np.isfinite(top), top, 0)
        with np.errstate(divide="ignore"):
            a[:, j] = safe + np.log(np.exp(terms - safe).sum(axis=0))
    return a[np.arange(n), length] + stop, a


def forward_long(pieces: Pieces, word: str, stop: float, size: int = 1 << 16) -> float:
    """As ``forward``, of one word of any length: the lattice of ``size`` positions at a time, and the sums of the positions
    that the pieces begun so far can reach."""
    code, length = codes([word])
    k, here = pieces.longest, 0.0
    ahead = np.full(k, -np.inf)
    for lo in range(0, int(length[0]), size):
        part = code[:, lo : lo + size + k]
        _, w = pieces.weights(_hashes(part, None, k), np.array([part.shape[1]]))
        if w.shape[2] < k:
            w = np.pad(w, ((0, 0), (0, 0), (0, k - w.shape[2])), constant_values=-np.inf)
        for step in w[0, : min(size, int(length[0]) - lo)]:
            ahead = np.logaddexp(ahead, here + step)
            here = ahead[0]
            ahead = np.append(ahead[1:], -np.inf)
    return float(here) + stop


def expected(w: np.ndarray, i: np.ndarray, a: np.ndarray, length: np.ndarray, count: np.ndarray, out: np.ndarray) -> float:
    """Add each piece's expected uses in the counted words to ``out``; returns the expected number of pieces."""
    n, m, k = w.shape
    b = np.full((n, m + 1), -np.inf)
    b[np.arange(n), length] = 0
    total, uses = a[np.arange(n), length], 0.0
    for j in range(m - 1, -1, -1):
        terms = np.stack([w[:, j, s - 1] + b[:, j + s] for s in range(1, min(k, m - j) + 1)], axis=1)
        top = terms.max(axis=1)
        safe = np.where(np.isfinite(top), top, 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            here = safe + np.log(np.exp(terms - safe[:, None]).sum(axis=1))
            post = np.exp(a[:, j, None] + terms - total[:, None]) * count[:, None]
        post[~np.isfinite(post)] = 0
        b[:, j] = np.where(j < length, here, b[:, j])
        ids = i[:, j, : post.shape[1]]
        got = ids >= 0
        np.add.at(out, ids[got], post[got])
        uses += float(post.sum())
    return uses


def vocabulary(path: str) -> tuple[list[str], np.ndarray]:
    """Distinct strings of a subword model's pieces (word marks off, A-Z lowered) and log weights by its scores: the models
    at hand score a piece by its rank, which stands for a probability of 1 / (rank + 10), the usual law of such lists."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    best: dict[str, float] = {}
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i in range(sp.get_piece_size()):
        if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i):
            continue
        name = sp.id_to_piece(i).replace("▁", "").translate(low)
        if name:
            best[name] = max(best.get(name, -1e18), sp.get_score(i))
    names = sorted(best, key=lambda x: (-best[x], x))
    p = 1.0 / (np.arange(len(names)) + 10.0)
    return names, np.log(p / p.sum() * (1 - FLOOR))


def _batches(text: list[str], limit: int = 40_000) -> Iterator[tuple[np.ndarray, list[str]]]:
    """(places, words) of similar length, at most ``limit`` characters of padded lattice a batch."""
    order = np.argsort(np.fromiter(map(len, text), dtype=np.int64, count=len(text)), kind="stable")
    lo = 0
    while lo < len(order):
        hi = min(len(order), lo + max(1, limit // max(1, len(text[order[lo]]))))
        while hi > lo + 1 and len(text[order[hi - 1]]) * (hi - lo) > 2 * limit:
            hi = lo + (hi - lo) // 2
        yield order[lo:hi], [text[k] for k in order[lo:hi]]
        lo = hi


def _adapt(counts: DataFrame, names: list[str], logp: np.ndarray, stop: float) -> tuple[np.ndarray, float]:
    """One step of expectation-maximisation over all training words: new piece log probabilities and stop probability."""
    shared = counts.sparkSession.sparkContext.broadcast((names, logp + np.log1p(-min(stop, 1 - 1e-9))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(*shared.value)
        out, uses, n = np.zeros(len(pieces.names)), 0.0, 0
        for b in batches:
            n += int(b.column(1).to_numpy().sum())
            whole = [w.decode("utf-8", "replace") for w in b.column(0).to_pylist()]
            c = np.repeat(b.column(1).to_numpy(), [-(-len(w) // LONG) for w in whole])
            for at, words in _batches([w[j : j + LONG] for w in whole for j in range(0, len(w), LONG)]):
                code, length = codes(words)
                i, w = pieces.weights(_hashes(code, length, pieces.longest), length)
                _, a = forward(w, length, 0.0)
                uses += expected(w, i, a, length, c[at].astype(float), out)
        ids = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(ids, [-1, -2])), pa.array(np.append(out[ids], [uses, n]))], names=["piece", "uses"])

    got = counts.mapInArrow(run, "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).toPandas()  # at most a row a piece
    by = dict(zip(got["piece"], got["uses"]))
    uses, n = by.pop(-1, 0.0), by.pop(-2, 0.0)
    if not n:
        return logp, stop
    new = np.full(len(names), 0.01)
    for k, v in by.items():
        new[int(k)] += v
    return np.log(new / new.sum() * (1 - FLOOR)), n / uses


def score(docs: DataFrame, vocabulary_path: str, text: str = "text", iterations: int = ITERATIONS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, mixture_score of every document."""
    spark = docs.sparkSession
    # The row's number deals rows to chunks: repeated rows must not meet in one.
    d = stable(docs).withColumn("train", train_column()).withColumn("_row", F.monotonically_increasing_id())
    counts = table(word_counts(d.select(text, "train"), text), "counts")
    words, total, once = counts.agg(F.count_if(F.col("c") > 0), F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") == 1)).first()
    ends, all_bytes = d.agg(F.count_if("train"), F.coalesce(F.sum(F.octet_length(F.col(text).cast("string"))), F.lit(0))).first()
    n, v = total + ends, words + (ends > 0)
    names, logp = vocabulary(vocabulary_path)
    stop = 0.3  # the chance that a word ends after a piece, before it is learnt
    for _ in range(iterations):
        logp, stop = _adapt(counts.where("c > 0"), names, logp, stop)
    end_p = (ends + 1) / (n + 2)
    fresh = (once + 1) / (total + 2)  # mass of words not seen
    shared = spark.sparkContext.broadcast((names, logp + np.log1p(-min(stop, 1 - 1e-9)), np.log(stop) - np.log1p(-min(stop, 1 - 1e-9))))
    ln10 = np.log(10)

    chunks = max(1, all_bytes // CHUNK)
    keyed = d.select(F.col("doc_id").cast("long").alias("doc_id"), (~F.col("train")).alias("held_out"), F.col(text).cast("string").alias("text"), "_row").withColumn("chunk", F.pmod(F.xxhash64("_row"), F.lit(chunks)))

    def vocab_of(key: tuple, t: pa.Table) -> pa.Table:
        seen: set = set()
        for x in t.column("text"):
            seen.update(_split((x.as_py() or "").encode()))
        return pa.table({"chunk": pa.array([key[0].as_py()] * len(seen), type=pa.int64()), "word": pa.array(list(seen), type=pa.binary())})

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces_names, lp, last = shared.value
        pieces = Pieces(pieces_names, lp)
        for b in batches:
            c = b.column(1).to_numpy(zero_copy_only=False)
            out = np.empty(len(c))
            for at, ws in _batches([w.decode("utf-8", "replace") for w in b.column(0).to_pylist()]):
                if len(ws[0]) > LONG:
                    out[at] = [forward_long(pieces, x, last) for x in ws]
                    continue
                code, length = codes(ws)
                _, w = pieces.weights(_hashes(code, length, pieces.longest), length)
                out[at], _ = forward(w, length, last)
            seen = np.log(np.maximum(c, 1) / max(total, 1)) + np.log1p(-fresh)
            mixed = np.where(c > 0, np.logaddexp(seen, out + np.log(fresh)), out + np.log(fresh)) + np.log1p(-end_p)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array((out + np.log1p(-end_p)) / ln10), pa.array(mixed / ln10)], names=["word", "c", "logp", "mixed"])

    need = keyed.groupBy("chunk").applyInArrow(vocab_of, "chunk long, word binary")
    scored = table(counts.mapInArrow(spell, "word binary, c long, logp double, mixed double"), "words")
    dictionary = need.join(scored, "word").select("chunk", "word", "c", "logp", "mixed")

    def rate(key: tuple, t: pa.Table, words: pa.Table) -> pa.Table:
        c = words.column("c").to_numpy()
        base = np.log10((c + 1) / (n + 1 * (v + 1)))
        look = dict(zip(words.column("word").to_pylist(), range(len(c))))
        lp, mx = words.column("logp").to_numpy(), words.column("mixed").to_numpy()
        out = []
        for x in t.column("text"):
            at = np.fromiter(map(look.__getitem__, _split((x.as_py() or "").encode())), dtype=np.int64)
            out.append((len(at) + 1, int((c[at] > 0).sum()) + (ends > 0), float(base[at].sum() + np.log10((ends + 1) / (n + 1 * (v + 1)))), float(lp[at].sum() + np.log10(end_p)), float(mx[at].sum() + np.log10(end_p))))
        cols = list(zip(*out)) if out else [[]] * 5
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
        a, k, bs, sc, ms = (pa.array(list(x), type=kind) for x, kind in zip(cols, kinds))
        return pa.table({"doc_id": t.column("doc_id"), "held_out": t.column("held_out"), "n_tokens": a, "n_known": k, "train_tokens": pa.array([n] * len(out), type=pa.int64()), "base_score": bs, "score": sc, "mixture_score": ms})

    return keyed.groupBy("chunk").cogroup(dictionary.groupBy("chunk")).applyInArrow(rate, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, mixture_score double")
