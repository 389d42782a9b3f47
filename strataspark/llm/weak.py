"""Quality classifier from weak labels.

Overlapping heuristic labellers, and the judged labels as one more, vote on every document (1 good, 0 bad, -1 no opinion).
Expectation-maximisation over the counts of vote patterns estimates how often each heuristic votes what on good and on bad
documents (Dawid and Skene), and so the posterior of every pattern. The judged labels' accuracy is given (TRUST), and a
judged document's posterior is that of its label: they say what good means. Left free, or outvoted by heuristics that are
not independent, the classes drift to what most heuristics measure, and toxic documents count as good. The posteriors of a bounded sample of documents, the
judged ones first, then train a linear scorer on hashed words, word beginnings and word endings, which scores every document.

Scale: votes and features come from Arrow maps over the scan; the pattern table has at most 3 ** labellers rows; the training
sample is at most SAMPLE documents, taken with a bounded top-k; it is trained in PARTS tasks whose weights, vectors of
2 ** BITS numbers, are averaged, so no features reach the driver. No other step shuffles a text.

Defined cases: null and empty texts get votes as texts without words and score the bias; a label that is null or missing is
no opinion; several labels of a document count as their minimum (any bad one is bad); repeated rows are separate rows;
a table without labels trains on the heuristics alone; an empty table gives no rows; other columns travel in ``row``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataspark.llm import kernels as K
from strataspark.llm.quality import measure
from strataspark.llm.shared import stable, table

SAMPLE = 10_000  # the training sample, in memory as hashed features: some 100 MB
PARTS = 1  # tasks that train on shares of it; their weights are averaged
BITS = 18
STEPS = 20
TRUST = 0.995  # accuracy of the judged labels
RATE = 0.01  # small, so that what documents share is learnt before any one document is known by heart
OFTEN = 8  # documents of a part that must hold a feature for it to be learnt
UNJUDGED = 0.005  # weight in training of a document whose posterior rests on heuristics alone
#: Heuristic labellers in SQL over the measurements of a document and its label: 1 good, 0 bad, -1 no opinion.
LABELLERS = {
    "symbols": "case when 10 * n_symbols > 3 * n_words then 0 when n_symbols = 0 and n_words >= 20 then 1 else -1 end",
    "marks": "case when 10 * n_marks > 3 * n_words then 0 else -1 end",
    "capitals": "case when n_letters > 20 and 100 * n_upper > 50 * n_letters then 0 when n_letters > 20 and 100 * n_upper < 20 * n_letters then 1 else -1 end",
    "windows": "case when 100 * n_repeat_words > 50 * n_words then 0 when n_words >= 50 and 100 * n_repeat_words < 20 * n_words then 1 else -1 end",
    "words": "case when n_words = 0 or word_chars > 14 * n_words then 0 when 10 * word_chars between 35 * n_words and 75 * n_words then 1 else -1 end",
    "lines": "case when n_lines >= 3 and 3 * n_dup_lines > n_lines then 0 when n_lines >= 3 and n_dup_lines = 0 then 1 else -1 end",
    "letters": "case when n_words > 0 and 100 * n_letters < 60 * word_chars then 0 when n_words > 0 and 100 * n_letters > 80 * word_chars then 1 else -1 end",
    "length": "case when n_words < 20 then 0 when n_words between 100 and 10000 then 1 else -1 end",
    "judged": "case when label is null then -1 else label end",
}


def fit_votes(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, float, np.ndarray]:
    """(rates[class, labeller, vote + 1], prior of good, posterior of good per pattern) by expectation-maximisation.

    The start, and a Dirichlet prior of the same shape, say only that labellers are right more often than wrong; the
    judged label's accuracy, the last one's, is given.
    """
    m = patterns.shape[1]
    votes = patterns + 1
    trust = np.full(m, 0.8)
    trust[-1] = TRUST
    weight = np.array([[[1.0, t, 1 - t], [1.0, 1 - t, t]] for t in trust]).transpose(1, 0, 2)  # class 0: bad, 1: good
    weight = weight * np.maximum(1.0, 0.02 * counts.sum())
    weight[:, -1] *= 1e6
    said = patterns[:, -1] >= 0
    given = np.where(patterns[:, -1] == 1, TRUST, 1 - TRUST)
    rates, prior = weight / weight.sum(axis=2, keepdims=True), 0.7
    post = np.full(len(patterns), prior)
    for _ in range(rounds):
        ll = np.array([np.log(rates[c][np.arange(m), votes]).sum(axis=1) for c in (0, 1)]) + np.log([[1 - prior], [prior]])
        new = np.where(said, given, 1 / (1 + np.exp(np.clip(ll[0] - ll[1], -500, 500))))
        done, post = np.abs(new - post).max() < 1e-9, new
        prior = float(np.clip((post * counts).sum() / counts.sum(), 1e-3, 1 - 1e-3))
        for c, p in ((0, 1 - post), (1, post)):
            for v in range(3):
                rates[c, :, v] = ((votes == v) * (p * counts)[:, None]).sum(axis=0) + weight[c, :, v]
            rates[c] /= rates[c].sum(axis=1, keepdims=True)
        if done:
            break
    return rates, prior, post


def _features(data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """Distinct hashed features of every document: words, their first four and six and last three bytes, lower-cased."""
    low = K.lower(data)
    w = K.Words(low, off)
    roll = K.Rolling(low, 4)
    kinds = [roll.of(w.start, w.end), roll.of(w.start, np.minimum(w.start + 4, w.end)), roll.of(w.start, np.minimum(w.start + 6, w.end)), roll.of(np.maximum(w.end - 3, w.start), w.end)]
    with np.errstate(over="ignore"):
        h = np.stack([(K.splitmix(x + K.U64(i)) >> K.U64(64 - BITS)).astype(np.int32) for i, x in enumerate(kinds)], axis=1)
    return [np.unique(h[a:b]) for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist())]


def train(features: list[np.ndarray], target: np.ndarray, weight: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Logistic weights and bias of good by AdaGrad over documents, on the soft targets; a fixed order, so reruns agree.
    Features that few documents hold are left out, and both classes weigh the same in sum."""
    held = np.zeros(1 << BITS, dtype=np.int64)
    for f in features:
        held[f] += 1
    known = held >= OFTEN
    features = [f[known[f]] for f in features]
    share = float(np.clip((weight * target).sum() / max(weight.sum(), 1e-9), 0.05, 0.95))
    weight = weight * np.where(target >= 0.5, 0.5 / share, 0.5 / (1 - share))
    w, g = np.zeros(1 << BITS), np.full(1 << BITS, 1e-3)
    bias, gb = 0.0, 1e-3
    order = np.random.default_rng(7).permutation(len(features))
    for step in range(steps):
        for i in order:
            f = features[i]
            d = 1 / (1 + np.exp(-np.clip(bias + w[f].sum(), -30, 30))) - target[i]
            if abs(d) < 0.02:
                continue
            g[f] += d * d
            w[f] -= weight[i] * RATE * d / np.sqrt(g[f])
            gb += d * d
            bias -= weight[i] * RATE * d / np.sqrt(gb)
    return w, bias


def classify(docs: DataFrame, labels: DataFrame, text: str = "text", threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """``row``, posterior (of the votes), score (of the linear scorer), kept (score at least the threshold, and votes that speak for it)."""
    docs = stable(docs)
    judged = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.min(F.expr("case when quality is null and toxic is null then null when coalesce(quality, 1) = 1 and coalesce(toxic, 0) = 0 then 1 else 0 end")).alias("label"))
    m = measure(docs.withColumn("_n", F.monotonically_increasing_id()), text).withColumn("doc_id", F.col("row.doc_id"))
    votes = m.join(judged, "doc_id", "left").select(F.col("row._n").alias("n"), *[F.expr(sql).cast("int").alias(name) for name, sql in LABELLERS.items()])
    names = list(LABELLERS)
    votes = table(votes, "votes")
    patterns = votes.groupBy(names).agg(F.count("*").alias("docs")).orderBy(names).toPandas()  # at most 3 ** labellers rows
    if len(patterns):
        rates, prior, post = fit_votes(patterns[names].to_numpy(), patterns["docs"].to_numpy(dtype=float))
        patterns["posterior"] = post
        of = docs.sparkSession.createDataFrame(patterns[[*names, "posterior"]])
    else:
        of = docs.sparkSession.createDataFrame([], ", ".join(f"{n} int" for n in names) + ", posterior double")
    judged_row = F.col("judged") >= 0
    post = table(votes.join(F.broadcast(of.select(*[F.col(n).cast("int").alias(n) for n in names], "posterior")), names).select("n", "posterior", F.when(judged_row, 1.0).otherwise(UNJUDGED).alias("weight")), "posteriors")

    rows = docs.select(F.monotonically_increasing_id().alias("n"), F.struct("*").alias("row"), F.col(text).cast("string").alias("text"))
    some = post.orderBy(F.desc("weight"), F.xxhash64("n"), "n").limit(sample)

    def fit(key: tuple, t: pa.Table) -> pa.Table:
        order = np.argsort(t.column("n").to_numpy())
        features = [f for c in t.column("text").chunks for _, _, data, off in K.chunks(c) for f in _features(data, off)]
        w, bias = train([features[i] for i in order], t.column("posterior").to_numpy()[order], t.column("weight").to_numpy()[order])
        return pa.table({"docs": pa.array([len(features)], type=pa.int64()), "w": pa.array([w.astype("<f4").tobytes()], type=pa.binary()), "bias": pa.array([bias], type=pa.float64())})

    picked = rows.join(F.broadcast(some), "n").select("n", "text", "posterior", "weight", F.pmod(F.xxhash64("n"), F.lit(PARTS)).alias("part"))
    w, bias, total = np.zeros(1 << BITS), 0.0, 0
    for r in picked.groupBy("part").applyInArrow(fit, "docs long, w binary, bias double").collect():  # PARTS rows
        w, bias, total = w + r["docs"] * np.frombuffer(r["w"], dtype="<f4").astype(float), bias + r["docs"] * r["bias"], total + r["docs"]
    w, bias = w / max(total, 1), bias / max(total, 1)
    shared = docs.sparkSession.sparkContext.broadcast((w.astype(np.float32), bias))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, b0 = shared.value
        for b in batches:
            for lo, hi, data, off in K.chunks(b.column(2)):
                s = [1 / (1 + np.exp(-np.clip(b0 + float(weights[f].sum()), -30, 30))) for f in _features(data, off)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(s, type=pa.float64())], names=["n", "row", "score"])

    kind = rows.schema["row"].dataType.simpleString()
    scored = rows.mapInArrow(apply, f"n long, row {kind}, score double")
    return scored.join(post.drop("weight"), "n").select("row", "posterior", "score", ((F.col("score") >= threshold) & (F.col("posterior") >= 0.5)).alias("kept"))
