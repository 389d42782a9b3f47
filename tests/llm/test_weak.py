"""The weak-label model: EM against a plain version row by row, accuracies that are known, and labels held out."""

import math

import numpy as np
from pyspark.sql import functions as F

from strataspark.llm import weak
from strataspark.llm.shared import documents

NAMES = list(weak.LABELLERS)


def plain_em(rows, rounds):
    """Dawid and Skene over single rows in Python numbers, with the model's start, prior and given labels."""
    m, n = len(rows[0]), len(rows)
    trust = [0.8] * (m - 1) + [weak.TRUST]
    mass = [max(1.0, 0.02 * n) * (1e6 if j == m - 1 else 1) for j in range(m)]
    pseudo = [[[mass[j], mass[j] * (trust[j] if c == 0 else 1 - trust[j]), mass[j] * (trust[j] if c == 1 else 1 - trust[j])] for j in range(m)] for c in (0, 1)]
    rates = [[[x / sum(row) for x in row] for row in pseudo[c]] for c in (0, 1)]
    prior, post = 0.7, [0.7] * n
    for _ in range(rounds):
        new = []
        for r in rows:
            if r[-1] >= 0:
                new.append(weak.TRUST if r[-1] == 1 else 1 - weak.TRUST)
                continue
            good = math.log(prior) + sum(math.log(rates[1][j][r[j] + 1]) for j in range(m))
            bad = math.log(1 - prior) + sum(math.log(rates[0][j][r[j] + 1]) for j in range(m))
            new.append(1 / (1 + math.exp(bad - good)))
        done, post = max(abs(a - b) for a, b in zip(new, post)) < 1e-9, new
        prior = min(1 - 1e-3, max(1e-3, sum(post) / n))
        for c in (0, 1):
            for j in range(m):
                sums = list(pseudo[c][j])
                for r, p in zip(rows, post):
                    sums[r[j] + 1] += p if c else 1 - p
                rates[c][j] = [x / sum(sums) for x in sums]
        if done:
            break
    return rates, prior, post


def votes(n, seed):
    """Labellers whose accuracies are known: right with their own chance, silent for a third; a fifth of the rows is judged."""
    rng = np.random.default_rng(seed)
    truth = rng.random(n) < 0.7
    accuracy = np.array([0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.65, 0.6])
    right = rng.random((n, 8)) < accuracy
    v = np.where(right, truth[:, None], ~truth[:, None]).astype(int)
    v[rng.random((n, 8)) < 1 / 3] = -1
    judged = np.where(rng.random(n) < 0.2, truth.astype(int), -1)
    return truth, accuracy, np.column_stack([v, judged])


def test_em_is_that_of_rows():
    _, _, v = votes(250, 1)
    patterns, back, counts = np.unique(v, axis=0, return_inverse=True, return_counts=True)
    for rounds in (1, 3, 40):
        rates, prior, post = weak.fit_votes(patterns, counts.astype(float), rounds)
        want = plain_em(v.tolist(), rounds)
        assert np.allclose(rates, want[0], atol=1e-9) and abs(prior - want[1]) < 1e-9
        assert np.allclose(post[back.ravel()], want[2], atol=1e-9)


def test_em_finds_each_labellers_accuracy():
    truth, accuracy, v = votes(20_000, 2)
    patterns, back, counts = np.unique(v, axis=0, return_inverse=True, return_counts=True)
    rates, prior, post = weak.fit_votes(patterns, counts.astype(float))
    good, bad = rates[1, :8, 2] / rates[1, :8, 1:].sum(axis=1), rates[0, :8, 1] / rates[0, :8, 1:].sum(axis=1)
    assert np.abs(good - accuracy).max() < 0.03 and np.abs(bad - accuracy).max() < 0.04 and abs(prior - 0.7) < 0.02
    assert ((post[back.ravel()] >= 0.5) == truth).mean() > 0.93


def test_labels_held_out(spark):
    """Documents whose label the model has not seen: most bad ones go, nearly all good ones stay."""
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    unseen = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    got = {r["doc_id"]: (r["score"], r["kept"]) for r in weak.classify(documents(spark, sf), labels.where(~unseen)).select("row.doc_id", "score", "kept").collect()}
    want = {r["doc_id"]: r["quality"] == 1 and r["toxic"] == 0 for r in labels.where(unseen).collect()}
    good, bad = ([d for d in want if want[d] == g] for g in (True, False))
    rank = np.mean([[got[g][0] > got[b][0] for b in bad] for g in good])
    assert len(bad) >= 10 and rank > 0.85
    assert np.mean([got[g][1] for g in good]) > 0.9 and np.mean([not got[b][1] for b in bad]) > 0.5
