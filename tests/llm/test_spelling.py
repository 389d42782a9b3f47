"""Spelling variants against brute force: all pairs of words, forms and chains by their definition."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataspark.llm import spelling

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counts(rows, least_length=6, least=5):
    c = Counter()
    for d, t in rows:
        for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            r = r.translate(LOW)
            h = zlib.crc32(f"{'' if d is None else d}:{r}".encode())
            c[r[: h % len(r)] + r[h % len(r) + 1 :] if h % 199 == 0 else r] += 1
    return {w: n for w, n in c.items() if len(w) >= least_length and n >= least}


def truth(words, factor=5):
    near = {a: [b for b in words if one_edit(a, b)] for a in words}
    form = {}
    for a, bs in near.items():
        if bs and (top := max(words[b] for b in bs)) >= factor * words[a]:
            form[a] = min(b for b in bs if words[b] == top)
    out = set()
    for a in words:
        root = a
        while root in form:
            root = form[root]
        out.add((a, words[a], len(near[a]), form.get(a), words[form[a]] if a in form else None, root))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    base = ["".join(rng.choice(list("abé"), rng.integers(6, 8))) for _ in range(150)] + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "ababab", "bababa", "bababab", "ÿ÷×ßøåx", "x" * 300, "x" * 301]
    weights = 1 / np.arange(1, len(base) + 1) ** 1.5
    pick = lambda n: " ".join(w.upper() if k % 7 == 0 else w for k, w in enumerate(rng.choice(base, n, p=weights / weights.sum())))
    chain = " ".join(["kettle"] * 900 + ["kettlle"] * 150 + ["kettllle"] * 25 + ["kettlllle"] * 5)
    out = [(i, pick(200).replace(" ", ", " if i % 3 else "\n")) for i in range(40)] + [(90, chain), (91, None), (92, ""), (93, "short word 123"), (None, pick(60)), (None, None)]
    return [*out, out[0], out[0]]


def test_spelling(spark, rows):
    words = counts(rows)
    want = truth(words)
    assert sum(x[3] is not None for x in want) >= 10 and any(x[5] not in (x[0], x[3]) for x in want)
    assert ("kettlllle", 5, 1, "kettllle", 25, "kettle") in want or any(x[5] == "kettle" and x[3] not in (None, "kettle") for x in want)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("word", "n", "root", "key", "form")})
    got = spelling.spelling_variants(docs)
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)


def test_slips(spark):
    """Runs whose hash 199 divides lose the letter that it names."""
    rows = [(d, "Übermäßig Flüsse") for d in range(2000)]
    got = {r["word"]: r["n"] for r in spelling.vocabulary(spark.createDataFrame(rows, "doc_id long, text string"), 5, 1).collect()}
    assert got == {w: n for w, n in counts(rows, 5, 1).items() if len(w) >= 5} and len(got) > 5


def test_pivots(spark, rows):
    """Disjoint, in the prefix, and the cheapest such pair."""
    words = spark.createDataFrame(sorted(counts(rows).items()), "word string, n long")
    for r in spelling.pivots(words).collect():
        g = {x["p"]: (x["f"], x["g"]) for x in r["prefix"]}
        assert max(g.values()) == (r["last"]["f"], r["last"]["g"]) and r["b"] - r["a"] >= 2
        assert g[r["a"]][0] + g[r["b"]][0] == min(g[x][0] + g[y][0] for x in g for y in g if y - x >= 2)
        every = sorted((r["word"][i : i + 2]) for i in range(len(r["word"]) - 1))
        assert all(r["word"][p : p + 2] == v[1] for p, v in g.items()) and len(g) >= 3 and len(every) >= len(g)


def test_pivot_join_is_not_broadcast(spark, rows):
    """The exploded sides of the pivot join do not pass through the driver, however small the file of pivots is."""
    words = spark.createDataFrame(sorted(counts(rows).items()), "word string, n long")
    plan = spelling.near_pairs(words)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [key" in plan and "Broadcast" not in plan


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.spelling_variants(docs).collect() == []
    assert spelling.spelling_variants(spark.createDataFrame([(1, None), (2, "few")], "doc_id long, text string")).collect() == []
