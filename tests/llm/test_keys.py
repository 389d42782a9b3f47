"""Texts that a polynomial hash modulo 2**64 confuses, vectors with huge components, counts without columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataspark.llm import kernels as K
from strataspark.llm import lattice, near, packing, quality, queries, repeats, topk
from strataspark.session import ship


def thue_morse(n, letters="ab"):
    """Two words of n letters of which such a hash makes one."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join(letters[b] for b in bits), "".join(letters[1 - b] for b in bits)


@pytest.mark.parametrize("n", [64, 128, 255, 256, 512, 1024, 2048, 4096])
def test_rolling(n):
    for seed in range(12):
        data = np.frombuffer("".join(thue_morse(n)).encode(), dtype=np.uint8)
        a, b = K.Rolling(data, seed).of(np.array([0, n]), np.array([n, 2 * n]))
        assert a != b


def test_same_span_same_hash():
    data = np.frombuffer(b"x" * 300 + b"ab" * 200 + b"x" * 300, dtype=np.uint8)
    h = K.Rolling(data, 1).of(np.array([0, 700, 0, 1]), np.array([300, 1000, 299, 300]))
    assert h[0] == h[1] and h[2] == h[3] != h[0]


@pytest.mark.parametrize("n", [512, 1024, 4096])
def test_operators(spark, n):
    from tokenizers import Tokenizer

    ship(spark)
    a, b = thue_morse(n)
    docs = spark.createDataFrame([(1, a), (2, b), (3, f"{a}\n{b}")], "doc_id long, text string")
    tok = Tokenizer.from_file(queries.tokenizer_path())
    got = {}
    for r in packing.pack(docs, queries.tokenizer_path(), with_ids=True).collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["ids"]))
    for d, t in ((1, a), (2, b), (3, f"{a} {b}")):
        assert [i for _, ids in sorted(got[d]) for i in ids] == [*tok.encode(t, add_special_tokens=False).ids, 1]
    assert {r["row"]["doc_id"]: r["n_dup_lines"] for r in quality.ledger(docs).collect()} == {1: 0, 2: 0, 3: 0}
    assert {r["doc_id"]: r["component_id"] for r in near.near_duplicates(docs, 3, 85).collect()} == {1: 1, 2: 2, 3: 3}


def test_top_k_count_and_huge_components(spark):
    ship(spark)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(60)]
    rows += [(60, [1e20] * 6), (61, [1e20, -1e20, 0.0, 0.0, 0.0, 1.0]), (62, [1e307] * 6), (80, [-1e200] * 6), (81, [1e200] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = topk.top_k(df, F.col("vec_id") % 20 == 0, k=5)
    assert found.count() == 5 * 5 and found.select("rank").count() == 25
    good = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows if i != 62]
    top = (1 << 63) - 1
    want = set()
    for i, v in good:
        if i % 20 == 0:
            s = sorted((-max(-top - 1, min(top, sum(a * b for a, b in zip(v, w)))), j) for j, w in good if j != i)
            want |= {(i, k + 1, j, -x) for k, (x, j) in enumerate(s[:5])}
    assert {tuple(r) for r in found.collect()} == want


def test_lattice_on_repeated_rows(spark):
    """Copies of one row are dealt to chunks by their places."""
    ship(spark)
    old, lattice.CHUNK = lattice.CHUNK, 200
    try:
        got = lattice.score(spark.createDataFrame([(1, "one two three")] * 50 + [(2, "four")], "doc_id long, text string"), queries.tokenizer_path("piece_bpe_32k.model")).collect()
    finally:
        lattice.CHUNK = old
    assert len(got) == 51 and len({(r["doc_id"], round(r["score"], 9)) for r in got}) == 2


def test_anchors_do_not_depend_on_the_buffer(monkeypatch):
    """Ranks that differ in low bits only: a document has the same runs alone and before three million other bytes."""
    grams = K.Rolling.grams
    monkeypatch.setattr(K.Rolling, "grams", lambda self, n: grams(self, n) & K.U64(0xFF000))
    rng = np.random.default_rng(4)
    text, other = (rng.integers(97, 123, n).astype(np.uint8) for n in (900, 3_000_000))
    alone = repeats.anchors(text, np.array([0, len(text)]))
    both = repeats.anchors(np.concatenate([text, other]), np.array([0, len(text), len(text) + len(other)]))
    own = both[0] == 0
    assert len(alone[0]) > 1 and all((a == b[own]).all() for a, b in zip(alone, both))
