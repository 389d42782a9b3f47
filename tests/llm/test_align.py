"""Alignment against whole texts through both tokenizers and set intersection of their ends."""

import hashlib
import re
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strataspark.llm import align, queries
from strataspark.llm import kernels as K
from strataspark.session import ship

A, B = queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def models():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def byte_of():
    """The public byte-level table, built the other way round."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}


def tokens(models, text):
    """(ids, token bytes) of both, whole text at once; None where the bytes are not the text's."""
    a, b = models
    want = (" " + text).encode()
    table = byte_of()
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    raw_a = [bytes(table[c] for c in a.id_to_token(i)) for i in ids_a]
    raw_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in map(b.id_to_piece, ids_b)]
    return (ids_a, raw_a, ids_b, raw_b) if b"".join(raw_a) == want == b"".join(raw_b) else None


def truth(models, rows):
    docs, corpus = [], Counter()
    for d, text in rows:
        t = tokens(models, text) if text else None
        if t is None:
            docs.append((d, 0, 0, [], ""))
            continue
        ids_a, raw_a, ids_b, raw_b = t
        end_a, end_b = np.cumsum([len(x) for x in raw_a]).tolist(), np.cumsum([len(x) for x in raw_b]).tolist()
        links, groups, la, lb = [], [], 0, 0
        for e in sorted(set(end_a) & set(end_b)):
            i, j = end_a.index(e), bisect_left(end_b, e)
            links.append((ids_a[i], ids_b[j]))
            groups.append(",".join(map(str, ids_a[la : i + 1])) + "|" + ",".join(map(str, ids_b[lb : j + 1])))
            la, lb = i + 1, j + 1
        corpus.update(links)
        docs.append((d, len(ids_a), len(ids_b), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = Counter()
    for (_, j), n in corpus.items():
        most[j] = max(most[j], n)
    return [(d, na, nb, len(ls), len(ls), sum(corpus[x] == most[x[1]] for x in ls), sum(corpus[x] for x in ls), sha) for d, na, nb, ls, sha in docs]


def odd_texts():
    rng = np.random.default_rng(4)
    part = [" ", "  ", "\n", "\n\n", "\t", "\r\n", " ", "　", " ", "\u0085", " ", "é", "ÿ", "ß", "世界", "の", "😀", "é", "don't", "'s", "'", "12345", "the", " of", "tion", "<|endoftext|>", "</s>", "<unk>", "<0x0A>", "..", "!?", "\x00", "\x1c", "​", "᠎", "ﬁ", "Ａ", "x", "﻿", "кот", "ا"]
    return ["".join(rng.choice(part, rng.integers(1, 40))) for _ in range(400)]


def test_gallop():
    rng = np.random.default_rng(0)
    for n, m in ((1, 1), (5, 50), (300, 4000), (50, 60)):
        long = np.sort(rng.choice(10 * m, m, replace=False))
        short = np.sort(rng.choice(long[-1] + 1, min(n, long[-1] + 1), replace=False))
        for guess in (np.zeros(len(short), dtype=np.int64), np.full(len(short), m - 1), rng.integers(0, m, len(short))):
            assert (align.gallop(short, long, guess) == np.searchsorted(long, short)).all()


def test_segments(models):
    """Texts cut into segments give the ids of whole texts, also where keys collide."""
    al = align.Aligner(A, B)
    assert al.cuts
    texts = odd_texts()
    for _ in range(2):  # unknown, then known
        for _, _, data, off in K.chunks(pa.array(texts), 4000):
            raw = data.tobytes()
            own = [raw[s:e].decode() for s, e in zip(off[:-1].tolist(), off[1:].tolist())]
            na, nb, *_ = al.align(data, off)
            want = [tokens(models, t) for t in own]
            assert na.tolist() == [len(t[0]) if t else 0 for t in want] and nb.tolist() == [len(t[2]) if t else 0 for t in want]
    al.keys = np.sort(al.keys)
    al.at = al.at[::-1].copy()  # every key now stands for another segment
    assert [r[1:] for r in run(al, texts[:50])] == [r[1:] for r in run(align.Aligner(A, B), texts[:50])]


def run(al, texts):
    return [(t, *r) for _, _, data, off in K.chunks(pa.array(texts), 1000) for t, r in zip(texts, zip(*(x.tolist() if hasattr(x, "tolist") else x for x in np.array(al.align(data, off), dtype=object)[[0, 1, 2, 4]])))]


@pytest.mark.parametrize("size", [1 << 23, 1500])
def test_alignment(spark, models, size):
    """One block, and many; nulls, empty texts, repeated rows, a word of 30 000 letters, texts a tokenizer does not give back."""
    ship(spark)
    texts = odd_texts()[:150]
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, " "), (903, "\n"), (None, "the cat"), (904, "a▁b"), (905, "ab" * 15_000), (906, "the cat sat. " * 3000), (7, texts[7]), (7, texts[7])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("block", "pair", "row", "n_a", "k", "links")})
    got = align.align_tokens(docs, A, B, size=size)
    want = truth(models, rows)
    assert sum(w[1] == 0 for w in want) >= 3 and sum(w[5] < w[4] for w in want) > 50
    assert Counter(map(tuple, got.collect())) == Counter(want)
    assert got.count() == len(rows)
    assert align.align_tokens(docs.where("false"), A, B).collect() == []
    assert [r["n_a"] for r in align.align_tokens(docs.where("text is null"), A, B).collect()] == [0]


def test_given_documents(spark, models):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert Counter(map(tuple, queries.op11_alignment(spark, sf).collect())) == Counter(truth(models, rows))
