"""Registered corpus queries at the smallest scale: oracles where SQL can express them, counts else; the pipeline's stages."""

import pytest

from strataspark.llm import queries


@pytest.mark.parametrize("name", [n for n in sorted(queries.oracle_sql())])
def test_oracle(agree, name):
    assert agree(name) > 0


def test_pipeline(spark):
    """Every stage against brute force on what the one before it kept."""
    import corpus_pipeline as p
    from test_operators import closure, line_pairs, near_truth

    from strataspark.llm import quality

    sf = "/root/testdata/sf0.001"
    docs, seen = p.documents(spark, sf), []
    for _, stage in p.STAGES[:-1]:
        seen.append({r["doc_id"]: r["text"] for r in docs.collect()})
        docs = p.table(stage(spark, docs, sf), "stage")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    mixed = docs.collect()
    raw, ruled, lined, near = seen
    assert raw.keys() > ruled.keys() >= lined.keys() >= near.keys()

    failed = {r["row"]["doc_id"] for r in quality.ledger(p.documents(spark, sf)).where("fail_bits <> 0").select("row").collect()}
    assert ruled == {d: t for d, t in raw.items() if d not in failed}

    lines = [(d, i, x) for d, t in sorted(ruled.items()) for i, x in enumerate(t.split("\n"))]
    first = {}
    for d, i, x in lines:
        first.setdefault(x, (d, i))
    words = [x for x in first if x.strip(" \t\n\v\f\r")]
    root = closure(line_pairs(list(enumerate(words))), range(len(words)))
    best = {}
    for k, x in enumerate(words):
        best[root[k]] = min(best.get(root[k], (10**9, 0)), first[x])
    keep = set(best.values())
    want = {}
    for d, t in ruled.items():
        ls = t.split("\n")
        left = [x for i, x in enumerate(ls) if not x.strip(" \t\n\v\f\r") or (d, i) in keep]
        if any((d, i) in keep for i in range(len(ls))) or not t.strip(" \t\n\v\f\r"):
            want[d] = "\n".join(left)
    assert lined == want

    kept = {i for i, _, _, k in near_truth(sorted(lined.items()), 5, 80) if k}
    assert near == {d: t for d, t in lined.items() if d in kept}

    copies = {}
    for r in mixed:
        assert near[r["doc_id"]] == r["text"]
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
    assert max(copies.values()) <= 3

    packed = p.STAGES[-1][1](spark, docs, sf).collect()
    assert sum(r["start"] == 0 for r in packed) == len(mixed)
    assert {(r["doc_id"], r["doc_tokens"] * copies[r["doc_id"]]) for r in packed} == {(d, sum(r["length"] for r in packed if r["doc_id"] == d)) for d in copies}


def test_stages_on_odd_rows(spark):
    """Nulls in any column, empty texts, ties, repeated rows, an empty table: no stage fails or changes the columns."""
    import corpus_pipeline as p

    kind = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, None, None, None, None), (1, "", "en", None, 0), (1, None, None, "a", None), (2, "one two", None, "a", 7), (2, "one two", None, "a", 7), (None, "w " * 80, "en", "b", 160)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, kind)
        for _, stage in p.STAGES[1:-1]:
            out = stage(spark, docs, "")
            assert out.columns == docs.columns and out.count() <= 3 * len(data)
        assert p.STAGES[0][1](spark, docs, "").columns == docs.columns
        assert (p.STAGES[-1][1](spark, docs, "").count() > 0) == bool(data)
