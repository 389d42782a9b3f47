"""Corpus operators against brute force on small fixtures with nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataspark.llm import lattice, lines, mixing, near, packing, preference, quality, queries, repeats, topk, weak
from strataspark.llm.shared import components
from strataspark.session import ship

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    part = ["er", "in", "the", "on", "ß", "é", "an", "th", "re", "ou", "世"]
    words = ["".join(rng.choice(part, rng.integers(1, 5))) for _ in range(n)]
    return "".join(w + ("\n" if i % 11 == 10 else " ") for i, w in enumerate(words)).strip()


@pytest.fixture(scope="module")
def texts() -> list[tuple]:
    base = [prose(i, 120) for i in range(6)]
    near_copy = base[0].replace(base[0].split()[40], "changed", 1)
    rows = [(0, base[0]), (1, near_copy), (2, base[0]), (3, None), (4, ""), (5, "one two"), (6, "one two"), (7, " \n\t "), (8, base[1] + "\n" + base[2]), (9, base[2] + " " + base[3]),
            (10, base[4].upper()), (11, base[4]), (12, "a " * 300), (13, prose(99, 30_000)), (14, base[5]), (14, base[5]), (15, "x<|endoftext|>y, don't. 0 10,000! Ｅ» é," * 3), (None, base[3])]
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    """Documents with columns whose names clash with the operators' own."""
    ship(spark)
    df = spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}" if i != 5 else None, 7) for i, t in texts], "doc_id long, text string, lang string, source string, n_words long")
    return df.withColumns({c: F.lit(1) for c in ("size", "taken", "row", "score", "kept", "fail_bits", "h", "key", "n")})


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def test_quality_measures(docs, texts):
    got = sorted((tuple(r) for r in quality.ledger(docs).select("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()))
    want = []
    for _, x in texts:
        x = x or ""
        w = WORD.findall(x)
        g = Counter(zip(w, w[1:], w[2:]))
        cover = {i + k for i, t in enumerate(zip(w, w[1:], w[2:])) if g[t] > 1 for k in range(3)}
        ls = [line for line in x.split("\n") if WORD.search(line)]
        want.append((len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in x), len(ls) - len(set(ls)), len(cover)))
    assert got == sorted(want)


def test_policy_and_ablation(docs, empty):
    led = quality.ledger(docs)
    kept = quality.apply_policy(led, "v2")
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    rows = {r["rule"]: r for r in quality.ablations(led, "v2").collect()}
    assert rows["few_words"]["only_this"] <= rows["few_words"]["fails"]
    without = tuple(r for r in quality.POLICIES["v2"] if r != "few_words")
    assert led.where(quality.verdict(without)).count() - kept.count() == rows["few_words"]["only_this"]
    assert quality.ledger(empty).count() == 0
    each = quality.with_ablations(led, "v2")
    assert each.count() == docs.count() and each.where("blocking_rule = 'few_words'").select("let_back").distinct().collect() == [(rows["few_words"]["only_this"],)]


def closure(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    pairs = [(1, 2), (2, 3), (5, 4), (7, 7), (2, 1), (10, 3), *[(100, k) for k in range(101, 140)], *[(k, k + 1) for k in range(200, 240)]]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = closure(pairs, {x for p in pairs for x in p})
    assert got == {k: v for k, v in want.items() if k != 7}


def word_sets(rows, size):
    out = []
    for _, x in rows:
        w = WORD.findall((x or "").translate(LOW))
        out.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    return out


def near_truth(rows, size, percent):
    """(doc_id, n_shingles, component_id, kept) of every row by brute force: all pairs, rows told apart by their places."""
    sets = word_sets(rows, size)
    n = range(len(rows))
    root = closure([(a, b) for a in n for b in n if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])], n)
    first = {}
    for i in n:
        d = rows[i][0]
        first[root[i]] = min(first.get(root[i], (True, 0, 10**9)), (d is None, d or 0, i))
    return Counter((rows[i][0], len(sets[i]), None if first[root[i]][0] else first[root[i]][1], first[root[i]][2] == i) for i in n)


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(docs, empty, texts, size, percent):
    got = near.near_duplicates(docs, size, percent).select("doc_id", "n_shingles", "component_id", "kept").collect()
    ids = lambda c: Counter({(a, n, x): v for (a, n, x, _), v in c.items()})  # noqa: E731  rows of one id and text may swap places
    assert ids(Counter(map(tuple, got))) == ids(near_truth(texts, size, percent))
    assert sum(r["kept"] for r in got) == sum(v for k, v in near_truth(texts, size, percent).items() if k[3])
    assert near.near_duplicates(empty).count() == 0


def test_near_duplicates_of_repeated_ids(spark):
    """Rows are documents of their own: no text vanishes with another of its id, and an exact copy goes whatever its id."""
    a, b, c = (prose(70 + i, 60) for i in range(3))
    rows = [(1, a), (2, a), (2, b), (3, c), (3, c), (None, b), (None, prose(80, 40))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, near.near_duplicates(df).collect())) == near_truth(rows, 5, 80)
    out = near.drop_near_duplicates(df.withColumn("row", F.lit(5)).withColumn("kept", F.lit("x")))
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == Counter([rows[0], rows[2], rows[3], rows[6]]) and out.columns == ["doc_id", "text", "row", "kept"]


@pytest.mark.parametrize("group", [4096, 9])
def test_near_duplicates_in_a_group_of_unlinked_neighbours(spark, monkeypatch, group):
    """Many texts between the estimate's cut and the threshold, some linked: nothing is lost by blocks or bands, below and
    above the size up to which bands that share classes are one group."""
    ship(spark)
    monkeypatch.setattr(near, "GROUP", group)
    monkeypatch.setattr(near, "BLOCK", 16)
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for d in range(60):
        w = list(base)
        for k in rng.choice(150, rng.integers(1, 9), replace=False):
            w[k] = f"e{d}_{k}"
        rows.append((d, " ".join(w)))
    sets = {i: set(zip(w, w[1:], w[2:])) for i, x in rows for w in [x.split()]}
    pairs = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    got = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == closure(pairs, sets)


def test_register_estimate_is_near_the_truth():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 900).astype(np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 2**63, 60).astype(np.uint64)])
    j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    x, y = near.registers(np.unique(a)), near.registers(np.unique(b))
    got = near.estimate(np.array([(x == y).mean()]), np.array([900]), np.array([860]))[0]
    assert abs(got - j) < 4 * (j * (1 - j) / near.REGISTERS) ** 0.5


def test_fuzzy_lines(docs, empty, texts):
    got = lines.line_ledger(docs).collect()
    assert len(got) == sum(1 for _, x in texts for line in (x or "").split("\n") if WORD.search(line))
    assert set(Counter(r["component_id"] for r in got if r["kept"]).values()) == {1}
    out = lines.dedup_lines(docs)
    assert out.columns == docs.columns
    by = defaultdict(list)
    for r in out.collect():
        by[r["doc_id"]].append(r["text"])
    assert by[0] and by[2] == [] and by[3] == [None] and by[4] == [""] and len(by[14]) == 1
    assert len(by[1]) == 1 and by[1][0].count("\n") == 0 and "changed" in by[1][0]  # its other lines repeat those of document 0
    assert lines.line_ledger(empty).count() == 0 and lines.dedup_lines(empty).count() == 0


def test_fuzzy_lines_join_exactly_those_at_the_threshold(spark):
    a = "the quick brown fox jumps over the lazy dog and runs into the deep dark forest near the old stone mill"
    rows = [(1, a), (2, a.replace("fox", "cat")), (3, a[::-1]), (4, a[: len(a) // 2])]
    sh = lambda s: {s[i : i + lines.SHINGLE] for i in range(len(s) - lines.SHINGLE + 1)}
    assert 100 * len(sh(rows[0][1]) & sh(rows[1][1])) >= 80 * len(sh(rows[0][1]) | sh(rows[1][1]))
    got = {r["doc_id"]: r["kept"] for r in lines.line_ledger(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: True, 2: False, 3: True, 4: True}


def line_pairs(rows):
    """All pairs of lines with at least 80 % of their distinct shingles in common, by brute force."""
    sets = {i: {s[k : k + lines.SHINGLE] for k in range(max(1, len(s) - lines.SHINGLE + 1))} for i, s in rows}
    return [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]


def line_roots(spark, rows):
    got = lines.line_ledger(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    return {r["doc_id"]: r["component_id"] for r in got}


def test_fuzzy_lines_without_spaces(spark):
    """Recall of lines with few or no spaces against brute force; no pair below the threshold is joined."""
    rng = np.random.default_rng(11)
    alphabets = ["".join(map(chr, range(0x4E00, 0x4E00 + 900))), "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", "abcdefghijklmnopqrstuvwxyz/.-_"]
    rows = []
    for d in range(240):
        s = rng.choice(list(alphabets[d % 3]), rng.integers(60, 400))
        if d % 4 == 0:
            s[rng.integers(0, len(s), 3)] = " "
        u = s.copy()
        u[: 1 if d % 2 else 0] = "#"  # the line's start differs
        for k in rng.integers(0, len(s), max(1, len(s) // 100)):
            u[k] = "#"
        rows += [(2 * d, "".join(s)), (2 * d + 1, "".join(u))]
    pairs = line_pairs(rows)
    root = line_roots(spark, rows)
    assert len(pairs) > 150 and sum(root[a] == root[b] for a, b in pairs) >= 0.97 * len(pairs)
    assert {(a, b) for a, b in zip(range(0, 480, 2), range(1, 480, 2)) if root[a] == root[b]} <= set(pairs)
    tail = "://example.org/" + "".join(rng.choice(list(alphabets[1]), 200))
    root = line_roots(spark, [(1, "http" + tail), (2, "https" + tail)])
    assert root[1] == root[2]


def test_fuzzy_lines_of_few_characters(spark):
    """Recall of lines of 12 to 20 characters, whose few shingles have few independent minima, against brute force."""
    rng = np.random.default_rng(23)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    rows = []
    for d in range(600):
        s = "".join(rng.choice(letters, rng.integers(12, 20)))
        more = "".join(rng.choice(letters, 1 + (len(s) > 16 and d % 2)))
        rows += [(2 * d, s), (2 * d + 1, s + more if d % 3 else more + s)]
    pairs = line_pairs(rows)
    root = line_roots(spark, rows)
    assert len(pairs) > 500 and all(b == a + 1 for a, b in pairs)
    assert sum(root[a] == root[b] for a, b in pairs) >= 0.94 * len(pairs)
    assert {d for d in range(0, 1200, 2) if root[d] == root[d + 1]} <= {a for a, _ in pairs}
    assert len({root[a] for a, _ in rows}) == 1200 - sum(root[a] == root[b] for a, b in pairs)


def test_fuzzy_lines_of_repeated_content_at_any_length(spark):
    """Equal sets of distinct shingles are alike whatever the lengths of their lines."""
    rows = [(1, "=" * 100), (2, "=" * 200), (3, "ha " * 20), (4, "ha " * 90), (5, "-" * 30)]
    root = line_roots(spark, rows)
    assert root[1] == root[2] and root[3] == root[4] and len(set(root.values())) == 3


def test_fuzzy_lines_in_blocks(spark, monkeypatch):
    """A group of lines about the threshold that share bands: cut into blocks, it has the links of the uncut group."""
    rng = np.random.default_rng(4)
    base = list("".join(rng.choice(list("abcdefghij klmnop"), 300)))
    rows = []
    for d in range(90):
        s = list(base)
        for k in rng.integers(0, 300, rng.integers(1, 7)):
            s[k] = chr(0x400 + d)
        rows.append((d, "".join(s)))
    want = {k: v for k, v in line_roots(spark, rows).items()}
    truth = closure(line_pairs(rows), range(90))
    assert all(truth[a] == truth[b] for a in want for b in want if want[a] == want[b])
    monkeypatch.setattr(lines, "BLOCK", 7)
    assert line_roots(spark, rows) == want


def test_fuzzy_lines_link_copies_to_what_they_are_copies_of(spark):
    """A group of copies edited apart from each other: some of them are unlike each other, and the links found are few, not a
    square of the group's size."""
    rng = np.random.default_rng(8)
    base = list(rng.choice(list("abcdefghij klmnop"), 300))
    rows = [(0, "".join(base))]
    for d in range(1, 151):
        s = list(base)
        for k in rng.choice(30, 1 + d % 3, replace=False):
            s[10 * k] = chr(0x400 + d)
        rows.append((d, "".join(s)))
    pairs = line_pairs(rows)
    assert 2000 < len(pairs) < 151 * 150 // 2 - 2000
    ids = lines.line_rows(spark.createDataFrame(rows, "doc_id long, text string"))
    got = [(r["a"], r["b"]) for r in lines.links(ids).collect()]
    assert len(got) <= 2 * len(rows)
    h = [r["h"] for r in ids.select("h").collect()]
    assert len(set(closure(pairs, range(len(rows))).values())) == len(set(closure(got, h).values())) == 1


def test_fuzzy_lines_below_the_threshold_meet_no_sets(spark, monkeypatch):
    """Lines a little below the threshold end at their bitmaps, before texts are fetched, and sets are compared last; no pair
    at the threshold is ruled out."""
    rng = np.random.default_rng(3)
    base = list(rng.choice(list("abcdefghij klmnop"), 400))
    rows = [(0, "".join(base) + "x" * 30)]
    for d in range(1, 81):
        s = list(base)
        for k in range(d % 2, 12, 2) if d <= 8 else rng.choice(33, 7, replace=False):
            s[12 * k] = chr(0x400 + d)
        rows.append((d, "".join(s)))
    pairs = line_pairs(rows)
    assert 5 <= len(pairs) < 400
    kept, table = {}, lines.table
    monkeypatch.setattr(lines, "table", lambda df, name: kept.setdefault(name, table(kept.setdefault(f"{name} plan", df), name)))
    ids = lines.line_rows(spark.createDataFrame(rows, "doc_id long, text string"))
    lines.links(ids).collect()
    assert kept["mixed"].count() > 100 and kept["live"].count() < 0.25 * kept["mixed"].count()
    plan = kept["links_across plan"]._jdf.queryExecution().optimizedPlan().toString()
    join = next(x for x in plan.splitlines() if "Join Inner" in x and "array_intersect" in x)
    assert join.rindex("bit_count") < join.index("array_intersect")
    name = dict(ids.select("doc_id", "h").collect())
    side = lambda *c: lines._bitmaps(ids).toDF(*c)
    may = side("a", "nx", "x").join(side("b", "ny", "y"), lines._bound(80, "nx", "ny", "x", "y")).select("a", "b")
    may = {tuple(r) for r in may.collect()}
    assert all((name[a], name[b]) in may for a, b in pairs) and len(may) < 0.5 * len(rows) ** 2


def test_mixing(docs, empty, texts):
    got = mixing.taken(docs).collect()
    assert len(got) == len(texts) and sum(r["size"] for r in got) == sum(len(WORD.findall(x or "")) for _, x in texts)
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    by = defaultdict(lambda: [0, 0.0, 0])
    for r in got:
        s = by[r["row"]["source"]]
        s[0], s[1], s[2] = r["source_size"], r["target"], s[2] + r["taken"]
    assert abs(sum(s[1] for s in by.values()) - sum(s[0] for s in by.values())) < 1e-6
    for size, target, taken in by.values():
        assert target <= 3 * size + 1e-9 and abs(taken - target) <= max(0.02 * target, 2)
    again = sorted((r["row"]["doc_id"] or -1, r["taken"]) for r in mixing.taken(docs).collect())
    assert again == sorted((r["row"]["doc_id"] or -1, r["taken"]) for r in got)
    assert mixing.taken(empty).count() == 0
    assert mixing.mixed_documents(docs).columns == docs.columns


def test_mixing_by_brute_force(spark, docs):
    """``taken`` from the shuffled order, the blocks and the golden-ratio slots, in Python integers."""
    d, s, _, _ = mixing.schedule(docs)
    size = {r["source"]: r for r in s.collect()}
    laid = defaultdict(list)
    for r in d.where("size > 0").select("_id", "source", "size", "_h").collect():
        laid[r["source"]].append((r["_h"] % max(1, d.count() // mixing.CHUNK_DOCS), r["_h"], r["_id"], r["size"]))
    uses = {k: Counter() for k in size}
    rank = Counter()
    for slot in range(int(round(sum(r["target"] * r["blocks"] / r["source_size"] for r in size.values())))):
        u = slot * mixing.GOLDEN % 2**32 / 2**32
        k = next(k for k, r in size.items() if r["lo"] <= u < r["hi"])
        if rank[k] < 3 * size[k]["blocks"]:
            uses[k][rank[k] % size[k]["blocks"]] += 1
        rank[k] += 1
    want = {}
    for k, rows in laid.items():
        n, q = size[k]["source_size"], size[k]["blocks"]
        cuts = np.cumsum([0] + [n // q + (j < n % q) for j in range(q)])
        of = np.repeat([uses[k][j] for j in range(q)], np.diff(cuts))
        at = 0
        for _, _, i, m in sorted(rows):
            want[i] = int(of[at : at + m].sum())
            at += m
    got = mixing.taken(docs).select("row.doc_id", "taken").collect()
    ids = {r["_id"]: r["doc_id"] for r in d.select("_id", "row.doc_id").collect()}
    assert Counter((r["doc_id"], r["taken"]) for r in got) == Counter((i, want.get(k, 0)) for k, i in ids.items())


@pytest.mark.parametrize(("size", "blocks"), [(10, 3), (12, 4), (7, 7), (10**13 + 7, 4_882_812_501), (9 * 10**18, 10**9 + 9)])
def test_blocks_cover_a_source_of_any_size(spark, size, blocks):
    tokens = sorted({0, 1, size // 3, size // 2, size - 2, size - 1})
    df = spark.createDataFrame([(t, size, blocks) for t in tokens], "t long, source_size long, blocks long").withColumn("b", mixing.block_at("t"))
    for r in df.withColumn("lo", mixing.block_start("b")).withColumn("hi", mixing.block_start("(b + 1)")).collect():
        assert 0 <= r["b"] < blocks and r["lo"] <= r["t"] < r["hi"] and r["hi"] - r["lo"] in (size // blocks, size // blocks + 1)


def test_targets_fill_like_water(spark):
    sizes = {"a": 100, "b": 1, "c": 5, "d": 300, None: 2}
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    weight = dict(zip(sorted(sizes, key=lambda s: (s is None, s or "")), [1, 2, 3, 1, 2]))
    held: dict = {}
    while True:
        left = sum(sizes.values()) - sum(held.values())
        free = {s: left * w / sum(v for k, v in weight.items() if k not in held) for s, w in weight.items() if s not in held}
        over = {s: 3.0 * sizes[s] for s, t in free.items() if t > 3 * sizes[s]}
        if not over:
            break
        held |= over
    assert got == pytest.approx(held | free)


def test_packing(docs, empty, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    got = packing.pack(docs, queries.tokenizer_path(), with_ids=True).collect()
    per = defaultdict(list)
    for r in got:
        per[r["copy"]].append(r)
    assert len(per) == len(texts)
    want = Counter(tuple([*tok.encode(x or "", add_special_tokens=False).ids, 1]) for _, x in texts)
    have = Counter()
    for rs in per.values():
        rs.sort(key=lambda r: r["start"])
        assert [r["start"] for r in rs] == np.cumsum([0, *[r["length"] for r in rs[:-1]]]).tolist()
        ids = tuple(i for r in rs for i in r["ids"])
        assert all(r["doc_tokens"] == len(ids) and zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) == r["ids_crc32"] for r in rs)
        have[ids] += 1
    assert have == want
    seq = defaultdict(list)
    for r in got:
        seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for v in seq.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= packing.WINDOW
    assert packing.pack(empty, queries.tokenizer_path()).count() == 0


def test_differencing_is_balanced():
    sizes = np.random.default_rng(1).integers(1, 400, 600)
    sums = np.bincount(packing.difference(sizes, 40), weights=sizes, minlength=40)
    assert sums.sum() == sizes.sum() and sums.max() - sums.min() <= 60


def test_repeats(docs, empty, texts):
    raw = [(x or "").encode() for _, x in texts]
    seen = Counter(b[i : i + 200] for b in raw for i in range(len(b) - 199))
    want = Counter()
    for (d, _), b in zip(texts, raw):
        m = bytearray(len(b))
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                m[i : i + 200] = b"\1" * 200
        kept = bytes(x for x, y in zip(b, m) if not y)
        want[(d, len(b), sum(m), sum(1 for i in range(len(m)) if m[i] and (i == 0 or not m[i - 1])), hashlib.sha256(kept).hexdigest())] += 1
    assert Counter(tuple(r) for r in repeats.remove_repeats(docs).collect()) == want
    assert repeats.remove_repeats(empty).count() == 0


def test_top_k(spark):
    ship(spark)
    rng = np.random.default_rng(5)
    v = rng.normal(size=(300, 24)).astype(np.float32)
    v[50] = v[51] = v[52]
    rows = [(i, [float(x) for x in v[i]], 1) for i in range(300)] + [(400, None, 1), (420, [float("nan")] * 24, 1), (440, [], 1), (None, [1.0] * 24, 1), (460, [1.0] * 7, 1), (480, [2.0] * 7, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    q = np.floor(64 * v.astype(np.float64)).astype(np.int64)
    want = []
    for i in range(0, 300, 20):
        s = q @ q[i]
        order = [j for j in np.lexsort((np.arange(300), -s)) if j != i][:20]
        want += [(i, k + 1, int(j), int(s[j])) for k, j in enumerate(order)]
    want += [(460, 1, 480, 7 * 64 * 128), (480, 1, 460, 7 * 64 * 128)]
    assert got == want
    assert topk.top_k(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0


def test_lattice(docs, empty, texts):
    path = queries.tokenizer_path("piece_bpe_32k.model")
    got = lattice.score(docs, path).collect()
    assert len(got) == len(texts)
    train, ends = Counter(), 0
    for i, x in texts:
        if i is not None and zlib.crc32(str(i).encode()) % 7 != 2:
            train.update((x or "").encode().lower().split())
            ends += 1
    n, v = sum(train.values()) + ends, len(train) + 1
    base = lambda c: np.log10((c + 1) / (n + v + 1))
    want = sorted((i or -1, sum(base(train[w]) for w in (x or "").encode().lower().split()) + base(ends)) for i, x in texts)
    have = sorted((r["doc_id"] or -1, r["base_score"]) for r in got)
    assert [a for a, _ in have] == [a for a, _ in want] and np.allclose([b for _, b in have], [b for _, b in want])
    assert all(r["train_tokens"] == n and np.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert lattice.score(empty, path).count() == 0


def test_lattice_scores_known_words_by_their_spelling(spark):
    """A word's score is its marginal over segmentations whatever its count; only the mixture has the word itself as a path."""
    known = next(i for i in range(50) if zlib.crc32(str(i).encode()) % 7 != 2)
    df = spark.createDataFrame([(known, "zqxj " * 2000), (None, "zqxj"), (None, "zqxk"), (None, "")], "doc_id long, text string")
    got = {r["n_tokens"]: r for r in lattice.score(df, queries.tokenizer_path("piece_bpe_32k.model")).where("n_tokens > 2 or n_known = 2 or n_tokens = 1").collect()}
    one, end = got[2]["score"] - got[1]["score"], got[1]["score"]
    assert got[2001]["score"] - end == pytest.approx(2000 * one)
    assert got[2]["mixture_score"] > got[2]["score"] + 0.05


def test_row_numbers_do_not_follow_the_cores_alive(spark, tmp_path):
    from strataspark.llm.shared import stable

    spark.range(40_000).repartition(3).write.parquet(str(tmp_path / "t"))
    had = {k: spark.conf.get(k, None) for k in ("spark.sql.files.minPartitionNum", "spark.sql.leafNodeDefaultParallelism", "spark.sql.files.openCostInBytes")}
    number = lambda d: sorted(tuple(r) for r in d.select("id", F.monotonically_increasing_id()).collect())
    try:
        spark.conf.unset("spark.sql.files.minPartitionNum")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", "8")
        docs = stable(spark.read.parquet(str(tmp_path / "t")))
        first = number(docs)
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", "2")  # as after the loss of executors
        assert number(docs) == first
    finally:
        for k, v in had.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_lattice_holds_the_longest_pieces():
    names, logp = lattice.vocabulary(queries.tokenizer_path("piece_bpe_32k.model"))
    pieces = lattice.Pieces(names, logp)
    assert max(map(len, names)) == pieces.longest > 12
    at = names.index("international")
    code, length = lattice.codes(["xinternational"])
    i, _ = pieces.weights(lattice._hashes(code, length, pieces.longest), length)
    assert i[0, 1, 12] == at


def test_lattice_sums_all_segmentations():
    names, p = ["a", "b", "ab", "ba", "aba"], np.array([0.3, 0.2, 0.2, 0.2, 0.1])
    pieces = lattice.Pieces(names, np.log(p))
    code, length = lattice.codes(["aba", "ab"])
    _, w = pieces.weights(lattice._hashes(code, length), length)
    got, _ = lattice.forward(w, length, 0.0)
    assert np.allclose(np.exp(got), [0.3 * 0.2 * 0.3 + 0.2 * 0.3 + 0.3 * 0.2 + 0.1, 0.3 * 0.2 + 0.2], atol=1e-6)


def test_preference(spark):
    turns = [(0, 0, "user", "hi"), (0, 1, "assistant", "a"), (1, 0, "user", "hi"), (1, 1, "assistant", "b"), (1, 2, "user", None), (2, 0, "system", "s"), (None, 0, "user", "x"), (1, 2, "user", None)]
    df = spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, turns int")
    pairs = spark.createDataFrame([(0, 0, 1), (1, 2, 3)], "pair_id long, chosen_id long, rejected_id long")
    got = {r["pair_id"]: r for r in preference.format_pairs(df, pairs).collect()}
    assert got[0]["prompt"] == "<|user|>\nhi<|end|>\n" and got[0]["chosen"] == "<|assistant|>\na<|end|>\n" and got[0]["paired"]
    for side in ("chosen", "rejected"):
        t = got[0][side]
        assert [t[s["start"] : s["start"] + s["length"]] for s in got[0][f"{side}_mask"]] == [("a" if side == "chosen" else "b") + "<|end|>\n"]
    assert got[0]["rejected"].count("<|user|>") == 2
    assert not got[1]["paired"] and got[1]["rejected"] == ""
    assert preference.format_sides(preference.swapped(df.where("false"))).count() == 0


def test_preference_prefixes_by_brute_force(spark):
    """Random conversations that share prefixes of any length, some equal, some a prefix of the other."""
    rng = np.random.default_rng(6)
    role = lambda i: ("user", "assistant")[i % 2]
    convs, rows = {}, []
    for p in range(40):
        base = [(role(i), f"t{rng.integers(3)}") for i in range(rng.integers(0, 6))]
        for side in (0, 1):
            convs[2 * p + side] = base[: rng.integers(0, len(base) + 1)] + [(role(i), f"x{rng.integers(2)}") for i in range(rng.integers(0, 3))]
    rows = [(c, i, *t) for c, ts in convs.items() for i, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    pairs = spark.createDataFrame([(p, 2 * p, 2 * p + 1) for p in range(40)], "pair_id long, chosen_id long, rejected_id long")
    show = lambda ts: "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in ts)
    for r in preference.format_pairs(df, pairs).collect():
        a, b = convs[r["chosen_id"]], convs[r["rejected_id"]]
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert (r["prompt_turns"], r["prompt"], r["chosen"], r["rejected"]) == (n, show(a[:n]), show(a[n:]), show(b[n:]))
        assert r["equal"] == (r["paired"] and a == b)
        for text, mask, turns in ((r["chosen"], r["chosen_mask"], a[n:]), (r["rejected"], r["rejected_mask"], b[n:])):
            assert [text[m["start"] : m["start"] + m["length"]] for m in mask] == [t + "<|end|>\n" for who, t in turns if who == "assistant"]
    swapped = {r["chosen_id"]: r for r in preference.format_sides(preference.swapped(df)).collect()}
    for c, ts in convs.items():
        if ts:
            answers = [i for i, t in enumerate(ts) if t[0] == "assistant"]
            other = [t for who, t in convs.get(c + 1, []) if who == "assistant"]
            paired = bool(answers and other)
            assert swapped[c]["paired"] == paired
            if paired and other[-1] != ts[answers[-1]][1]:
                n = answers[-1]
                assert swapped[c]["prompt"] == show(ts[:n]) and swapped[c]["rejected"] == show([("assistant", other[-1]), *ts[n + 1 :]])


def test_preference_equal_answers_and_outermost_ids(spark):
    low, high = -(1 << 63), (1 << 63) - 1
    turns = [(low, "x"), (low + 1, "x"), (high - 1, "y"), (high, "z")]
    df = spark.createDataFrame([(c, i, r, t) for c, a in turns for i, (r, t) in enumerate((("user", "q"), ("assistant", a)))], "conv_id long, turn long, role string, text string")
    got = {r["chosen_id"]: r for r in preference.format_sides(preference.swapped(df)).collect()}
    same = got[low]
    assert same["paired"] and same["equal"] and (same["chosen"], same["rejected"], same["prompt_turns"]) == ("", "", 2)
    assert got[high - 1]["paired"] and not got[high - 1]["equal"] and got[high - 1]["rejected"] == "<|assistant|>\nz<|end|>\n"
    assert not got[high]["paired"] and not got[high]["equal"] and got[high]["rejected_id"] is None


def test_weak_labels(spark, docs, empty):
    rows = [(i, prose(i, 80) + (" trash idiot scum" if i % 4 == 0 else "")) for i in range(720)] + [(720 + i, "$$ ** " * 60) for i in range(20)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(0, 480)] + [(1, None, None)], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["row"]["doc_id"]: r["kept"] for r in weak.classify(df, labels).collect()}
    held = range(480, 720)
    assert np.mean([kept[i] == (i % 4 != 0) for i in held]) > 0.9
    assert not any(kept[i] for i in range(720, 740))
    assert weak.classify(docs, labels).count() == docs.count()
    assert weak.classify(docs, labels.where("false")).count() == docs.count()
    assert weak.classify(empty, labels).count() == 0


def test_em_finds_accuracies():
    rng = np.random.default_rng(2)
    truth = rng.random(6000) < 0.7
    acc = [0.9, 0.7, 0.6, 0.95]
    votes = np.stack([np.where(rng.random(6000) < a, truth, ~truth).astype(int) for a in acc], axis=1)
    votes[rng.random(6000) < 0.8, 3] = -1
    patterns, back, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    _, _, post = weak.fit_votes(patterns, counts.astype(float))
    assert np.mean((post[back.ravel()] > 0.5) == truth) > 0.88


def test_top_k_prunes_and_stays_exact():
    """Tiles of several strips and column blocks: the results are those of brute force, and the last level leaves few pairs."""
    rng = np.random.default_rng(8)
    v = np.floor(64 * rng.normal(size=(3000, 32)) / 6)
    ids, left = rng.permutation(3000), []
    q = np.flatnonzero(ids % 20 == 0)
    old, topk.COLUMNS = topk.COLUMNS, 1000
    try:
        i, j, s = topk.search(v[q], q, v, np.arange(3000), ids, 20, left)
    finally:
        topk.COLUMNS = old
    scores = v[q] @ v.T
    scores[np.arange(len(q)), q] = -np.inf
    for r in range(len(q)):
        order = np.lexsort((ids, -scores[r]))[:20]
        assert (j[i == r] == order).all() and (s[i == r] == scores[r][order]).all()
    assert left[0] == len(q) * 3000 and left[-1] < 0.3 * left[0]


def test_lattice_score_by_brute_force(spark, texts):
    """Without adaptation a text's score is, word by word, the sum over all ways to spell it, in plain Python."""
    import math
    from functools import cache

    rows = [(i, x) for i, x in texts if x is None or len(x) < 2000]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    path = queries.tokenizer_path("piece_bpe_32k.model")
    names, logp = lattice.vocabulary(path)
    p, stop = {n: math.exp(w) * 0.7 for n, w in zip(names, logp)}, 0.3
    train = [x for i, x in rows if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    n = sum(len((x or "").encode().lower().split()) for x in train) + len(train)
    end = (len(train) + 1) / (n + 2)

    @cache
    def spelt(word: str) -> float:
        sums = [1.0] + [0.0] * len(word)
        for j in range(1, len(word) + 1):
            sums[j] = sum(sums[i] * (p.get(word[i:j], 0.0) + (lattice.FLOOR / lattice.LETTERS if j - i == 1 else 0.0)) for i in range(max(0, j - 20), j))
        return sums[-1] * stop / (1 - stop) * (1 - end)

    want = Counter((i, round(sum(math.log10(spelt(w.decode())) for w in (x or "").encode().lower().split()) + math.log10(end), 6)) for i, x in rows)
    assert Counter((r["doc_id"], round(r["score"], 6)) for r in lattice.score(docs, path, iterations=0).collect()) == want


def test_lattice_of_very_long_words(spark):
    names, logp = lattice.vocabulary(queries.tokenizer_path("piece_bpe_32k.model"))
    pieces = lattice.Pieces(names, logp)
    for word in ("a", "international" * 30, "zq" * 9 + "é世"):
        code, length = lattice.codes([word])
        _, w = pieces.weights(lattice._hashes(code, length, pieces.longest), length)
        whole, _ = lattice.forward(w, length, -0.5)
        assert [lattice.forward_long(pieces, word, -0.5, size) for size in (1, 7, 1000)] == pytest.approx([whole[0]] * 3)
    df = spark.createDataFrame([(1, "abcde" * 40_000), (2, "a b")], "doc_id long, text string")
    assert all(np.isfinite(r["score"]) for r in lattice.score(df, queries.tokenizer_path("piece_bpe_32k.model")).collect())
