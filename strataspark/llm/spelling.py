"""Spelling variants: pairs of words one edit apart by pivotal grams, each word's commoner form, and the form at the chain's end.

A word's bigrams are ordered by how rare they are in the vocabulary (then by their letters). Its prefix is all bigrams up
to the third in that order (q * tau + 1 of them, for bigrams and one edit; equal bigrams stay together); its two pivots are
disjoint bigrams of the prefix with the least total frequency, found by dynamic programming over positions: the cheapest
pair that ends at a bigram is that bigram and the cheapest one that ends before it. One edit touches at most one of two
disjoint bigrams. So of two words that are one edit apart, the one whose prefix ends earlier in the order has a pivot that
is whole in the other word, and that bigram is in the other's prefix.

Position limits: if the edit lies behind the pivot, all letters up to the pivot's end are the same and at the same place; if
it lies before, all letters from the pivot on are the same, shifted by the words' difference in length (-1, 0 or 1). So a
pivot is indexed by the letters on its unedited side and the other word's length, and a bigram of a prefix looks up just
that. Survivors are verified by their edit distance inside the join.

Scale: words are counted before anything else, so texts are not shuffled and a word that a third of all rows hold is a row a
task. All later work is on the vocabulary (distinct words with ``least`` occurrences). The bigram table has at most
(26 + 64) ** 2 rows, whatever the data, and is broadcast. The pivot join is a merge join of plain rows that adaptive
execution can split (never a broadcast: file sizes say nothing of exploded rows), and emits verified pairs only. Chains of forms are followed by pointer doubling: each step multiplies
the count by ``factor`` or more, so five rounds reach the end of any chain.

Defined cases: null and empty texts have no words; a null doc_id counts as an empty one in the slip's hash; repeated rows are
occurrences of their own; runs of any length are words like others; an empty table gives no rows; the input's other columns
play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataspark.llm.shared import table

LETTERS = "A-Za-zÀ-ÿ"
LEAST_LENGTH = 6
LEAST_COUNT = 5
FACTOR = 5
SLIP = 199
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def slipped(doc_id: Column, run: Column, every: int = SLIP) -> Column:
    """The run, without one of its letters where ``every`` divides the crc32 of ``<doc_id>:<run>`` (letter crc32 % length)."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    at = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, text: str = "text") -> DataFrame:
    """word, n: the words of at least ``least_length`` letters (1 at least) that occur ``least_count`` times or more."""
    # Greedy matches begin at the start of a run, so runs that are long enough are matched whole.
    runs = F.regexp_extract_all(F.translate(F.col(text).cast("string"), UPPER, LOWER), F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0))
    words = docs.select(F.col("doc_id"), F.explode(runs).alias("run")).select(slipped(F.col("doc_id"), F.col("run")).alias("word"))
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def pivots(words: DataFrame) -> DataFrame:
    """word, n, size (letters), last (where the prefix ends in the order of rarity), prefix (array of f, g, p: frequency, bigram,
    position from 0), a, b (positions of the two pivots). Words need at least four letters."""
    letters = F.split("word", "")
    pair = F.posexplode(F.zip_with(F.slice(letters, F.lit(1), F.size(letters) - 1), F.slice(letters, F.lit(2), F.size(letters) - 1), lambda x, y: F.concat(x, y)))
    grams = words.select("word", "n", pair.alias("p", "g"))
    often = grams.groupBy("g").agg(F.count("*").alias("f"))
    rare = grams.join(F.broadcast(often), "g").groupBy("word", "n").agg(F.array_sort(F.collect_list(F.struct("f", "g", "p"))).alias("grams"))
    rare = rare.select("word", "n", F.length("word").alias("size"), F.expr("struct(grams[2].f as f, grams[2].g as g)").alias("last"), "grams")
    rare = rare.withColumn("prefix", F.expr("filter(grams, x -> struct(x.f as f, x.g as g) <= last)")).drop("grams")
    one, two = "struct<f: bigint, p: int>", "struct<c: bigint, a: int, b: int>"
    # m: the cheapest bigram before the previous one; best: the cheapest pair so far.
    step = """named_struct('m', least(s.m, s.prev), 'prev', struct(y.f as f, y.p as p), 'best', least(s.best,
        transform(array(if(s.prev.p <= y.p - 2, least(s.m, s.prev), s.m)), x -> if(x is null, null, named_struct('c', x.f + y.f, 'a', x.p, 'b', y.p)))[0]))"""
    chosen = f"aggregate(array_sort(transform(prefix, x -> struct(x.p as p, x.f as f))), cast(null as struct<m: {one}, prev: {one}, best: {two}>), (s, y) -> {step}).best"
    return rare.withColumn("best", F.expr(chosen)).select("word", "n", "size", "last", "prefix", F.col("best.a").alias("a"), F.col("best.b").alias("b"))


def near_pairs(words: DataFrame) -> DataFrame:
    """a, na, b, nb: every pair of words (a < b) that differ by exactly one inserted, deleted or replaced letter, once."""
    sig = table(pivots(words), "pivots")
    before = lambda p: F.struct(F.lit(0).alias("side"), F.substring("word", F.lit(1), p + 2).alias("part"))
    behind = lambda p: F.struct(F.lit(1).alias("side"), F.substring("word", p + 1, F.col("size")).alias("part"))
    key = lambda k, size: F.xxhash64(k["side"], k["part"], size)
    kept = F.array(*[f(F.col(p)) for p in ("a", "b") for f in (before, behind)])
    one = sig.select("word", "n", "last", "size", F.explode(kept).alias("k")).withColumn("more", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))))
    one = one.select(key(F.col("k"), F.col("size") + F.col("more")).alias("key"), F.col("word").alias("x"), F.col("n").alias("nx"), F.col("last").alias("lx"))
    two = sig.select("word", "n", "last", "size", F.explode("prefix").alias("g")).withColumn("k", F.explode(F.array(before(F.col("g.p")), behind(F.col("g.p")))))
    two = two.select(key(F.col("k"), F.col("size")).alias("key"), F.col("word").alias("y"), F.col("n").alias("ny"), F.col("last").alias("ly"))
    # Where both prefixes end alike, both words find each other: one direction is enough.
    # By its file's size, Spark would broadcast one side, whose rows are exploded a dozen times: more than the driver holds.
    met = one.join(two.hint("merge"), "key").where("(lx < ly or (lx = ly and x < y)) and levenshtein(x, y, 1) = 1")
    less = F.col("x") < F.col("y")
    pick = lambda u, v: F.when(less, F.col(u)).otherwise(F.col(v))
    return met.select(pick("x", "y").alias("a"), pick("nx", "ny").alias("na"), pick("y", "x").alias("b"), pick("ny", "nx").alias("nb")).distinct()


def follow(forms: DataFrame, rounds: int = 8) -> DataFrame:
    """word, root: each ``form`` followed to the last one. ``forms`` (word, form) has no cycles."""
    forms = table(forms.select("word", "form"), "forms")
    at = forms.select("word", F.col("form").alias("root"))
    for _ in range(rounds):
        ends = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if at.join(ends, "root", "left_semi").isEmpty():
            return at
        at = table(at.join(ends, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    raise RuntimeError("forms did not settle")


def spelling_variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, factor: int = FACTOR, text: str = "text") -> DataFrame:
    """A row per word of the vocabulary: word, n, n_near (words one edit apart), form (the commonest of them, ties to the first
    in code-point order, if it is ``factor`` times as common; else null), form_n, root (the last form of the chain)."""
    words = table(vocabulary(docs, least_length, least_count, text), "words")
    pairs = table(near_pairs(words), "near")
    both = pairs.select(F.col("a").alias("word"), F.col("na").alias("n"), F.struct((-F.col("nb")).alias("m"), F.col("b").alias("w")).alias("other")).union(
        pairs.select("b", "nb", F.struct((-F.col("na")).alias("m"), F.col("a").alias("w"))))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min("other").alias("o"), F.first("n").alias("own"))
    best = table(best.select("word", "n_near", *[F.when(-F.col("o.m") >= factor * F.col("own"), c).alias(k) for k, c in (("form", F.col("o.w")), ("form_n", -F.col("o.m")))]), "best")
    roots = follow(best.where("form is not null"))
    out = words.join(best.hint("merge"), "word", "left").join(roots.hint("merge"), "word", "left")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))
