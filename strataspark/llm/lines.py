"""Fuzzy line deduplication by MinHash, in DataFrame functions only.

A line's shingles are its runs of SHINGLE characters. The signature reads all of them, whatever the script and with or
without white space: HASHES minima of their 64-bit hashes under XOR masks, in bands of ROWS. Lines that agree in a band
are candidates; candidates that agree in fewer than AGREE minima are let go (at similarity 0.8 that is one pair in a
thousand); the rest are confirmed by the exact Jaccard similarity of their full sets of distinct character shingles (a
line shorter than a shingle is one shingle). Components of confirmed lines keep the occurrence that is first by (doc_id,
line number).

Scale: lines with the same text are one row before anything else (pre-aggregated, so a line that a third of all documents
share costs a row a task). Shingles are exploded and hashed in generated code and aggregated in the partitioning that the
first aggregation left, without a second shuffle. Bands are counted before they are joined, so the few that have two lines
meet their lines in a join that can be split. Links are found in one linear round first: every line with its bands'
centers, at most BANDS of them (a round for the best one and one for the others would confirm few pairs less, but have
components found once more, a dozen steps whatever the size). Bands that hold two components after that are cut into blocks
of about BLOCK lines; a pair of blocks meets in one task, by signatures and bitmaps of all shingles at first (an exact
bound: most pairs a little below the threshold end there), then, with the texts of lines that have met another, each pair
of lines of different components in the first band they share, and only confirmed
links leave the task. Texts are fetched for candidates alone.

Defined cases: null and empty texts have no lines; blank lines are always kept and never compared; a null doc_id sorts
last; repeated rows of one document are repeated lines, of which one stays; very long lines are lines like any other;
an empty table gives no rows; the input's other columns are carried in a struct and cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataspark.llm.shared import components, matching, stable, table

SHINGLE = 8
BANDS = 6
ROWS = 3
HASHES = BANDS * ROWS
AGREE = 9  # of HASHES
STEP = 3  # shingles hashed for each generated row
LANE = 21  # bits of a minimum that are kept: a band's ROWS minima are the lanes of one long
PERCENT = 80
BLOCK = 256
WORDS = 64  # longs of a line's bitmap


def _mask(k: int) -> int:
    """The k-th XOR mask: golden-ratio multiples, spread over the high bits, as signed 64-bit numbers."""
    x = (k + 1) * 0x9E3779B97F4A7C15 % (1 << 64)
    return x - (1 << 64) if x >= 1 << 63 else x


def line_rows(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, row (a number of the input row), pos, line, h (the line's 64-bit hash): a row per line that is not blank."""
    # Rows are numbered before they are exploded: in one select the numbers would count lines.
    d = docs.select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("row"), F.col(text).cast("string").alias("text"))
    d = d.select("doc_id", "row", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return d.where(F.col("line").rlike(r"[^\x20\x09-\x0D]")).withColumn("h", F.xxhash64("line"))


def _full(line: Column) -> Column:
    """The hashes of all distinct character shingles: UTF-32 gives every character four bytes (big-endian, no mark), so each shingle
    is cut in one step. The encoded line is a lambda's variable, so that it is encoded once a line, not once a shingle."""
    last = F.greatest(F.length(line) - SHINGLE, F.lit(0))
    cut = lambda raw: F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.substring(raw, i * 4 + 1, F.lit(4 * SHINGLE))))
    return F.array_distinct(F.transform(F.array(F.encode(line, "UTF-32")), cut)[0])


def _alike(percent: int, x: str = "x", y: str = "y") -> Column:
    """Jaccard of the sets x and y at least ``percent``; sizes that cannot reach it (lengths cannot tell: repeated content
    has few shingles) are ruled out before the sets are compared."""
    nx, ny = F.size(x), F.size(y)
    return (100 * F.least(nx, ny) >= percent * F.greatest(nx, ny)) & ((100 + percent) * F.size(F.array_intersect(x, y)) >= percent * (nx + ny))


def signatures(lines: DataFrame) -> DataFrame:
    """h and b0, b1, ...: a row per distinct line, and the low LANE bits of each band's minima side by side in a long."""
    distinct = lines.groupBy("h").agg(F.min("line").alias("line"))
    raw = distinct.select("h", F.encode("line", "UTF-32").alias("raw"), F.greatest(F.length("line") - SHINGLE, F.lit(0)).alias("last"))
    # Rows of STEP shingles from a generator and hashes that are all compiled, unlike a lambda over an array.
    at = raw.select("h", "raw", "last", F.explode(F.sequence(F.lit(0), F.col("last"), F.lit(STEP))).alias("i"))
    cut = lambda j: F.substring("raw", F.least(F.col("i") + j, F.col("last")) * 4 + 1, F.lit(4 * SHINGLE))
    v = at.select("h", *[F.xxhash64(cut(j)).alias(f"v{j}") for j in range(STEP)])
    minima = [F.min(F.least(*[F.col(f"v{j}").bitwiseXOR(F.lit(_mask(i))) for j in range(STEP)])) for i in range(HASHES)]
    lane = lambda i: F.shiftleft(minima[i].bitwiseAND(F.lit((1 << LANE) - 1)), LANE * (i % ROWS))
    bands = []
    for b in range(BANDS):
        x = lane(b * ROWS)
        for r in range(1, ROWS):
            x = x.bitwiseOR(lane(b * ROWS + r))
        bands.append(x.alias(f"b{b}"))
    return v.groupBy("h").agg(*bands)


def _agree(x: str, y: str) -> Column:
    """The number of equal minima of two signatures: lanes of x XOR y that are zero, counted by carries within the lanes."""
    low = sum(((1 << (LANE - 1)) - 1) << (LANE * r) for r in range(ROWS))
    top = sum(1 << (LANE * r + LANE - 1) for r in range(ROWS))
    different = [f"bit_count(((({x}.b{b} ^ {y}.b{b}) & {low}L) + {low}L | ({x}.b{b} ^ {y}.b{b})) & {top}L)" for b in range(BANDS)]
    return F.expr(f"{HASHES} - ({' + '.join(different)})")


def _members(sig: DataFrame) -> DataFrame:
    """key, band, h, n: a row per line and band that two lines share; ``n`` is the number of the band's lines."""
    keys = F.array(*[F.struct(F.xxhash64(F.lit(b), F.col(f"b{b}")).alias("key"), F.lit(b).alias("band")) for b in range(BANDS)])
    keyed = sig.select("h", F.explode(keys).alias("k")).select("h", "k.key", "k.band")
    full = table(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "keys")
    return table(keyed.join(full.where("n > 1"), "key"), "members")


def _centers(members: DataFrame, weights: DataFrame) -> DataFrame:
    """key, a: each band's line whose bands have the most lines in all. Copies that were edited apart from each other are liker
    to what they are copies of, whose minima are the most common ones, than to any other of them."""
    best = members.join(weights, "h").groupBy("key").agg(F.max(F.struct("w", "h")).alias("m"))
    return best.select("key", F.col("m.h").alias("a"))


def _barrier(both: DataFrame, **columns: Column) -> DataFrame:
    """``both`` with further columns that Catalyst does not merge into a filter or join condition above (where they would be
    built again for every mention, in one method too large to be compiled)."""
    s = F.struct(*[c.alias(n) for n, c in columns.items()])
    rest = [c for c in both.columns if c not in columns]
    return both.select(*rest, F.explode(F.array(s)).alias("_s")).select(*rest, *[F.col(f"_s.{n}") for n in columns])


def _bitmaps(lines: DataFrame) -> DataFrame:
    """h, n (places of shingles: the number of distinct ones at most) and bits (w0, w1, ...): a row per distinct line; a shingle
    sets one of 64 * WORDS bits. Bits that two lines do not share are of shingles that they do not share."""
    raw = lines.select("h", F.encode("line", "UTF-32").alias("raw"), F.greatest(F.length("line") - SHINGLE, F.lit(0)).alias("last")).repartition("h")
    at = raw.select("h", "raw", (F.col("last") + 1).alias("n"), F.explode(F.sequence(F.lit(0), F.col("last"))).alias("i"))
    v = at.select("h", "n", F.xxhash64(F.substring("raw", F.col("i") * 4 + 1, F.lit(4 * SHINGLE))).alias("v"))
    # Eight words a row, then all words of a line: 64 at once for each shingle are work for one that is set.
    v = v.select("h", "n", F.expr("shiftright(v, 6) & 7").alias("w"), F.expr(f"pmod(shiftright(v, 9), {WORDS // 8})").alias("g"), F.expr("shiftleft(1L, cast(v & 63 as int))").alias("bit"))
    some = v.groupBy("h", "n", "g").agg(*[F.bit_or(F.when(F.col("w") == k, F.col("bit"))).alias(f"w{k}") for k in range(8)])
    words = [F.coalesce(F.max(F.when(F.col("g") == i // 8, F.col(f"w{i % 8}"))), F.lit(0).cast("long")).alias(f"w{i}") for i in range(WORDS)]
    return some.groupBy("h", "n").agg(*words).select("h", "n", F.struct(*[f"w{i}" for i in range(WORDS)]).alias("bits"))


def _bound(percent: int, nx: str, ny: str, x: str, y: str) -> Column:
    """False only for lines that cannot be alike: their sets differ in as many shingles at least as their bitmaps in bits."""
    different = " + ".join(f"bit_count({x}.w{i} ^ {y}.w{i})" for i in range(WORDS))
    return F.expr(f"{100 + percent} * ({different}) <= {100 - percent} * ({nx} + {ny})")


def _across(members: DataFrame, comp: DataFrame, cand: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Confirmed links (a, b) between lines of one band and different components, but for the band's center, which the linear
    round has compared with all others. ``members``: without centers; ``comp``: h, root; ``cand``: h, sig.

    Signatures and bitmaps meet first, in a semi-join that makes no pairs; only rows with something to be compared with get
    their text.
    """
    m = members.join(comp, "h", "left").withColumn("root", F.coalesce("root", "h"))
    keys = m.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.ceil(F.count("*") / BLOCK).alias("blocks")).where("lo < hi").select("key", "blocks")
    mixed = table(m.join(keys, "key").select("key", "band", "h", "root", "blocks"), "mixed")
    bits = table(_bitmaps(texts.join(mixed.select("h"), "h", "left_semi")), "bits")
    rows = mixed.join(cand, "h").join(bits, "h").withColumn("own", F.pmod(F.xxhash64("h"), F.col("blocks"))).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    rows = rows.select("key", F.least("own", "other").alias("s"), F.greatest("own", "other").alias("t"), "band", "h", "root", "own", "sig", "n", "bits")
    left = lambda df, *more: df.toDF("key", "s", "t", "band", "a", "ra", "oa", "p", "nx", "x", *more)
    right = lambda df, *more: df.toDF("k2", "s2", "t2", "band2", "b", "rb", "ob", "q", "ny", "y", *more)
    earlier = " or ".join(f"(band > {b} and p.b{b} = q.b{b})" for b in range(BANDS - 1))  # an earlier band that they share has them
    meet = F.expr("key = k2 and s = s2 and t = t2 and ra <> rb and (s = t or oa <> ob)") & (_agree("p", "q") >= AGREE) & F.expr(f"not ({earlier})")
    # Both sides read the same columns, so that rows are dealt once. The lambda keeps the condition out of the stage's method,
    # which the bitmaps would make too large to be compiled.
    meet = meet & F.expr("band <= band2 and exists(array(a), z -> z <> b)") & _bound(percent, "nx", "ny", "x", "y")
    dealt = rows.repartition("key", "s", "t")
    live = table(left(dealt).join(right(dealt).hint("merge"), meet, "left_semi").toDF(*rows.columns), "live")
    dealt = live.join(texts, "h").select(*live.columns, "line").repartition("key", "s", "t").withColumn("line", _full(F.col("line")))
    # One condition, dearest last: a filter on the join would be put before it.
    both = left(dealt, "full").join(right(dealt, "full2").hint("merge"), F.expr("a < b") & meet & _alike(percent, "full", "full2"))
    return both.select("a", "b")


def _confirm(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose lines have at least ``percent`` of all their shingles in common."""
    both = pairs.select("a", "b").join(texts.toDF("a", "la"), "a").join(texts.toDF("b", "lb"), "b")
    return table(_barrier(both, x=_full(F.col("la")), y=_full(F.col("lb"))).where(_alike(percent)).select("a", "b"), "links")


def links(lines: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Confirmed pairs (a, b) of line hashes that connect every component."""
    sig = table(signatures(lines), "signatures")
    members = _members(sig)
    some = table(members.groupBy("h").agg(F.sum("n").alias("w")), "weights")
    cand = table(matching(sig, some, "h").select("h", F.struct(*[f"b{i}" for i in range(BANDS)]).alias("sig")), "candidates")
    texts = table(matching(lines.select("h", "line"), some, "h").groupBy("h").agg(F.min("line").alias("line")), "texts")
    side = lambda h, c: cand.select(F.col("h").alias(h), F.col("sig").alias(c))
    near = lambda pairs: pairs.join(side("a", "p"), "a").join(side("b", "q"), "b").select("a", "b", _agree("p", "q").alias("c")).where(F.col("c") >= AGREE)

    around = table(members.join(_centers(members, some), "key").where("h <> a").select("key", "band", "h", "a"), "around")
    found = _confirm(near(around.select("a", F.col("h").alias("b")).distinct()), texts, percent)
    comp = components(found).select(F.col("node").alias("h"), "root")
    return found.union(table(_across(around, comp, cand, texts, percent), "links_across"))


def line_ledger(docs: DataFrame, percent: int = PERCENT, text: str = "text") -> DataFrame:
    """A row per line that is not blank: doc_id, row, pos, line_id (hash), component_id (smallest hash of the component),
    first_doc_id and first_pos (the component's first occurrence), kept (it is that occurrence)."""
    lines = line_rows(stable(docs), text)
    comp = components(links(lines, percent)).select(F.col("node").alias("h"), "root")
    place = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "row", "pos")
    seen = lines.groupBy("h").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    # Lines that occur once and are like no other need no look-up: they are their component's only occurrence.
    some = table(seen.join(comp, "h", "left").where("n > 1 or root is not null").select("h", F.coalesce("root", "h").alias("root"), "first"), "repeated")
    best = some.groupBy("root").agg(F.min("first").alias("best"))
    keeper = some.join(best, "root").select("h", "root", "best")
    out = lines.select("doc_id", "row", "pos", "h").join(keeper, "h", "left").withColumn("best", F.coalesce("best", place))
    return out.select(
        "doc_id", "row", "pos", F.col("h").alias("line_id"), F.coalesce("root", "h").alias("component_id"), F.col("best.doc_id").alias("first_doc_id"), F.col("best.pos").alias("first_pos"), (place == F.col("best")).alias("kept"))


def dedup_lines(docs: DataFrame, percent: int = PERCENT, text: str = "text") -> DataFrame:
    """The documents without the lines that repeat, exactly or nearly, an earlier one. Documents of which no line with a
    word is left go; those that had none from the start stay as they are. Columns as in the input."""
    docs = stable(docs)
    packed = docs.select(F.struct("*").alias("in"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("row"))
    gone = line_ledger(docs, percent, text).groupBy("row").agg(F.collect_list(F.when(~F.col("kept"), F.col("pos"))).alias("gone"), F.count_if("kept").alias("left")).where("size(gone) > 0")
    out = packed.join(gone, "row", "left").where("left is null or left > 0")
    # The places left, in order, by a set difference: linear in a document's lines.
    kept = lambda ls: F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("gone")), lambda i: F.get(ls, i))
    new = F.array_join(F.transform(F.array(F.split("text", "\n", -1)), kept)[0], "\n")
    return out.select(F.col("in").withField(text, F.when(F.col("gone").isNull(), F.col("text")).otherwise(new)).alias("in")).select("in.*").select(*docs.columns)
