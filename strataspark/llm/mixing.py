"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame functions only.

Each source's documents are shuffled (by a seeded hash), laid end to end and cut into blocks of equal token counts.
Slots 0, 1, 2, ... of the mix take the golden-ratio points u_i = frac(i / golden ratio), which fall into the sources'
ranges of cumulative slot shares nearly evenly at every prefix; the r-th slot of a source takes its block r modulo its
number of blocks. So any prefix of the mix holds the sources in their target proportions.

Scale: token offsets and slot ranks are prefix sums over (source, chunk) totals, so no window holds more than one chunk
of a source and a source with a third of all rows is spread over many tasks. Slots meet sources by an equi-join on a
grid of u, never by a range join. Windows over sources hold one short row a source; up to a few million sources fit in a
task. Products that could leave 64 bits are avoided (blocks by quotient and remainder) or taken as decimals.

Defined cases: a null or empty text has size 0, takes part in nothing and is taken 0 times; a null source is a source
of its own (last in order); repeated rows (equal id and text) are separate documents; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataspark.llm.shared import table

WORD = r"[^\x20\x09-\x0D]+"
GOLDEN = 2654435769  # 2**32 / golden ratio
GRID = 4096  # cells of u by which slots meet sources
CHUNK_DOCS = 4096
CHUNK_SLOTS = 65536


def size_of(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def _shuffled(seed: int, id: str, text: str) -> Column:
    """A number of 60 bits by which documents are shuffled: of a hash that any SQL engine has."""
    key = F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(id).cast("string"), F.lit("")), F.coalesce(F.col(text).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, cap: int = 3) -> DataFrame:
    """Per source (source, source_size): ``target``, its share by weight 1, 2, 3, 1, ... of the sum of all sizes, at most
    ``cap`` times its size, with the excess reshared by weight among the others until none is above.

    The fixed point is a prefix of the sources by cap / weight that are held at their cap; the rest share what is left.
    ``sizes`` has a row a source. Windows here run over that dimension only.
    """
    every = W.partitionBy(F.lit(1))
    s = sizes.withColumn("w", (F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1)
    s = s.withColumn("cap", F.lit(cap) * F.col("source_size")).withColumn("all", F.sum("source_size").over(every)).withColumn("ws", F.sum("w").over(every))
    before = every.orderBy(F.expr("cap / cast(w as double)"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumn("cap0", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("w0", F.coalesce(F.sum("w").over(before), F.lit(0)))
    s = s.withColumn("held", F.expr("cast(all - cap0 as decimal(24, 0)) * cast(w as decimal(12, 0)) >= cast(cap as decimal(24, 0)) * cast(ws - w0 as decimal(12, 0))"))
    s = s.withColumn("held_cap", F.coalesce(F.sum(F.when(F.col("held"), F.col("cap"))).over(every), F.lit(0)))
    s = s.withColumn("free_w", F.col("ws") - F.coalesce(F.sum(F.when(F.col("held"), F.col("w"))).over(every), F.lit(0)))
    return s.select("source", "source_size", F.expr("case when held then cast(cap as double) else cast(w * (all - held_cap) as double) / free_w end").alias("target"))


def block_at(token: str) -> Column:
    """The block of a source's token by its number: ``source_size mod blocks`` blocks of one token more come first."""
    return F.expr(
        f"case when {token} < (source_size % blocks) * (source_size div blocks + 1) then {token} div (source_size div blocks + 1) "
        f"else source_size % blocks + ({token} - (source_size % blocks) * (source_size div blocks + 1)) div (source_size div blocks) end")  # fmt: skip


def block_start(block: str) -> Column:
    """The number of the first token of a block."""
    return F.expr(f"{block} * (source_size div blocks) + least({block}, source_size % blocks)")


def _offsets(df: DataFrame, key: str, chunk: str, order: list[Column], value: Column) -> DataFrame:
    """``before``: the sum of ``value`` over the rows of the same key that come earlier by (chunk, order)."""
    totals = df.groupBy(key, chunk).agg(F.sum(value).alias("_v"))
    run = W.partitionBy(key).orderBy(chunk).rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(F.col(key).alias("_k"), F.col(chunk).alias("_c"), F.coalesce(F.sum("_v").over(run), F.lit(0)).alias("_base"))
    inner = W.partitionBy(key, chunk).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    local = df.withColumn("_in", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return local.join(totals, local[key].eqNullSafe(F.col("_k")) & (local[chunk] == F.col("_c"))).withColumn("before", F.col("_base") + F.col("_in")).drop("_k", "_c", "_base", "_in")


def schedule(docs: DataFrame, cap: int = 3, block_tokens: int = 2048, per_source: int = 1000, seed: int = 7, text: str = "text", source: str = "source"):
    """(documents with sizes, sources with targets and blocks, pieces of documents in blocks, slots).

    ``block_tokens`` is the largest block; a mix of fewer than ``per_source`` such blocks a source gets smaller ones, so
    that targets are met to about one part in ``per_source`` at any size.
    """
    d = docs.select(F.struct("*").alias("row"), size_of(text).alias("size"), F.col(source).cast("string").alias("source"), _shuffled(seed, "doc_id", text).alias("_h"))
    d = table(d.withColumn("_id", F.monotonically_increasing_id()), "sized")
    sizes = d.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    t = targets(sizes.select("source", "source_size"), cap)
    n, total, largest = t.agg(F.count("*"), F.coalesce(F.sum("source_size"), F.lit(0)), F.lit(0)).first()
    block = max(1, min(block_tokens, total // max(1, n * per_source)))
    s = t.withColumn("blocks", F.ceil(F.col("source_size") / F.lit(block)).cast("long")).where("source_size > 0")
    every = W.partitionBy(F.lit(1))
    s = s.withColumn("share", F.expr("target * blocks / source_size"))
    upto = every.orderBy(F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, 0)
    s = s.withColumn("hi", F.sum("share").over(upto)).withColumn("lo", F.col("hi") - F.col("share")).withColumn("end", F.max("hi").over(every))
    s = table(s.withColumn("lo", F.col("lo") / F.col("end")).withColumn("hi", F.when(F.col("hi") >= F.col("end"), 1.0).otherwise(F.col("hi") / F.col("end"))), "sources")
    slots_n = int(round(s.agg(F.coalesce(F.max("end"), F.lit(0.0))).first()[0]))

    chunks = max(1, d.count() // CHUNK_DOCS)
    laid = _offsets(d.where("size > 0").select("_id", "source", "size", "_h", F.pmod("_h", F.lit(chunks)).alias("_chunk")), "source", "_chunk", [F.col("_h"), F.col("_id")], F.col("size"))
    src = s.select(F.col("source").alias("_s"), "source_size", "blocks")
    laid = laid.join(src, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    pieces = laid.withColumn("block", F.explode(F.sequence(block_at("before"), block_at("(before + size - 1)"))))
    lo, hi = block_start("block"), block_start("(block + 1)")
    pieces = pieces.select("_id", "source", "block", (F.greatest("before", lo) - F.col("before")).alias("start"), (F.least(F.col("before") + F.col("size"), hi) - F.greatest("before", lo)).alias("tokens")).where("tokens > 0")

    cells = s.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * GRID), F.least(F.floor(F.col("hi") * GRID), F.lit(GRID - 1))))).select(F.col("source"), "lo", "hi", "blocks", "cell")
    spark = docs.sparkSession
    i = spark.range(slots_n).withColumnRenamed("id", "slot")
    # frac(slot * GOLDEN / 2**32) in exact integers: the slot's low 32 bits as two halves keep products below 2**63.
    u = F.expr(f"pmod(pmod((pmod(slot, 4294967296) div 65536) * {GOLDEN}, 4294967296) * 65536 + pmod(slot, 65536) * {GOLDEN}, 4294967296) / 4294967296.0D")
    i = i.withColumn("u", u).withColumn("cell", F.floor(F.col("u") * GRID)).join(cells, "cell").where("u >= lo and u < hi")
    i = i.withColumn("_chunk", F.expr(f"slot div {CHUNK_SLOTS}"))
    slots = _offsets(i.select("slot", "source", "blocks", "_chunk"), "source", "_chunk", [F.col("slot")], F.lit(1)).withColumnRenamed("before", "rank")
    slots = slots.where(F.col("rank") < cap * F.col("blocks")).select("slot", "source", "rank", (F.col("rank") % F.col("blocks")).alias("block"))
    return d, s, pieces, slots


def taken(docs: DataFrame, cap: int = 3, **options) -> DataFrame:
    """Per document: ``row``, ``size``, ``source_size``, ``target`` of its source, ``taken`` words (repeats counted)."""
    d, s, pieces, slots = schedule(docs, cap, **options)
    uses = slots.groupBy(F.col("source").alias("_s"), F.col("block").alias("_b")).agg(F.count("*").alias("uses"))
    got = pieces.join(uses, F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b"))).groupBy("_id").agg(F.sum(F.col("tokens") * F.col("uses")).alias("taken"))
    every = targets(d.groupBy("source").agg(F.sum("size").alias("source_size")), cap).withColumnRenamed("source", "_s")
    out = d.join(got, "_id", "left").join(every, F.col("source").eqNullSafe(F.col("_s")))
    return out.select("row", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, cap: int = 3, seed: int = 7, text: str = "text", **options) -> DataFrame:
    """The mix as whole documents with the input's columns: each document as many times as its words were taken, the part
    of a copy that is left rounded up with the chance that it is of one (by a hash of the row), so that the sources keep
    their targets on average; never more than ``cap`` copies."""
    chance = F.pmod(F.xxhash64(F.lit(seed + 1), "row.doc_id", F.col("row").getField(text)), F.lit(1 << 20))
    copies = F.when(F.col("size") > 0, F.expr("(taken * 1048576 + _u * size) div (size * 1048576)")).otherwise(0).cast("int")
    got = taken(docs, cap, seed=seed, text=text, **options).withColumn("_u", chance)
    return got.withColumn("copy", F.explode(F.array_repeat(F.lit(0), copies))).select("row.*").select(*docs.columns)
