"""Sharding by best-fit-decreasing bin packing: documents with equal texts stay together, shards have near-equal sizes.

Groups (equal texts) enter the shards from the largest to the smallest, each the one with the least room that still takes it;
rooms are kept in a balanced search tree. The capacity is the smallest at which every group finds room, so that no further
shard is opened.

Scale: sequential packing of all groups would be one task, so groups are packed level by level. Level 0 holds the groups of at
least 1 / SPREAD of a shard's fair share, level 1 those of at least 1 / SPREAD ** 2, and so on. A level is dealt by hash to
parts of about shards * SPREAD groups, however many there are (level l has at most SPREAD ** l such parts, so a group is never
larger than a part's share of a shard); each part packs its groups into its proportional share of the room that the levels
above have left. Small groups come last and even out what large ones leave. A task holds one part; the driver holds one
number a shard and level.

A group of more than a fair share (copies of one text may be a third of all rows) has a shard of its own, and the others share
the rest. Copies are counted before they are shuffled; rows meet their group's shard in a join that can be split, and slots
are prefix sums over chunks of rows, so no task holds a shard.

Defined cases: a null text counts as an empty one (size 1); repeated rows are rows of one group; groups of equal size enter in
the order of their hashes; with fewer groups than shards some shards stay empty; an empty table gives no rows; the input's other
columns play no part.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataspark.llm.mixing import _offsets
from strataspark.llm.shared import table

SHARDS = 8
SPREAD = 512
CHUNK_BITS = 16
LEAF = 64
MOST_SHARDS = 4096  # the rooms a task packs into


class Rooms:
    """Pairs (room, shard) in a B-tree of two levels: take the least one of at least a size, put it back with what is left."""

    def __init__(self, pairs: list[tuple[int, int]]):
        pairs = sorted(pairs)
        self.leaves = [pairs[i : i + LEAF // 2] for i in range(0, len(pairs), LEAF // 2)]
        self.tops = [leaf[-1] for leaf in self.leaves]

    def take(self, size: int) -> tuple[int, int] | None:
        i = bisect_left(self.tops, (size, -1))
        if i == len(self.tops):
            return None
        leaf = self.leaves[i]
        found = leaf.pop(bisect_left(leaf, (size, -1)))
        if leaf:
            self.tops[i] = leaf[-1]
        else:
            del self.leaves[i], self.tops[i]
        return found

    def put(self, pair: tuple[int, int]) -> None:
        if not self.leaves:
            self.leaves, self.tops = [[pair]], [pair]
            return
        i = min(bisect_left(self.tops, pair), len(self.tops) - 1)
        leaf = self.leaves[i]
        insort(leaf, pair)
        if len(leaf) > LEAF:
            self.leaves[i : i + 1] = [leaf[: LEAF // 2], leaf[LEAF // 2 :]]
            self.tops[i : i + 1] = [leaf[LEAF // 2 - 1], leaf[-1]]
        else:
            self.tops[i] = leaf[-1]


def best_fit(sizes: list[int], rooms: list[int]) -> list[int] | None:
    """The shard of each size (in falling order), or None if one finds no room."""
    tree, out = Rooms(list(zip(rooms, range(len(rooms))))), []
    for size in sizes:
        found = tree.take(size)
        if found is None:
            return None
        out.append(found[1])
        tree.put((found[0] - size, found[1]))
    return out


def fit(sizes: list[int], rooms: list[float]) -> list[int]:
    """Best fit at the smallest widening of all rooms (to about a sixteenth of it) at which every size is placed."""
    wide = lambda by: [int(r * (1 + by)) for r in rooms]
    out = best_fit(sizes, wide(0))
    low, high = 0.0, 2.0**-20
    while out is None:
        out = best_fit(sizes, wide(high))
        low, high = (low, high) if out is not None else (high, high * 4)
    while high - low > high / 16 and high > 2.0**-20:
        mid = (low + high) / 2
        better = best_fit(sizes, wide(mid))
        low, high, out = (mid, high, out) if better is None else (low, mid, better)
    return out


def level_rooms(filled: list[int], left: int) -> list[float]:
    """The room of each shard if ``left`` more is poured into the lowest ones until they stand level."""
    order = sorted(filled)
    for k in range(len(order), 0, -1):
        top = (left + sum(order[:k])) / k
        if top >= order[k - 1]:
            return [max(0.0, top - x) for x in filled]
    return [0.0] * len(filled)


def _packer(rooms: list[float], own: int, left: int, first: bool):
    """A function that packs a part of a level: ``own`` is the level's sum, ``left`` that of this level and all below. On the
    first level, 0, which is one part, groups of more than a fair share of what is left have a shard each."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "key"], ascending=[False, True], ignore_index=True)
        sizes, alone, rest = pdf["size"].tolist(), 0, left
        while first and alone < min(len(sizes), len(rooms) - 1) and sizes[alone] * (len(rooms) - alone) > rest:
            rest -= sizes[alone]
            alone += 1
        mine = [0.0] * alone + [rest / (len(rooms) - alone)] * (len(rooms) - alone) if first else [r * sum(sizes) / own for r in rooms]
        at = list(range(alone)) + fit(sizes[alone:], mine)
        return pd.DataFrame({"key": pdf["key"], "shard": np.array(at, dtype=np.int32), "size": pdf["size"]})

    return pack


def pack_groups(groups: DataFrame, shards: int = SHARDS, spread: int = SPREAD) -> DataFrame:
    """key, shard: the shard of each group. ``groups``: key (binary, distinct), size (long, 1 at least)."""
    if not 1 <= shards <= MOST_SHARDS:
        raise ValueError(f"shards must be from 1 to {MOST_SHARDS}")
    total = int(groups.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0])
    level, bound, bounds = F.lit(0), total, []
    while bound > 0:
        bound = total // (shards * spread ** (len(bounds) + 1))
        bounds.append(bound)
        level = level + F.when(F.col("size") < bound, 1).otherwise(0)
    leveled = groups.select("key", "size", level.alias("level"))
    sums = {r["level"]: (r["n"], int(r["s"])) for r in leveled.groupBy("level").agg(F.count("*").alias("n"), F.sum("size").alias("s")).collect()}
    out, filled, left = None, [0] * shards, total
    for k in sorted(sums):
        n, own = sums[k]
        parts = -(-n // (shards * spread)) if k else 1  # level 0 has less than twice shards * spread groups
        rooms = level_rooms(filled, left)

        part = F.pmod(F.xxhash64("key"), F.lit(parts)).alias("part")
        placed = table(leveled.where(F.col("level") == k).select("key", "size", part).groupBy("part").applyInPandas(_packer(rooms, own, left, k == 0), "key binary, shard int, size long"), "placed")
        out = placed if out is None else out.union(placed)
        for r in placed.groupBy("shard").agg(F.sum("size").alias("s")).collect():
            filled[r["shard"]] += int(r["s"])
        left -= own
    return (groups.select("key", F.lit(0).alias("shard")) if out is None else out).select("key", "shard")


def _rows(docs: DataFrame, text: str) -> DataFrame:
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("row"), (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t).alias("text_crc32"), F.unhex(F.sha2(t, 256)).alias("key"))
    return table(rows, "rows")


def _groups(rows: DataFrame) -> DataFrame:
    return table(rows.groupBy("key").agg(F.sum("size").alias("size")), "groups")


def _placed(rows: DataFrame, shards: DataFrame) -> DataFrame:
    """Each row with its group's shard and its slot there, in the order of the input's rows."""
    own = rows.join(shards, "key").select("doc_id", "size", "text_crc32", "shard", "row", F.shiftright("row", CHUNK_BITS).alias("chunk"))
    out = _offsets(table(own, "placed_rows"), "shard", "chunk", [F.col("row")], F.lit(1))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("before").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, spread: int = SPREAD, text: str = "text") -> DataFrame:
    """A row per document: doc_id, size (UTF-8 bytes of the text plus 1), text_crc32, law ('bytes'), shard (from 0), slot (gapless
    in its shard, from 0), grown_shard (null: this law says nothing of a further shard)."""
    rows = _rows(docs, text)
    return _placed(rows, pack_groups(_groups(rows), shards, spread))


def shard_by_capacity(docs: DataFrame, capacity: int, spread: int = SPREAD, text: str = "text") -> DataFrame:
    """As ``shard_documents``, with as few shards as best fit needs for at most ``capacity`` bytes each. A group that is larger
    than that has a shard of its own, over capacity."""
    rows = _rows(docs, text)
    groups = _groups(rows)
    large, rest = groups.agg(F.count_if(F.col("size") > capacity), F.coalesce(F.sum(F.when(F.col("size") <= capacity, F.col("size"))), F.lit(0))).first()
    shards = max(1, large + -(-int(rest) // capacity))
    while True:
        placed = pack_groups(groups, shards, spread)
        over = placed.join(groups, "key").groupBy("shard").agg(F.sum("size").alias("s"), F.count("*").alias("n")).where((F.col("s") > capacity) & (F.col("n") > 1))
        if over.isEmpty():
            return _placed(rows, placed)
        shards += 1
