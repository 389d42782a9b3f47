"""Quality rules as a ledger of failure bits.

Every rule is evaluated once per document: its measurement is stored and its failure sets one bit of ``fail_bits``.
A policy is a versioned mask over those bits, so policies are applied, compared and ablated by bitwise operations
on the ledger, without reading a text again.

The measuring pass is one Arrow map over the scan (no shuffle). Defined cases: a null or empty text has no words and
fails ``few_words``; rows are independent, so repeated rows, ties and empty tables need no rule; columns of the input
travel in the struct ``row`` and cannot clash with the ledger's own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataspark.llm import kernels as K

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks", "n_upper", "n_letters")


@dataclass(frozen=True)
class Rule:
    """A named failure test, in SQL over the measurements; the same text runs in any SQL engine."""

    name: str
    fails: str


#: Bit i of fail_bits belongs to RULES[i]; rules are only ever appended, so stored ledgers stay valid.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("short_or_long_words", "10 * word_chars < 20 * n_words or word_chars > 14 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("repeated_lines", "n_dup_lines >= 3 and 100 * n_dup_lines > 60 * n_lines"),
    Rule("marks", "10 * n_marks > 3 * n_words"),
    Rule("capitals", "n_letters > 0 and 100 * n_upper > 60 * n_letters"),
)
BASE = ("few_words", "repeated_windows")
#: Versioned policies: the rules whose failure rejects a document.
POLICIES = {
    "base": BASE,
    "v1": (*BASE, "symbols", "short_or_long_words"),
    "v2": tuple(r.name for r in RULES),
}


def mask(policy: str | tuple[str, ...]) -> int:
    names = POLICIES[policy] if isinstance(policy, str) else policy
    return sum(1 << i for i, r in enumerate(RULES) if r.name in names)


def _measure(data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    w = K.Words(data, off)
    lead = (data & 0xC0) != 0x80  # bytes that begin a code point
    symbol = np.isin(data, np.frombuffer(b"#*$%&|<>", dtype=np.uint8))
    marks = np.isin(data, np.frombuffer(b"!?", dtype=np.uint8))
    upper = (data >= 65) & (data <= 90)
    roll = K.Rolling(data)
    with np.errstate(over="ignore"):
        h, first = K.shingles(roll.of(w.start, w.end), w.first, 3)
        windows = np.where(w.count >= 3, w.count - 2, 0)
        doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
        often, _ = K.repeats(K.splitmix(h + doc.astype(K.U64) * K.U64(0x9E3779B97F4A7C15)))
        often &= windows[doc] > 0
        covered = np.zeros(len(w.start) + 2, dtype=bool)
        at = w.first[:-1][doc] + np.arange(len(doc)) - first[:-1][doc]
        for k in range(3):
            covered[np.where(often, at + k, len(w.start) + 1)] = True
        # Lines: a document's pieces between newlines; those with a word count.
        cuts = np.unique(np.concatenate([off[:-1], np.flatnonzero(data == 10) + 1]))
        cuts = cuts[cuts <= len(data)]
        line_doc = np.searchsorted(off, cuts, side="right") - 1
        inside = line_doc < len(off) - 1
        cuts, line_doc = cuts[inside], line_doc[inside]
        ends = np.minimum(np.append(cuts[1:], len(data)), off[line_doc + 1])
        closed = (ends > cuts) & (data[np.maximum(ends - 1, 0)] == 10) if len(data) else np.zeros(len(cuts), bool)
        ends = ends - closed
        filled = np.searchsorted(w.start, ends) > np.searchsorted(w.start, cuts)
        cuts, ends, line_doc = cuts[filled], ends[filled], line_doc[filled]
        _, later = K.repeats(K.splitmix(roll.of(cuts, ends) + line_doc.astype(K.U64) * K.U64(0x9E3779B97F4A7C15)))
    n = len(off) - 1
    return [
        w.count, K.per_doc(lead & w.ink, off), K.per_doc(symbol, off), np.bincount(line_doc[later], minlength=n),
        K.per_doc(covered[: len(w.start)], w.first), np.bincount(line_doc, minlength=n), K.per_doc(marks, off), K.per_doc(upper, off),
        K.per_doc(upper | ((data >= 97) & (data <= 122)), off),
    ]


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``row`` (all input columns as a struct) and one long per measurement."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, off in K.chunks(b.column(1)):
                cols = [pa.array(x.astype(np.int64)) for x in _measure(data, off)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *cols], names=["row", *MEASURES])

    packed = docs.select(F.struct("*").alias("row"), F.col(text).cast("string").alias("text"))
    kind = packed.schema["row"].dataType.simpleString()
    return packed.mapInArrow(run, f"row {kind}, " + ", ".join(f"{m} long" for m in MEASURES))


def bits() -> Column:
    """fail_bits: one pass over the measurements, one bit a rule."""
    return F.expr(" + ".join(f"case when {r.fails} then {1 << i}L else 0L end" for i, r in enumerate(RULES)))


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rule ledger: ``row``, the measurements and ``fail_bits``."""
    return measure(docs, text).withColumn("fail_bits", bits())


def verdict(policy: str | tuple[str, ...]) -> Column:
    """True where no rule of the policy failed."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def apply_policy(led: DataFrame, policy: str) -> DataFrame:
    """The input rows that the policy keeps, with the input's columns only."""
    return led.where(verdict(policy)).select("row.*")


def ablations(led: DataFrame, policy: str) -> DataFrame:
    """Per rule of the policy: its bit, documents it fails, documents that only it fails (what leaving it out would let back in).

    The ledger is first counted by distinct bit pattern (at most 2**rules rows), so the ablations read no document.
    """
    m = mask(policy)
    patterns = led.groupBy("fail_bits").agg(F.count("*").alias("docs"))
    rules = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, r in enumerate(RULES) if m >> i & 1])
    each = patterns.select("fail_bits", "docs", F.explode(rules).alias("r")).select("fail_bits", "docs", "r.*")
    hit = F.col("fail_bits").bitwiseAND(F.col("bit")) != 0
    only = F.col("fail_bits").bitwiseAND(F.lit(m).cast("long")) == F.col("bit")
    return each.groupBy("rule", "bit").agg(F.coalesce(F.sum(F.when(hit, F.col("docs"))), F.lit(0)).alias("fails"), F.coalesce(F.sum(F.when(only, F.col("docs"))), F.lit(0)).alias("only_this"))


def with_ablations(led: DataFrame, policy: str) -> DataFrame:
    """The ledger with ``blocking_rule``, the one rule of the policy that a document fails (null if it fails none or several), and
    ``let_back``, how many documents of the whole ledger leaving that rule out would let back in. A row a rule is broadcast."""
    rules = ablations(led, policy).select(F.col("rule").alias("blocking_rule"), F.col("bit").alias("_bit"), F.col("only_this").alias("let_back"))
    failed = F.col("fail_bits").bitwiseAND(F.lit(mask(policy)).cast("long"))
    return led.join(F.broadcast(rules), failed == F.col("_bit"), "left").drop("_bit")
