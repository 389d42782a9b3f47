"""The registered queries of the corpus operators: production parameters over whole tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspark.llm.shared import documents, table
from strataspark.session import ship


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_lattice_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataspark.llm.lattice import score

    return score(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))


def op2_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataspark.llm import quality as q

    led = q.ledger(documents(spark, sf_dir).select("doc_id", "text"))
    led = table(led.select("row.doc_id", *q.MEASURES, "fail_bits"), "ledger")
    cols = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return q.with_ablations(led, "v2").select(*cols, (~q.verdict("base")).alias("base_failed"), q.verdict("v2").alias("kept"), "fail_bits", q.verdict("v1").alias("kept_v1"), "blocking_rule", "let_back")


def op3_segment_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataspark.llm.topk import top_k

    ship(spark)
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


def op4_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataspark.llm.lines import line_ledger

    return line_ledger(documents(spark, sf_dir)).select("doc_id", "pos", "first_doc_id", "first_pos", "kept")


def op5_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataspark.llm.weak import classify

    return classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")).select("row.doc_id", "posterior", "score", "kept")


def op6_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataspark.llm.near import near_duplicates

    return near_duplicates(documents(spark, sf_dir), size=3, percent=85)


def op7_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataspark.llm import preference as p

    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("+", s["start"].cast("string"), s["length"].cast("string"))), ",").alias(c)
    out = p.format_sides(p.swapped(turns))
    return out.select("pair_id", "chosen_id", "rejected_id", "paired", "equal", "prompt_turns", "prompt", "chosen", spans("chosen_mask"), "rejected", spans("rejected_mask"))


def op8_source_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataspark.llm.mixing import taken

    return taken(documents(spark, sf_dir)).select("row.doc_id", "size", "source_size", "target", "taken")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataspark.llm.packing import pack

    return pack(documents(spark, sf_dir), tokenizer_path()).drop("copy")


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataspark.llm.repeats import remove_repeats

    return remove_repeats(documents(spark, sf_dir))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataspark.llm.align import align_tokens

    return align_tokens(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op12_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataspark.llm.shards import shard_documents

    return shard_documents(documents(spark, sf_dir))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataspark.llm.spelling import spelling_variants

    return spelling_variants(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    from strataspark.llm import oracles

    return {k: v for k, v in vars(oracles).items() if k.startswith("op") and isinstance(v, str)}
