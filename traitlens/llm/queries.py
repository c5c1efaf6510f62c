"""One query per operator over its whole table, and SQL twins where SQL can express the result."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traitlens.llm import (
    bin_packing,
    jaccard_join,
    language_id,
    license_scan,
    line_blocks,
    periodic_runs,
    positional_index,
    prefix_trie,
    quality_rules,
    secret_ledger,
    substring_dedup,
    token_transducer,
    toxicity,
)
from traitlens.llm.common import held_out, new_folder, table, text_session
from traitlens.llm.oracles import ORACLES

__all__ = ["ORACLES", "QUERIES", "tokenizer_path"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def add(run: Callable[[SparkSession, str], DataFrame]):
        def ready(spark: SparkSession, folder: str) -> DataFrame:
            text_session(spark)
            return run(spark, folder)

        QUERIES[name] = ready
        return ready

    return add


def tokenizer_path(name: str) -> str:
    """A file of the installed public tokenizers; ``TOKENIZER_DIR`` names another folder with the same files."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op3_quality_rules")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query("op5_secret_ledger")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    ledger = secret_ledger.BlobLedger(spark, new_folder(spark, "ledger"))
    ledger.scan(docs)
    spans = F.col("__spans")
    base = F.filter(spans, lambda x: x["ord"] < len(secret_ledger.BASE_RULES))
    count = lambda kind: F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return ledger.joined(docs).select(
        "doc_id",
        *[count(r.kind) for r in secret_ledger.BASE_RULES],
        F.sha2(secret_ledger.span_text(base), 256).alias("base_sha256"),
        secret_ledger.span_text(spans).alias("spans"),
    )


@query("op9_best_fit_packing")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return bin_packing.pack(table(spark, folder, "documents"), tokenizer_path("word_bpe_49k.json"))


@query("op10_token_counts")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return token_transducer.token_counts(table(spark, folder, "documents"), tokenizer_path("piece_bpe_32k.model"))


@query("op4_positional_index")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    found = positional_index.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    listed = F.array_join(F.array_sort("items"), ",")
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(listed, 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


@query("op8_jaccard_join")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.similar_documents(table(spark, folder, "documents"))


@query("op7_substring_dedup")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.kept_words(table(spark, folder, "documents"))


@query("op1_line_blocks")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return line_blocks.main_texts(table(spark, folder, "pages"))


@query("op2_language_id")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    found = language_id.predicted(docs, language_id.train(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@query("op6_toxicity")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = toxicity.scored(docs, toxicity.train(docs, table(spark, folder, "labels")))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op11_prefix_trie")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.trie_nodes(table(spark, folder, "conversations"))


@query("op12_periodic_runs")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return periodic_runs.periodic_runs(table(spark, folder, "documents"))


@query("op13_license_scan")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.licenses(table(spark, folder, "documents"))
