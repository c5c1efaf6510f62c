"""From raw documents to packed training sequences, stage by stage.

Each stage takes the documents its predecessor kept and returns documents with
the same columns; the last returns the packed pieces.  Verdicts on texts hold for
rows, not ids: stages that drop rows after a shuffle number them first, so rows that
share an id, or have none, are judged each by its own text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traitlens.llm import bin_packing, jaccard_join, language_id, positional_index, secret_ledger
from traitlens.llm.common import new_folder, settle, table, text_session
from traitlens.llm.queries import tokenizer_path
from traitlens.sources.store import join_small

#: Texts whose language is less sure than this are rejected.
LEAST_LANGUAGE_SCORE = 0.2


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; texts without a letter go."""
    text_session(spark)
    model = language_id.train(docs.select("doc_id", "text", "lang"))
    return language_id.accepted(docs, model, LEAST_LANGUAGE_SCORE)


def numbered(docs: DataFrame) -> DataFrame:
    """The rows with a settled key of their own, ``__row``."""
    return settle(docs.withColumn("__row", F.monotonically_increasing_id()))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of each group of similar ones, rows without id last; of repeated rows one stays."""
    text_session(spark)
    rows = numbered(docs)
    found = settle(jaccard_join.similar_documents(rows, id_col="__row", unique_ids=True).where("n_links > 0").withColumnRenamed("doc_id", "__row"))
    first = lambda: F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row")).alias("first")
    linked = rows.select("__row", "doc_id").join(found.select("__row", "class_id"), "__row")
    winners = linked.groupBy("class_id").agg(first()).select("first.__row")
    # Texts without a word are similar to nothing; rows equal in id and text are still repeats.
    blank = rows.where(~F.coalesce("text", F.lit("")).rlike(r"[^ \t-\r]")).select("__row", "doc_id", F.sha2("text", 256).alias("text"))
    originals = blank.groupBy("doc_id", "text").agg(F.min("__row").alias("__row")).select("__row")
    dropped = settle(found.select("__row").join(winners, "__row", "left_anti").unionByName(blank.select("__row").join(originals, "__row", "left_anti")))
    return join_small(rows, dropped, ["__row"], "left_anti").select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark's passages: under 5 % of their words stand in matching windows."""
    text_session(spark)
    rows = numbered(docs)
    found = positional_index.contamination(rows, table(spark, sf_dir, "benchmark"), doc_id="__row")
    bad = settle(found.where("n_hit > 0 and 20 * n_hit >= n_words").select(F.col("doc_id").alias("__row")))
    return join_small(rows, bad, ["__row"], "left_anti").select(docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret."""
    ledger = secret_ledger.BlobLedger(spark, new_folder(spark, "ledger"))
    ledger.scan(docs)
    rows = ledger.joined(docs)
    hit = F.size("__spans") > 0
    rows = rows.withColumn("text", secret_ledger.redacted(F.col("text"), F.col("__spans")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(hit, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return rows.select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and offset."""
    text_session(spark)
    return bin_packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_languages),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: Trained models and tokenizers are not SQL; the tests hold the result against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
