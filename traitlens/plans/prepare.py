"""From landed files to one merged row per entity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traitlens.functions.names import PART_ONE_FAMILIES, PART_TWO_FAMILIES, add_suffix, col, select_families
from traitlens.functions.recode import EXPRESSION_TO_CLASS, SPECIES_TO_HOST, recode_strict
from traitlens.operators.merging import merge_outer, require_unique
from traitlens.operators.reshape import identifier_parts, relabelled_copy
from traitlens.sources.readers import read_hosts, read_strings_csv, typed_nulls

KEYS = ("HOST", "Gene")

# File name endings of the three feature inputs, and the identity table's columns.
PART_ONE_CODING, PART_ONE_GENE, PART_TWO = "_cds_new_dat_fpkm_dups.txt", "_cdna_new_dat_fpkm_dups.txt", "_cds_new_cpb_dat_dups.txt"
IDENTITY_COLUMNS = ("Species", "ENSEMBL ID", "Gene", "Expression", "log2 Fold Change", "FDR")


def clean_identities(raw: DataFrame, species: dict[str, str] = SPECIES_TO_HOST, duplicate_for: tuple[str, str] | None = None) -> DataFrame:
    """Rename, recode both vocabularies or fail, deduplicate, and copy one host
    under a second name when its features come from another source."""
    renamed = raw.select(
        F.col("Species").alias("HOST"),
        col("ENSEMBL ID").alias("Gene"),
        F.col("Expression").alias("ExpressionCategory"),
        col("log2 Fold Change").alias("Log2FC"),
        "FDR",
    )
    clean = recode_strict(renamed, {"HOST": species, "ExpressionCategory": EXPRESSION_TO_CLASS}).distinct()
    return relabelled_copy(clean, "HOST", *duplicate_for) if duplicate_for else clean


def merge_features(coding: DataFrame, gene: DataFrame, codon: DataFrame, identities: DataFrame, unique_on: Sequence[str] | None = ("Gene",)) -> DataFrame:
    """Select families, name them by source, outer-merge, add classes.

    All joins share the key (HOST, Gene).  ``unique_on`` names the columns that
    must identify a row; None leaves the check to the caller, for instance on
    the written table.
    """
    keys = list(KEYS)
    parts = [
        add_suffix(select_families(coding, keys, PART_ONE_FAMILIES), keys, "_Coding"),
        add_suffix(select_families(gene, keys, PART_ONE_FAMILIES), keys, "_EntireGene"),
        add_suffix(select_families(identifier_parts(codon), keys, PART_TWO_FAMILIES), keys, "_Coding"),
    ]
    merged = merge_outer(parts, keys).join(identities, keys, "left")
    if unique_on is not None:
        require_unique(merged, unique_on)
    return merged


def merged_files(spark: SparkSession, hosts: Sequence[str], part_one_dir: str, part_two_dir: str, identity_path: str, species: dict[str, str] = SPECIES_TO_HOST) -> DataFrame:
    """Scan, clean and merge the files of the hosts; nothing is checked or written."""
    raw = typed_nulls(read_strings_csv(spark, identity_path, IDENTITY_COLUMNS), ["log2 Fold Change", "FDR"])
    copy = ("human", "biomart") if "biomart" in hosts else None
    return merge_features(
        read_hosts(spark, hosts, PART_ONE_CODING, part_one_dir),
        read_hosts(spark, hosts, PART_ONE_GENE, part_one_dir),
        read_hosts(spark, hosts, PART_TWO, part_two_dir),
        clean_identities(raw, species, copy),
        unique_on=None,
    )


def prepare_input(spark: SparkSession, hosts: Sequence[str], part_one_dir: str, part_two_dir: str, identity_path: str, out: str, unique_on: Sequence[str] = ("Gene",)) -> DataFrame:
    """The whole preparation: scan, clean, merge, write by host, check the written table."""
    merged = merged_files(spark, hosts, part_one_dir, part_two_dir, identity_path)
    merged.write.mode("errorifexists").partitionBy("HOST").parquet(out)
    written = spark.read.parquet(out)
    require_unique(written, unique_on)
    return written
