"""Scans, sinks, projections, filters and recodes over the sample tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traitlens.catalog.registry import NUDGE, query, r6, rounded, rounded_ratios, with_sql
from traitlens.functions import names, recode
from traitlens.functions.names import col
from traitlens.operators import cohorts, merging, ordering, reshape
from traitlens.sampledata import (
    CODING_SQL,
    CODON_SQL,
    GENE_SQL,
    METADATA_SQL,
    PREDICTIONS_SQL,
    SampleData,
    part_one_sql,
    part_two_sql,
)
from traitlens.operators.evaluation import prediction_export
from traitlens.sources import readers, store

P1, P2 = part_one_sql("s"), part_two_sql("t")


def _round_sql(columns: dict[str, str], wanted, suffix: str = "") -> str:
    return ", ".join(f'round({columns[n]} + {NUDGE}, 6) AS "{n}{suffix}"' for n in wanted)


def _scratch(data: SampleData) -> str:
    return f"{store.shared_root(data.spark).rstrip('/')}/scan-{uuid.uuid4().hex}"


def _land_ragged(df: DataFrame, path: str) -> str:
    """Write tab-separated text whose data lines end in a tab and whose header does not."""
    header = "\t".join(df.columns)
    line = F.concat(*[F.concat(F.coalesce(col(c).cast("string"), F.lit("NA")), F.lit("\t")) for c in df.columns])
    first_of_file = F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1)) == 0
    lines = df.select(line.alias("line"), first_of_file.alias("first"))
    lines.select(F.explode(F.when(F.col("first"), F.array(F.lit(header), F.col("line"))).otherwise(F.array("line"))).alias("value")).write.text(path)
    return path


@query(
    "scan_ragged_tsv",
    with_sql(CODON_SQL, body=f"""SELECT HOST, '>' || Gene || '|T' || substr(Gene, 2, 8) AS SeqName,
        {_round_sql(P2, ["brCpG", "NonBrCpG", "S-Bias", "TGC-Bias"])} FROM codon_seq"""),
)
def scan_ragged_tsv(data):
    part = data.part2_coding().select("HOST", "SeqName", "brCpG", "NonBrCpG", col("S-Bias"), col("TGC-Bias"))
    path = _land_ragged(part, _scratch(data))
    read = readers.read_ragged_tsv(data.spark, path, ("HOST", "SeqName"))
    return rounded_ratios(read, "brCpG", "NonBrCpG", "S-Bias", "TGC-Bias")


@query(
    "union_tagged_hosts",
    with_sql(GENE_SQL, body=f"""SELECT HOST, Gene, round({P1['GCcont']} + {NUDGE}, 6) AS "GCcont",
        CASE WHEN HOST = 'en' THEN round({P1['CpG']} + {NUDGE}, 6) END AS "CpG" FROM gene_seq"""),
)
def union_tagged_hosts(data):
    """One file set per host, of which only one has the second feature."""
    part = data.part1_gene().select("HOST", "Gene", "GCcont", "CpG")
    folder = _scratch(data)
    hosts = [r.HOST for r in part.select("HOST").distinct().orderBy("HOST").collect()]
    for host in hosts:
        own = part.where(F.col("HOST") == host).drop("HOST")
        _land_ragged(own if host == "en" else own.drop("CpG"), f"{folder}/{host}_cdna.txt")
    return rounded_ratios(readers.read_hosts(data.spark, hosts, "_cdna.txt", folder), "GCcont", "CpG")


@query(
    "null_token_cast",
    """WITH t AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'NA' WHEN event_id % 11 = 0 THEN '-'
         ELSE regexp_extract(props, '([0-9]+)', 1) END AS k FROM events)
       SELECT event_id, TRY_CAST(CASE WHEN k IN ('NA', '-', '') THEN NULL ELSE k END AS DOUBLE) AS k FROM t""",
)
def null_token_cast(data):
    token = F.when(F.col("event_id") % 7 == 0, "NA").when(F.col("event_id") % 11 == 0, "-").otherwise(F.regexp_extract("props", "([0-9]+)", 1))
    path = _scratch(data)
    data.table("events").select("event_id", token.alias("k")).write.option("header", True).csv(path)
    read = readers.read_strings_csv(data.spark, path, ["event_id", "k"])
    return readers.typed_nulls(read, ["k"]).withColumn("event_id", F.col("event_id").cast("long"))


@query(
    "artifact_roundtrip",
    with_sql(METADATA_SQL, body="SELECT Gene, ExpressionCategory, round(Log2FC, 6) AS Log2FC, 'run-a' AS runid, HOST FROM metadata"),
)
def artifact_roundtrip(data):
    """Two runs stored, one read back by partition."""
    rows = _clean_metadata(data).drop("FDR")
    root = _scratch(data)
    store.write_artifact(rows, root, "Data", "run-a")
    store.write_artifact(rows.withColumn("Log2FC", -F.col("Log2FC")), root, "Data", "run-b")
    return rounded(store.read_artifact(data.spark, root, "Data", "run-a"), "Log2FC")


@query(
    "csv_roundtrip",
    with_sql(PREDICTIONS_SQL, body="""SELECT Gene, Host AS Species, p.obs AS Observed, Fold, Replicate, pred AS Prediction
        FROM predictions p LEFT JOIN prediction_data d USING (rowIndex)"""),
)
def csv_roundtrip(data):
    exported = prediction_export(data.predictions(), data.prediction_data())
    path = store.write_csv(exported, _scratch(data))
    return data.spark.read.csv(path, header=True, schema=exported.schema, nullValue="NA")


def _renamed_metadata(data: SampleData) -> DataFrame:
    return data.metadata().select(
        F.col("Species").alias("HOST"),
        col("ENSEMBL ID").alias("Gene"),
        F.col("Expression").alias("ExpressionCategory"),
        col("log2 Fold Change").alias("Log2FC"),
        "FDR",
    )


def _clean_metadata(data: SampleData) -> DataFrame:
    hosts = {h.upper(): h for h in ("de", "en", "es", "fr")}
    return recode.recode_strict(_renamed_metadata(data), {"HOST": hosts, "ExpressionCategory": recode.EXPRESSION_TO_CLASS}).distinct()


@query(
    "select_rename",
    with_sql(METADATA_SQL, body="""SELECT upper(HOST) AS HOST, Gene,
        CASE ExpressionCategory WHEN 'Stimulated' THEN 'up_regulated' WHEN 'Repressed' THEN 'down_regulated'
        ELSE 'not_differentially_expressed' END AS ExpressionCategory,
        round(Log2FC, 6) AS Log2FC, round(FDR, 6) AS FDR FROM metadata"""),
)
def select_rename(data):
    return rounded(_renamed_metadata(data), "Log2FC", "FDR")


_SPECIES_SQL = "CASE c_nationkey % 10 " + " ".join(f"WHEN {i} THEN '{h}'" for i, h in enumerate(recode.SPECIES_TO_HOST.values())) + " END"
_TERM_SQL = "CASE c_custkey % 3 " + " ".join(f"WHEN {i} THEN '{h}'" for i, h in enumerate(recode.EXPRESSION_TO_CLASS.values())) + " END"


@query("recode_strict", f"SELECT c_custkey, {_SPECIES_SQL} AS HOST, {_TERM_SQL} AS ExpressionCategory FROM customer")
def recode_strict(data):
    pick = lambda values, at: F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))
    raw = data.table("customer").select(
        "c_custkey",
        pick(recode.SPECIES_TO_HOST, F.col("c_nationkey") % 10).alias("HOST"),
        pick(recode.EXPRESSION_TO_CLASS, F.col("c_custkey") % 3).alias("ExpressionCategory"),
    )
    return recode.recode_strict(raw, {"HOST": recode.SPECIES_TO_HOST, "ExpressionCategory": recode.EXPRESSION_TO_CLASS})


_FAMILY = [n for n in P2 if n.startswith("br") or n in ("S-Bias", "C-Bias")]


@query(
    "select_by_family",
    with_sql(CODON_SQL, body=f"SELECT HOST, '>' || Gene || '|T' || substr(Gene, 2, 8) AS SeqName, {_round_sql(P2, _FAMILY)} FROM codon_seq"),
)
def select_by_family(data):
    chosen = names.select_families(data.part2_coding(), ["HOST", "SeqName"], ["bridge_dinucleotide", "amino_acid_bias"])
    return rounded_ratios(chosen, *chosen.columns[2:])


@query(
    "suffix_columns",
    with_sql(GENE_SQL, body=f"SELECT HOST, Gene, {_round_sql(P1, ['GCcont', 'ATcont'], '_EntireGene')} FROM gene_seq"),
)
def suffix_columns(data):
    part = names.select_families(data.part1_gene(), ["HOST", "Gene"], ["nucleotide_content"])
    out = names.add_suffix(part, ["HOST", "Gene"], "_EntireGene")
    return rounded_ratios(out, *out.columns[2:])


_TO_T = ["ApT", "CpT", "GpT"]


@query("harmonise_names", with_sql(GENE_SQL, body=f"SELECT HOST, Gene, {_round_sql(P1, _TO_T)}, round({P1['TpT']} + {NUDGE}, 6) AS \"UpT\" FROM gene_seq"))
def harmonise_names(data):
    part = data.part1_gene().select("HOST", "Gene", F.col("ApT").alias("ApU"), F.col("CpT").alias("CpU"), F.col("GpT").alias("GpU"), F.col("TpT").alias("UpU"))
    return rounded_ratios(names.harmonise(part), *_TO_T, "UpT")


_KEPT = [n for n in P2 if not n.startswith(("br", "NonBr"))]


@query(
    "drop_by_prefix",
    with_sql(CODON_SQL, body=f"SELECT HOST, '>' || Gene || '|T' || substr(Gene, 2, 8) AS SeqName, {_round_sql(P2, _KEPT)} FROM codon_seq"),
)
def drop_by_prefix(data):
    return rounded_ratios(names.drop_prefixed(data.part2_coding(), "br", "NonBr"), *_KEPT)


@query(
    "case_recode",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 'NonDE' WHEN 'F' THEN 'Stimulated' ELSE 'Repressed' END AS ExpressionCategory,
       CASE o_orderstatus WHEN 'F' THEN 'Top 50 ISGs' WHEN 'P' THEN 'Random' END AS Category FROM orders""",
)
def case_recode(data):
    listed = F.when(F.col("o_orderstatus") == "P", "Random").when(F.col("o_orderstatus") == "F", "ISG").otherwise("other")
    rows = data.table("orders").select("o_orderkey", listed.alias("Class"))
    return rows.select("o_orderkey", recode.selected_class(F.col("Class")).alias("ExpressionCategory"), cohorts.list_category(F.col("Class")).alias("Category"))


def labelled_entities(data: SampleData) -> DataFrame:
    """Every document as an entity, with class and effect size where it has labels."""
    entities = data.table("documents").select(F.col("lang").alias("HOST"), data._gene("doc_id"), F.col("n_chars"))
    return entities.join(_clean_metadata(data), ["HOST", "Gene"], "left")


@query(
    "filter_predicates",
    with_sql(METADATA_SQL, body="""SELECT HOST, Gene, ExpressionCategory, round(Log2FC, 6) AS Log2FC FROM metadata
        WHERE ExpressionCategory <> 'NonDE' AND Log2FC IS NOT NULL AND Gene IS NOT NULL AND Gene <> 'NA' AND HOST IN ('en', 'de', 'fr')"""),
)
def filter_predicates(data):
    rows = labelled_entities(data).where(
        F.col("Log2FC").isNotNull() & (F.col("ExpressionCategory") != "NonDE") & F.col("Gene").isNotNull() & (F.col("Gene") != "NA") & F.col("HOST").isin("en", "de", "fr")
    )
    return rounded(rows.select("HOST", "Gene", "ExpressionCategory", "Log2FC"), "Log2FC")


@query(
    "stable_row_id",
    """SELECT row_number() OVER (ORDER BY lang, doc_id) AS rowIndex, lang AS HOST,
       'G' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS Gene FROM documents""",
)
def stable_row_id(data):
    entities = data.table("documents").select(F.col("lang").alias("HOST"), data._gene("doc_id"))
    return ordering.stable_row_id(entities, ["HOST", "Gene"])


@query(
    "ordered_category",
    """SELECT event_id, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 END::BIGINT AS level,
       CASE WHEN event_type IN ('view', 'click', 'purchase') THEN event_type END AS event_type FROM events""",
)
def ordered_category(data):
    levels = ("view", "click", "purchase")
    kind = F.col("event_type")
    return data.table("events").select("event_id", recode.ordinal(kind, levels).alias("level"), recode.restricted(kind, levels).alias("event_type"))


@query(
    "union_ragged",
    """SELECT c_custkey AS id, c_mktsegment AS segment, NULL::DOUBLE AS balance FROM customer
       UNION ALL SELECT s_suppkey, NULL, round(s_acctbal, 6) FROM supplier""",
)
def union_ragged(data):
    left = data.table("customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    right = data.table("supplier").select(F.col("s_suppkey").alias("id"), r6("s_acctbal", "balance"))
    return readers.union_ragged(left, right)


@query(
    "relabel_duplicate",
    """SELECT lang AS HOST, doc_id FROM documents UNION ALL SELECT 'biomart', doc_id FROM documents WHERE lang = 'en'""",
)
def relabel_duplicate(data):
    return reshape.relabelled_copy(data.table("documents").select(F.col("lang").alias("HOST"), "doc_id"), "HOST", "en", "biomart")


_LONG_FEATURES = ["CpG", "CG%", "GCcont"]


@query(
    "unpivot_features",
    with_sql(GENE_SQL, body=" UNION ALL ".join(f"SELECT HOST, Gene, '{n}' AS Feature, round({P1[n]} + {NUDGE}, 6) AS Value FROM gene_seq" for n in _LONG_FEATURES)),
)
def unpivot_features(data):
    return rounded_ratios(reshape.to_long(data.part1_gene(), ["HOST", "Gene"], _LONG_FEATURES), "Value")


@query(
    "pivot_classes",
    """SELECT l_orderkey, max(CASE WHEN l_returnflag = 'A' THEN q END) AS "A", max(CASE WHEN l_returnflag = 'N' THEN q END) AS "N",
         max(CASE WHEN l_returnflag = 'R' THEN q END) AS "R"
       FROM (SELECT l_orderkey, l_returnflag, sum(l_quantity) AS q FROM lineitem GROUP BY ALL) GROUP BY l_orderkey""",
)
def pivot_classes(data):
    long = data.table("lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.sum("l_quantity").alias("q"))
    return reshape.to_wide(long, ["l_orderkey"], "l_returnflag", "q", ["A", "N", "R"])


@query("split_identifier", "SELECT 'G' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS Gene, 'T' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS Transcript, lang AS HOST FROM documents")
def split_identifier(data):
    name = F.concat(F.lit(">"), data._gene("doc_id"), F.lit("|T"), F.lpad(F.col("doc_id").cast("string"), 8, "0"))
    return reshape.identifier_parts(data.table("documents").select(name.alias("SeqName"), F.col("lang").alias("HOST")))


@query("split_resample", with_sql(PREDICTIONS_SQL, body="SELECT rowIndex, obs, pred, Fold, Replicate FROM predictions"))
def split_resample(data):
    return reshape.resample_parts(data.predictions())


@query("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_discount FROM lineitem")
def distinct_rows(data):
    return data.table("lineitem").select("l_returnflag", "l_linestatus", "l_discount").distinct()


@query(
    "feature_class",
    """SELECT l_returnflag, l_linestatus, Feature, CASE Feature WHEN 'CG%_EntireGene' THEN 'CpG' WHEN 'brTpA_Coding' THEN 'TpA'
         WHEN 'NonBrCpG_Coding' THEN 'CpG' WHEN 'GCcont_Coding' THEN 'GCcont' ELSE 'TGC-Bias' END AS FeatureClass, n
       FROM (SELECT l_returnflag, l_linestatus, ['CG%_EntireGene', 'brTpA_Coding', 'NonBrCpG_Coding', 'GCcont_Coding', 'TGC-Bias_Coding'][1 + l_linenumber % 5] AS Feature,
             count(*) AS n FROM lineitem GROUP BY ALL)""",
)
def feature_class(data):
    spelled = ["CG%_EntireGene", "brTpA_Coding", "NonBrCpG_Coding", "GCcont_Coding", "TGC-Bias_Coding"]
    feature = F.element_at(F.array(*[F.lit(s) for s in spelled]), F.col("l_linenumber") % 5 + 1)
    counts = data.table("lineitem").groupBy("l_returnflag", "l_linestatus", feature.alias("Feature")).agg(F.count("*").alias("n"))
    return counts.select("l_returnflag", "l_linestatus", "Feature", names.feature_class(F.col("Feature")).alias("FeatureClass"), "n")


@query(
    "format_label",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'ISG' WHEN 'O' THEN 'IRG' ELSE 'NA' END || ' (' || o_orderpriority || ')' AS Label FROM orders""",
)
def format_label(data):
    category = F.when(F.col("o_orderstatus") == "F", "ISG").when(F.col("o_orderstatus") == "O", "IRG")
    return data.table("orders").select("o_orderkey", recode.labelled_treatment(category, F.col("o_orderpriority")).alias("Label"))


# ---- joins ------------------------------------------------------------------------------------


@query(
    "merge_full_outer",
    with_sql(GENE_SQL, CODING_SQL, CODON_SQL, body=f"""
        SELECT HOST, Gene, a."GCcont_Coding", b."GCcont_EntireGene", b."CpG_EntireGene", c."S-Bias_Coding"
        FROM (SELECT HOST, Gene, {_round_sql(P1, ['GCcont'], '_Coding')} FROM coding_seq) a
        FULL JOIN (SELECT HOST, Gene, {_round_sql(P1, ['GCcont', 'CpG'], '_EntireGene')} FROM gene_seq) b USING (HOST, Gene)
        FULL JOIN (SELECT HOST, Gene, {_round_sql(P2, ['S-Bias'], '_Coding')} FROM codon_seq) c USING (HOST, Gene)"""),
)
def merge_full_outer(data):
    keys = ["HOST", "Gene"]
    coding = names.add_suffix(data.part1_coding().select(*keys, "GCcont"), keys, "_Coding")
    gene = names.add_suffix(data.part1_gene().select(*keys, "GCcont", "CpG"), keys, "_EntireGene")
    codon = reshape.identifier_parts(data.part2_coding()).select("HOST", "Gene", col("S-Bias"))
    merged = merging.merge_outer([coding, gene, names.add_suffix(codon, keys, "_Coding")], keys)
    return rounded_ratios(merged, *merged.columns[2:])


# The kinds of event.
EVENT_TYPES = ("view", "click", "purchase", "signup", "error")


@query(
    "merge_null_safe",
    """WITH e AS (SELECT CASE WHEN value > 100 THEN NULL ELSE user_id END AS k, event_type FROM events),
       SELECT k, {counts} FROM e GROUP BY k""".replace("{counts}", ", ".join(f"nullif(count(*) FILTER (event_type = '{x}'), 0) AS n_{x}" for x in EVENT_TYPES)),
)
def merge_null_safe(data):
    events = data.table("events").select(F.when(F.col("value") <= 100, F.col("user_id")).alias("k"), "event_type")
    count = lambda kind: events.where(F.col("event_type") == kind).groupBy("k").agg(F.count("*").alias(f"n_{kind}"))
    return merging.merge_outer([count(kind) for kind in EVENT_TYPES], ["k"], null_safe=True)


@query(
    "enrich_left",
    with_sql(METADATA_SQL, body="""SELECT d.lang AS HOST, 'G' || lpad(CAST(d.doc_id AS VARCHAR), 8, '0') AS EnsemblID, m.Symbol AS Gene, d.source AS Species,
        upper(m.HOST) AS Species_other, round(m.Log2FC, 6) AS "log2 Fold Change" FROM documents d
        LEFT JOIN metadata m ON m.Gene = 'G' || lpad(CAST(d.doc_id AS VARCHAR), 8, '0')"""),
)
def enrich_left(data):
    entities = data.table("documents").select(F.col("lang").alias("HOST"), data._gene("doc_id").alias("EnsemblID"), F.col("source").alias("Species"))
    out = merging.enrich(entities, data.metadata().drop("Expression", "FDR"), {"EnsemblID": "ENSEMBL ID"})
    return rounded(out, "log2 Fold Change")


@query(
    "cohort_inner",
    with_sql(METADATA_SQL, body="""SELECT d.lang AS HOST, m.Gene, d.n_chars, m.ExpressionCategory AS ExpressionCategory
        FROM documents d JOIN metadata m ON m.Gene = 'G' || lpad(CAST(d.doc_id AS VARCHAR), 8, '0') AND m.HOST = d.lang"""),
)
def cohort_inner(data):
    listed = _clean_metadata(data).select("HOST", "Gene", "ExpressionCategory")
    entities = data.table("documents").select(F.col("lang").alias("HOST"), data._gene("doc_id"), "n_chars", F.lit("old").alias("ExpressionCategory"))
    return merging.listed_cohort(entities, listed, ["HOST", "Gene"], ["ExpressionCategory"])


@query(
    "feature_right_join",
    """WITH f AS (SELECT l_partkey AS RowID, 'avg_quantity' AS Feature, round(avg(l_quantity), 6) AS Value FROM lineitem GROUP BY l_partkey
         UNION ALL SELECT l_partkey, 'max_discount', max(l_discount) FROM lineitem GROUP BY l_partkey),
       brands AS (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand),
       top AS (SELECT 'avg_quantity' AS Feature, (SELECT count(*) FROM brands) AS n_brands UNION ALL SELECT 'missing', (SELECT count(*) FROM brands))
       SELECT RowID, Feature, Value, n_brands FROM f RIGHT JOIN top USING (Feature)""",
)
def feature_right_join(data):
    wide = data.table("lineitem").groupBy("l_partkey").agg(F.round(F.avg("l_quantity"), 6).alias("avg_quantity"), F.max("l_discount").alias("max_discount"))
    long = reshape.to_long(wide.withColumnRenamed("l_partkey", "RowID"), ["RowID"])
    top = data.table("part").agg(F.count_distinct("p_brand").alias("n_brands")).select(F.explode(F.array(F.lit("avg_quantity"), F.lit("missing"))).alias("Feature"), "n_brands")
    return long.join(top, "Feature", "right").select("RowID", "Feature", "Value", "n_brands")


@query(
    "overlap_semi_anti",
    """SELECT doc_id, 'listed' AS side FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)
       UNION ALL SELECT doc_id, 'stranger' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
)
def overlap_semi_anti(data):
    docs, labels = data.table("documents").select("doc_id"), data.table("labels")
    inside = merging.members(docs, labels, ["doc_id"]).withColumn("side", F.lit("listed"))
    return inside.unionByName(merging.strangers(docs, labels, ["doc_id"]).withColumn("side", F.lit("stranger")))


@query("key_violations", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def key_violations(data):
    return merging.key_violations(data.table("lineitem"), ["l_orderkey", "l_linenumber"])


@query("max_per_key", "SELECT l_partkey, max(l_extendedprice) AS MaxChange FROM lineitem GROUP BY l_partkey")
def max_per_key(data):
    return cohorts.best_per_key(data.table("lineitem"), "l_partkey", "l_extendedprice")


@query("scan_sanitised_csv", with_sql(METADATA_SQL, body=f"""SELECT upper(HOST) AS "Species", Gene AS "ENSEMBL_ID", Symbol AS "Gene",
    round(Log2FC + {NUDGE}, 6) AS "log2_Fold_Change" FROM metadata"""))
def scan_sanitised_csv(data):
    """The identity table landed as CSV and read with plain names."""
    wanted = ("Species", "ENSEMBL ID", "Gene", "log2 Fold Change")
    path = _scratch(data)
    data.metadata().select(*[col(c) for c in wanted]).write.csv(path, header=True)
    read = names.sanitised(readers.typed_nulls(readers.read_strings_csv(data.spark, path, wanted), ["log2 Fold Change"]))
    return rounded_ratios(read, "log2_Fold_Change")


@query("select_by_substring", with_sql(GENE_SQL, body=f"SELECT HOST, Gene, {_round_sql(P1, ['CpG', 'CG%'])} FROM gene_seq"))
def select_by_substring(data):
    """The columns whose name contains a part, whatever its case."""
    df = data.part1_gene()
    wanted = names.containing(df.columns, "cpg", "CG%")
    return rounded_ratios(df.select("HOST", "Gene", *[col(c) for c in wanted]), *wanted)


@query("explode_list_column", "SELECT vec_id, round(unnest(embedding)::DOUBLE, 6) AS component FROM embeddings")
def explode_list_column(data):
    """One row per element of a list column."""
    exploded = reshape.exploded_array(data.table("embeddings"), ["vec_id"], F.col("embedding"), "component")
    return rounded(exploded.withColumn("component", F.col("component").cast("double")), "component")
