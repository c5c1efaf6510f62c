"""Stand-ins for the analysis inputs, derived from the sample tables.

Documents play the entities: their letters are mapped onto a four-letter
alphabet and composition features are counted from the whole text.  Events play
held-out predictions, line items play contribution tables, embeddings play a
trainable task.  Only the catalogue of checked queries uses this module; the
operators take any table.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traitlens.functions.names import col
from traitlens.session import let_workers_import

LETTERS = string.ascii_lowercase
BASES = "ATGC"
PAIRS = [a + b for a in BASES for b in BASES]
VOWELS = "aeiou"
# The codons counted for two amino acids.
CODONS = {"S": ("TCT", "TCC", "TCA", "TCG", "AGT", "AGC"), "C": ("TGT", "TGC")}

ALPHABET_MAP = (LETTERS + LETTERS.upper(), "".join(BASES[i % 4] for i in range(26)) * 2)
_CONSONANTS = "".join(c for c in LETTERS if c not in VOWELS)
CODING_MAP = (
    _CONSONANTS + _CONSONANTS.upper() + VOWELS + VOWELS.upper(),
    "".join(BASES[i % 4] for i in range(len(_CONSONANTS))) * 2,
)

PAGE_HOST = '<html lang="([a-z]+)"'

SHAP_FEATURES = {
    "CpG_Coding": "(avg(l_quantity) - 25.5) / 10.0071913",
    "brCpG_Coding": "(avg(l_tax) - 0.04) * 15.0137719",
    "CG%_EntireGene": "(avg(l_extendedprice) - 38000) / 40009.7719",
    "TA%_Coding": "(max(l_quantity) - 45) / 25.0137113",
    "TpA_EntireGene": "(avg(l_discount) - 0.05) * 20.0113717",
    "GCcont_Coding": "(min(l_quantity) - 5) / 20.0117313",
    "S-Bias_Coding": "(max(l_extendedprice) - 90000) / 60007.3713",
}


def _count(text: Column, part: str) -> Column:
    """Non-overlapping occurrences of a short literal."""
    return (F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)


def part_one(s: Column) -> dict[str, Column]:
    """Content, pair bias and pair percent of a sequence."""
    size = F.length(s)
    n = {b: _count(s, b) for b in BASES}
    out = {
        "GCcont": F.try_divide(100.0 * (n["G"] + n["C"]), size),
        "ATcont": F.try_divide(100.0 * (n["A"] + n["T"]), size),
    }
    for p in PAIRS:
        out[f"{p[0]}p{p[1]}"] = F.try_divide(_count(s, p) * size, n[p[0]] * n[p[1]])
    for p in PAIRS:
        out[f"{p}%"] = F.try_divide(100.0 * _count(s, p), size - 1)
    return out


def part_two(t: Column) -> dict[str, Column]:
    """Bridge and non-bridge pairs, amino-acid and codon bias of a sequence whose
    codons each end in a comma."""
    codons = _count(t, ",")
    out = {f"br{p[0]}p{p[1]}": F.try_divide(_count(t, f"{p[0]},{p[1]}"), codons) for p in PAIRS}
    out |= {f"NonBr{p[0]}p{p[1]}": F.try_divide(_count(t, p), codons) for p in PAIRS}
    for amino, triplets in CODONS.items():
        total = sum((_count(t, c + ",") for c in triplets[1:]), _count(t, triplets[0] + ","))
        out[f"{amino}-Bias"] = F.try_divide(total, codons)
        for c in triplets:
            out[f"{c}-Bias"] = F.try_divide(len(triplets) * _count(t, c + ","), total)
    return out


class SampleData:
    """Frames over one folder of sample tables."""

    def __init__(self, spark: SparkSession, folder: str):
        let_workers_import(spark)
        self.spark = spark
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _texts(self, source: str) -> DataFrame:
        """(number, host, text) of documents or pages, spread over the cores when the file gives too few splits.

        A page's host is the language its markup names, so only some pages share host and number with a document.
        """
        if source == "documents":
            texts = self.table("documents").select(F.col("doc_id").alias("number"), F.col("lang").alias("host"), "text")
        else:
            texts = self.table("pages").select(F.col("page_id").alias("number"), F.regexp_extract("html", PAGE_HOST, 1).alias("host"), F.col("html").alias("text"))
        cores = self.spark.sparkContext.defaultParallelism
        return texts.repartition(cores, "number") if texts.rdd.getNumPartitions() < cores else texts

    @staticmethod
    def _gene(number: str) -> Column:
        return F.concat(F.lit("G"), F.lpad(F.col(number).cast("string"), 8, "0")).alias("Gene")

    def _sequences(self, mapping: tuple[str, str], source: str) -> DataFrame:
        letters = F.translate("text", *mapping)
        sequence = F.regexp_replace(letters, "[^ATGC]", "").alias("s")
        return self._texts(source).select(F.col("host").alias("HOST"), self._gene("number"), sequence)

    def part1_gene(self) -> DataFrame:
        df = self._sequences(ALPHABET_MAP, "documents")
        return df.select("HOST", "Gene", *[c.alias(n) for n, c in part_one(F.col("s")).items()])

    def part1_coding(self) -> DataFrame:
        df = self._sequences(CODING_MAP, "documents")
        return df.select("HOST", "Gene", *[c.alias(n) for n, c in part_one(F.col("s")).items()])

    def part2_coding(self) -> DataFrame:
        """As landed, from pages: SeqName holds gene and transcript."""
        df = self._sequences(CODING_MAP, "pages")
        df = df.withColumn("t", F.regexp_replace("s", "(...)", "$1,"))
        name = F.concat(F.lit(">"), F.col("Gene"), F.lit("|T"), F.substring("Gene", 2, 8)).alias("SeqName")
        return df.select("HOST", name, *[c.alias(n) for n, c in part_two(F.col("t")).items()])

    def metadata(self) -> DataFrame:
        """Identity table as landed: upper-case species code and expression terms."""
        docs = self.table("documents").select("doc_id", "lang", "n_chars")
        mean = docs.groupBy("lang").agg(F.avg("n_chars").alias("mean_chars"))
        term = (
            F.when(F.col("quality") == 0, "down_regulated").when(F.col("toxic") == 1, "up_regulated").otherwise("not_differentially_expressed")
        )
        return (
            self.table("labels")
            .join(docs, "doc_id")
            .join(mean, "lang")
            .select(
                F.upper("lang").alias("Species"),
                self._gene("doc_id").alias("ENSEMBL ID"),
                F.concat(F.lit("SYM"), F.col("doc_id").cast("string")).alias("Gene"),
                term.alias("Expression"),
                F.log2((F.col("n_chars") + 1) / F.col("mean_chars")).alias("log2 Fold Change"),
                (1.0 / (1.0 + F.col("n_chars"))).alias("FDR"),
            )
        )

    def predictions(self) -> DataFrame:
        """Held-out predictions: one row per event and replicate."""
        obs = F.when(F.col("event_type").isin("click", "view"), "Stimulated").otherwise("Repressed")
        events = self.table("events").select("event_id", obs.alias("obs"))
        reps = events.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(5))))
        right = (F.col("event_id") * 7 + F.col("rep") * 13) % 10 < 7
        other = F.when(F.col("obs") == "Stimulated", "Repressed").otherwise("Stimulated")
        resample = F.concat(
            F.lit("Fold"), (1 + (F.col("event_id") + F.col("rep") * 3) % 5).cast("string"), F.lit(".Rep"), F.lpad(F.col("rep").cast("string"), 2, "0")
        )
        return reps.select(F.col("event_id").alias("rowIndex"), "obs", F.when(right, F.col("obs")).otherwise(other).alias("pred"), resample.alias("Resample"))

    def prediction_data(self) -> DataFrame:
        """The rows the held-out predictions refer to."""
        label = F.when(F.col("event_type").isin("click", "view"), "Stimulated").otherwise("Repressed")
        return self.table("events").select(
            F.col("event_id").alias("rowIndex"),
            F.concat(F.lit("h"), (F.col("user_id") % 10).cast("string")).alias("Host"),
            F.concat(F.lit("E"), F.lpad(F.col("event_id").cast("string"), 8, "0")).alias("Gene"),
            label.alias("ExpressionCategory"),
            F.log2((F.col("value") + 1) / 36.0).alias("Log2FC"),
        )

    def contributions(self) -> DataFrame:
        """Long contribution table from per-part averages; unused rows are exact 0."""
        wide = self.table("lineitem").groupBy("l_partkey").agg(*[F.expr(e).alias(n) for n, e in SHAP_FEATURES.items()])
        value = F.when((F.col("RowID") % 11 == 0) & F.col("Feature").rlike("C(p)?G"), F.lit(0.0)).otherwise(F.col("Value"))
        long = wide.withColumnRenamed("l_partkey", "RowID").unpivot(["RowID"], [col(n) for n in SHAP_FEATURES], "Feature", "Value")
        return long.select("RowID", F.lit("Stimulated").alias("Label"), "Feature", value.alias("SHAP"))

    def contribution_data(self) -> DataFrame:
        """The rows the contributions refer to."""
        label = F.element_at(F.array(F.lit("Stimulated"), F.lit("NonDE"), F.lit("Repressed")), F.col("p_size") % 3 + 1)
        return self.table("part").select(
            F.col("p_partkey").alias("rowIndex"),
            F.col("p_brand").alias("Host"),
            F.concat(F.lit("P"), F.lpad(F.col("p_partkey").cast("string"), 8, "0")).alias("Gene"),
            label.alias("ExpressionCategory"),
            F.log2(F.col("p_retailprice") / 1000.0).alias("Log2FC"),
        )

    def trainable(self, classes: int = 2) -> tuple[DataFrame, list[str]]:
        """Embedding components as features with injected gaps, label from its class number."""
        features = [f"f{i:02d}" for i in range(64)]
        gap = lambda i: F.when(~((F.col("vec_id") + i) % 17 == 0), F.get("embedding", i).cast("double")) if i % 8 == 0 else F.get("embedding", i).cast("double")
        if classes == 2:
            label = F.when(F.col("label") < 5, "Stimulated").otherwise("Repressed")
        else:
            label = F.when(F.col("label") < 4, "NonDE").when(F.col("label") < 7, "Stimulated").otherwise("Repressed")
        df = self.table("embeddings").select(F.col("vec_id").alias("rowIndex"), label.alias("obs"), *[gap(i).alias(n) for i, n in enumerate(features)])
        return df, features


# ---- the same inputs as SQL -------------------------------------------------------------------


def _sql_count(text: str, part: str) -> str:
    return f"((length({text}) - length(replace({text}, '{part}', ''))) / {float(len(part))})"


def _sql_div(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


def part_one_sql(s: str) -> dict[str, str]:
    size = f"length({s})"
    n = {b: _sql_count(s, b) for b in BASES}
    out = {"GCcont": _sql_div(f"100.0 * ({n['G']} + {n['C']})", size), "ATcont": _sql_div(f"100.0 * ({n['A']} + {n['T']})", size)}
    for p in PAIRS:
        out[f"{p[0]}p{p[1]}"] = _sql_div(f"{_sql_count(s, p)} * {size}", f"{n[p[0]]} * {n[p[1]]}")
    for p in PAIRS:
        out[f"{p}%"] = _sql_div(f"100.0 * {_sql_count(s, p)}", f"{size} - 1")
    return out


def part_two_sql(t: str) -> dict[str, str]:
    codons = _sql_count(t, ",")
    out = {f"br{p[0]}p{p[1]}": _sql_div(_sql_count(t, f"{p[0]},{p[1]}"), codons) for p in PAIRS}
    out |= {f"NonBr{p[0]}p{p[1]}": _sql_div(_sql_count(t, p), codons) for p in PAIRS}
    for amino, triplets in CODONS.items():
        total = "(" + " + ".join(_sql_count(t, c + ",") for c in triplets) + ")"
        out[f"{amino}-Bias"] = _sql_div(total, codons)
        for c in triplets:
            out[f"{c}-Bias"] = _sql_div(f"{len(triplets)} * {_sql_count(t, c + ',')}", total)
    return out


def _sequence_sql(mapping: tuple[str, str], source: str) -> str:
    number, host, text = {"documents": ("doc_id", "lang", "text"), "pages": ("page_id", f"regexp_extract(html, '{PAGE_HOST}', 1)", "html")}[source]
    return (
        f"SELECT {host} AS HOST, 'G' || lpad(CAST({number} AS VARCHAR), 8, '0') AS Gene, "
        f"regexp_replace(translate({text}, '{mapping[0]}', '{mapping[1]}'), '[^ATGC]', '', 'g') AS s FROM {source}"
    )


def sql_columns(columns: dict[str, str], suffix: str = "") -> str:
    return ", ".join(f'{e} AS "{n}{suffix}"' for n, e in columns.items())


GENE_SQL = f"gene_seq AS ({_sequence_sql(ALPHABET_MAP, "documents")})"
CODING_SQL = f"coding_seq AS ({_sequence_sql(CODING_MAP, "documents")})"
CODON_SQL = (
    f"codon_raw AS ({_sequence_sql(CODING_MAP, "pages")}), "
    "codon_seq AS (SELECT HOST, Gene, regexp_replace(s, '(...)', '\\1,', 'g') AS t FROM codon_raw)"
)
METADATA_SQL = """
host_mean AS (SELECT lang, avg(n_chars) AS mean_chars FROM documents GROUP BY lang),
metadata AS (
  SELECT d.lang AS HOST, 'G' || lpad(CAST(d.doc_id AS VARCHAR), 8, '0') AS Gene,
         'SYM' || CAST(d.doc_id AS VARCHAR) AS Symbol,
         CASE WHEN l.quality = 0 THEN 'Repressed' WHEN l.toxic = 1 THEN 'Stimulated' ELSE 'NonDE' END AS ExpressionCategory,
         log2((d.n_chars + 1) / m.mean_chars) AS Log2FC, 1.0::DOUBLE / (1.0::DOUBLE + d.n_chars) AS FDR
  FROM labels l JOIN documents d USING (doc_id) JOIN host_mean m ON m.lang = d.lang)"""
PREDICTIONS_SQL = """
event_labels AS (
  SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'Stimulated' ELSE 'Repressed' END AS obs FROM events),
predictions AS (
  SELECT event_id AS rowIndex, obs,
         CASE WHEN (event_id * 7 + rep * 13) % 10 < 7 THEN obs
              WHEN obs = 'Stimulated' THEN 'Repressed' ELSE 'Stimulated' END AS pred,
         'Fold' || CAST(1 + (event_id + rep * 3) % 5 AS VARCHAR) AS Fold,
         'Rep' || lpad(CAST(rep AS VARCHAR), 2, '0') AS Replicate
  FROM event_labels, range(1, 6) AS r(rep)),
prediction_data AS (
  SELECT event_id AS rowIndex, 'h' || CAST(user_id % 10 AS VARCHAR) AS Host,
         'E' || lpad(CAST(event_id AS VARCHAR), 8, '0') AS Gene,
         CASE WHEN event_type IN ('click', 'view') THEN 'Stimulated' ELSE 'Repressed' END AS ExpressionCategory,
         log2((value + 1) / 36.0::DOUBLE) AS Log2FC
  FROM events)"""
_LONG = " UNION ALL ".join(f"""SELECT l_partkey AS RowID, '{n}' AS Feature, {e} AS v FROM lineitem GROUP BY l_partkey""" for n, e in SHAP_FEATURES.items())
CONTRIBUTIONS_SQL = f"""
shap_raw AS ({_LONG}),
contributions AS (
  SELECT RowID, 'Stimulated' AS Label, Feature,
         CASE WHEN RowID % 11 = 0 AND (Feature LIKE '%CpG%' OR Feature LIKE '%CG%') THEN 0.0 ELSE v END AS SHAP
  FROM shap_raw),
collapsed AS (
  SELECT RowID, Label,
         CASE Feature WHEN 'CpG_Coding' THEN 'CpG' WHEN 'brCpG_Coding' THEN 'CpG' WHEN 'CG%_EntireGene' THEN 'CpG'
                      WHEN 'TA%_Coding' THEN 'TpA' WHEN 'TpA_EntireGene' THEN 'TpA'
                      WHEN 'GCcont_Coding' THEN 'GCcont' ELSE 'S-Bias' END AS FeatureClass,
         sum(SHAP) AS SHAP
  FROM contributions GROUP BY ALL),
contribution_data AS (
  SELECT p_partkey AS rowIndex, p_brand AS Host, 'P' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS Gene,
         CASE p_size % 3 WHEN 0 THEN 'Stimulated' WHEN 1 THEN 'NonDE' ELSE 'Repressed' END AS ExpressionCategory,
         log2(p_retailprice / 1000.0::DOUBLE) AS Log2FC
  FROM part)"""
