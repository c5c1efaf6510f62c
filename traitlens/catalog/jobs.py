"""Whole jobs over files landed from the sample tables: prepare, train, report, hold out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traitlens.catalog.registry import NUDGE, query, rounded, rounded_ratios, with_sql
from traitlens.catalog.searches import _REFIT_SQL, _STUMPS, _left
from traitlens.catalog.tables import P1, P2, _land_ragged
from traitlens.functions.names import col
from traitlens.plans import jobs, prepare
from traitlens.sampledata import CODING_SQL, CODON_SQL, GENE_SQL, METADATA_SQL
from traitlens.sources.models import ModelStore
from traitlens.sources.stages import Stages
from traitlens.sources.store import new_shared_folder, settle

# Values are cut to whole steps, so that every distinct value is a bin of its own and plain SQL finds the same splits.
_CONTENT_SQL = f"floor(({P1['GCcont']}) / 2 + 1e-9::DOUBLE) * 2"
_BRIDGE_SQL = f"least(floor(({P2['brCpG']}) * 100 + 1e-9::DOUBLE), 50)"


def _content(df: DataFrame) -> DataFrame:
    return settle(df.select("HOST", "Gene", (F.floor(F.col("GCcont") / 2 + 1e-9) * 2).cast("double").alias("GCcont")))


def _bridge(df: DataFrame) -> DataFrame:
    return settle(df.select("HOST", "SeqName", F.least(F.floor(F.col("brCpG") * 100 + 1e-9), F.lit(50)).cast("double").alias("brCpG")))


class _Landed:
    """The files of the jobs, written from the whole sample tables: three per host, identities, and a population held out."""

    def __init__(self, data):
        self.root = new_shared_folder(data.spark, "landed")
        self.coding, self.gene, self.codon = _content(data.part1_coding()), _content(data.part1_gene()), _bridge(data.part2_coding())
        self.hosts = sorted(r.HOST for r in self.coding.select("HOST").where("HOST is not null").distinct().collect())
        endings = {prepare.PART_ONE_CODING: self.coding, prepare.PART_ONE_GENE: self.gene, prepare.PART_TWO: self.codon}
        for host in self.hosts:
            for ending, df in endings.items():
                _land_ragged(df.where(F.col("HOST") == host).drop("HOST"), f"{self.root}/{host}{ending}")
        self.identities = f"{self.root}/identities.csv"
        data.metadata().select(*[col(c) for c in prepare.IDENTITY_COLUMNS]).write.csv(self.identities, header=True, nullValue="NA")

    def hold_out(self, data) -> list[str]:
        """Changes of the documents without a label, some measured twice, and the features of all."""
        unseen = data.table("documents").join(data.table("labels"), "doc_id", "left_anti").select(data._gene("doc_id"), F.col("n_chars").alias("change"))
        twice = F.array(F.col("change"), F.col("change") - 1)
        measured = unseen.select(F.col("Gene").alias("Ensembl ID"), F.explode(F.when(F.col("change") % 3 == 0, twice).otherwise(F.array("change"))).alias("Fold Change"))
        paths = [f"{self.root}/{name}" for name in ("measured.csv", "cds.txt", "cds_cg.txt", "cdna_ncrna.txt")]
        measured.write.csv(paths[0], header=True)
        for path, df in zip(paths[1:], (self.codon, self.coding, self.gene)):
            _land_ragged(df.drop("HOST"), path)
        return paths


def _prepared(data, stages: Stages, landed: _Landed):
    species = {h.upper(): h for h in landed.hosts}
    return jobs.prepare(stages, landed.hosts, landed.root, landed.root, landed.identities, species=species, unique_on=("HOST", "Gene"))


def _trained(data):
    stages, landed = Stages(data.spark, new_shared_folder(data.spark, "job")), _Landed(data)
    models = ModelStore(data.spark, f"{stages.root}/models")
    return stages, models, landed, jobs.train(stages, models, _prepared(data, stages, landed), "ISGvsIRG", "run1", _STUMPS, repeats=1)


_PREPARED_SQL = (
    CODING_SQL, GENE_SQL, CODON_SQL, METADATA_SQL,
    f"coding_f AS (SELECT HOST, Gene, {_CONTENT_SQL} AS q FROM coding_seq)",
    f"gene_f AS (SELECT HOST, Gene, {_CONTENT_SQL} AS d FROM gene_seq)",
    f"codon_f AS (SELECT HOST, Gene, {_BRIDGE_SQL} AS t FROM codon_seq)",
    """prepared AS (SELECT HOST, Gene, q, d, t, ExpressionCategory, Log2FC, FDR FROM coding_f FULL JOIN gene_f USING (HOST, Gene)
        FULL JOIN (SELECT * FROM codon_f WHERE HOST IN (SELECT HOST FROM coding_f)) USING (HOST, Gene) LEFT JOIN metadata USING (HOST, Gene))""",
    """rows_ AS (SELECT row_number() OVER (ORDER BY HOST, Gene) AS rowIndex, HOST AS Host, Gene, ExpressionCategory AS obs, q, d, t
        FROM prepared WHERE Log2FC IS NOT NULL AND ExpressionCategory IN ('Stimulated', 'Repressed'))""",
)


@query("job_prepare", with_sql(*_PREPARED_SQL[:-1], body=f"""SELECT HOST, Gene, q AS "GCcont_Coding", d AS "GCcont_EntireGene", t AS "brCpG_Coding", ExpressionCategory,
    round(Log2FC + {NUDGE}, 6) AS Log2FC, round(FDR + {NUDGE}, 6) AS FDR FROM prepared"""))
def job_prepare(data):
    """Files of all hosts scanned, cleaned, merged, checked and committed."""
    stages = Stages(data.spark, new_shared_folder(data.spark, "job"))
    return rounded_ratios(_prepared(data, stages, _Landed(data))["merged"], "Log2FC", "FDR")


_TRAINED_SQL = (*_PREPARED_SQL, *_REFIT_SQL[1:])
_REFITTED = f"CASE WHEN fi2 IS NULL THEN root WHEN {_left(2)} THEN lo2 ELSE hi2 END"


@query("job_train", with_sql(*_TRAINED_SQL, body=f"""SELECT Host, Gene, round(1 / (1 + exp(-rate * {_REFITTED})), 6) AS predicted_prob,
    round(CASE WHEN r.obs = 'Stimulated' THEN p ELSE 1 - p END, 6) AS p_held_out
    FROM rows_ r JOIN judged USING (rowIndex) JOIN winner USING (c) CROSS JOIN whole LEFT JOIN best2 ON true"""))
def job_train(data):
    """From files to a stored winner: its probability of each row, next to that of the fit which did not see the row."""
    stages, models, _, trained = _trained(data)
    scored = jobs.model_of(models, trained).score(trained["data"]).select("rowIndex", "Host", "Gene", F.col("probability")[0].alias("predicted_prob"))
    held = trained["predictions"].select("rowIndex", F.col("p_observed").alias("p_held_out"))
    return rounded(scored.join(held, "rowIndex").drop("rowIndex"), "predicted_prob", "p_held_out")


_NAMES_SQL = "(VALUES (0, 'q', 'GCcont_Coding'), (1, 'd', 'GCcont_EntireGene'), (2, 't', 'brCpG_Coding')) AS f(i, short, Feature)"
_REPORT_SQL = (
    *_TRAINED_SQL,
    f"leaves AS (SELECT r.*, fi2, rate * {_REFITTED} AS leaf FROM rows_ r CROSS JOIN whole LEFT JOIN best2 ON true)",
    "middle AS (SELECT avg(leaf) AS mean FROM leaves)",
    f"shaps AS (SELECT Host, rowIndex, Feature, CASE WHEN fi2 = i THEN leaf - mean ELSE 0 END AS SHAP FROM leaves, middle, {_NAMES_SQL})",
    "long_ AS (SELECT Feature, v AS x, q AS y FROM (SELECT q, unnest([q, d, t]) AS v, unnest(['GCcont_Coding', 'GCcont_EntireGene', 'brCpG_Coding']) AS Feature FROM rows_) WHERE v IS NOT NULL AND q IS NOT NULL)",
    """ranked AS (SELECT Feature, rank() OVER (PARTITION BY Feature ORDER BY x) + (count(*) OVER (PARTITION BY Feature, x) - 1) / 2.0 AS rx,
        rank() OVER (PARTITION BY Feature ORDER BY y) + (count(*) OVER (PARTITION BY Feature, y) - 1) / 2.0 AS ry FROM long_)""",
)


@query("job_report", with_sql(*_REPORT_SQL, body="""SELECT 'accuracy' AS Part, Host, j.obs AS Item, round(avg(((p >= 0.5) = (j.obs = 'Stimulated'))::INT), 6) AS Value
      FROM judged j JOIN winner USING (c) JOIN rows_ USING (rowIndex) GROUP BY Host, j.obs
    UNION ALL SELECT 'importance', Host, Feature, round(avg(abs(SHAP)), 6) FROM shaps GROUP BY Host, Feature
    UNION ALL SELECT 'correlation', NULL, Feature, round(corr(rx, ry), 6) FROM ranked GROUP BY Feature
    UNION ALL SELECT 'rows explained', NULL, 'CpG', count(*)::DOUBLE FROM shaps WHERE Feature = 'brCpG_Coding'"""))
def job_report(data):
    """Report tables of one fitted run, from files on: accuracy, importance by host, correlations, ranks."""
    stages, models, _, trained = _trained(data)
    found = jobs.report(stages, trained, jobs.explain(stages, models, trained), reference="GCcont_Coding")
    part = lambda name, host, item, value: found[name].select(F.lit(name.split("_")[0].removesuffix("s")).alias("Part"), host.cast("string").alias("Host"), col(item).alias("Item"), value.alias("Value"))
    no_host = F.lit(None)
    parts = part("accuracy", F.col("Host"), "obs", F.col("MeanAccuracy"))
    parts = parts.unionByName(part("importance_by_host", F.col("Host"), "Feature", F.col("HostMeanSHAP")))
    parts = parts.unionByName(part("correlations", no_host, "Feature", F.col("Correlation")))
    ranked = found["class_rank"].agg(F.count("*").cast("double").alias("Value"))
    return rounded(parts.unionByName(ranked.select(F.lit("rows explained").alias("Part"), no_host.cast("string").alias("Host"), F.lit("CpG").alias("Item"), "Value")), "Value")


@query("job_hold_out", with_sql(*_TRAINED_SQL,
    """measured AS (SELECT 'G' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS Gene, n_chars AS x FROM documents ANTI JOIN labels USING (doc_id)),
    ends AS (SELECT Gene, 'Stimulated' AS Label FROM measured QUALIFY rank() OVER (ORDER BY x DESC) <= 50
        UNION ALL SELECT Gene, 'Repressed' FROM measured QUALIFY rank() OVER (ORDER BY x) <= 50),
    held AS (SELECT Gene, q, d, t FROM (SELECT Gene, t FROM codon_f) FULL JOIN (SELECT Gene, q FROM coding_f) USING (Gene) FULL JOIN (SELECT Gene, d FROM gene_f) USING (Gene))""",
    f"told AS (SELECT Gene, CASE WHEN 1 / (1 + exp(-rate * {_REFITTED})) >= 0.5 THEN 'Stimulated' ELSE 'Repressed' END AS PredictedLabel FROM held CROSS JOIN whole LEFT JOIN best2 ON true)",
    body="SELECT Gene, Label AS ActualLabel, PredictedLabel FROM told LEFT JOIN ends USING (Gene)"))
def job_hold_out(data):
    """The stored winner applied to a population of files of its own; its extreme genes have known labels."""
    stages, models, landed, trained = _trained(data)
    measured, *features = landed.hold_out(data)
    return jobs.hold_out(stages, models, trained, measured, "Ensembl ID", "Fold Change", *features)["predictions"]
