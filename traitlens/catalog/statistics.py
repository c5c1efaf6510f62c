"""Cohorts, ranks, distributions and held-out accuracy over the sample tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from traitlens.catalog.registry import query, r6, rounded, with_sql
from traitlens.catalog.tables import labelled_entities, _clean_metadata
from traitlens.functions.names import col
from traitlens.operators import attribution, cohorts, distribution, evaluation, ordering, pairs, resampling
from traitlens.operators.reshape import resample_parts, to_long
from traitlens.plans import report
from traitlens.plans.holdout import holdout_labels
from traitlens.sampledata import CODON_SQL, GENE_SQL, METADATA_SQL, PREDICTIONS_SQL, part_one_sql, part_two_sql

P1, P2 = part_one_sql("s"), part_two_sql("t")

LABELLED_SQL = """
labelled AS (
  SELECT d.lang AS HOST, 'G' || lpad(CAST(d.doc_id AS VARCHAR), 8, '0') AS Gene, m.ExpressionCategory, m.Log2FC, m.FDR
  FROM documents d LEFT JOIN metadata m ON m.HOST = d.lang AND m.Gene = 'G' || lpad(CAST(d.doc_id AS VARCHAR), 8, '0'))"""
FEATURE_SQL = f"""
feature_rows AS (SELECT g.HOST, g.Gene, l.ExpressionCategory, l.Log2FC, {P1['CpG']} AS CpG, {P1['CG%']} AS CGp, {P1['GCcont']} AS GC
  FROM gene_seq g JOIN labelled l USING (HOST, Gene))"""


def box_sql(*ctes: str, source: str, keys: str, value: str, more: str = "") -> str:
    """Box statistics over a CTE, written as quantiles and a second pass for whiskers."""
    pairs = " AND ".join(f"r.{k} IS NOT DISTINCT FROM q.{k}" for k in keys.split(", "))
    picked = ", ".join(f"r.{k}" for k in keys.split(", "))
    quartiles = f"""q AS (SELECT {keys}, quantile_cont({value}, 0.25) AS q1, quantile_cont({value}, 0.5) AS med, quantile_cont({value}, 0.75) AS q3
        FROM {source} WHERE {value} IS NOT NULL GROUP BY {keys})"""
    boxed = f"""boxed AS (SELECT {picked}, r.{value} AS x, q1, med, q3,
          r.{value} >= q1 - 1.5 * (q3 - q1) AND r.{value} <= q3 + 1.5 * (q3 - q1) AS inside
        FROM {source} r JOIN q ON {pairs} WHERE r.{value} IS NOT NULL)"""
    return with_sql(*ctes, quartiles, boxed, body=f"""
      SELECT {keys}{more}, count(*) AS n, round(min(q1), 6) AS q1, round(min(med), 6) AS median, round(min(q3), 6) AS q3,
        round(min(CASE WHEN inside THEN x END), 6) AS whisker_low, round(max(CASE WHEN inside THEN x END), 6) AS whisker_high,
        count(CASE WHEN NOT inside THEN 1 END) AS n_outliers FROM boxed GROUP BY {keys}""")


BOX_COLUMNS = ("q1", "median", "q3", "whisker_low", "whisker_high")


def feature_rows(data, *features):
    """Entities with class and the named whole-text features."""
    wanted = data.part1_gene().select("HOST", "Gene", *[col(f) for f in features])
    return wanted.join(labelled_entities(data).drop("n_chars"), ["HOST", "Gene"])


@query("box_stats", box_sql(GENE_SQL, METADATA_SQL, LABELLED_SQL, FEATURE_SQL, source="feature_rows", keys="HOST, ExpressionCategory", value="CpG"))
def box_stats(data):
    """Box statistics of CpG in the whole text by host and class."""
    return rounded(distribution.box_stats(feature_rows(data, "CpG"), ["HOST", "ExpressionCategory"], "CpG"), *BOX_COLUMNS)


_RAW = ["CpG_EntireGene", "S-Bias_Coding", "TGC-Bias_Coding"]


def _raw_sql(feature: str, source: str, expression: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {panel} AS Panel, ExpressionCategory, '{feature}' AS Feature, {expression} AS v FROM {source} JOIN labelled USING (HOST, Gene) WHERE ExpressionCategory IS NOT NULL"
        for panel in ("'all'", "HOST")
    )


@query(
    "feature_distribution",
    box_sql(
        GENE_SQL, CODON_SQL, METADATA_SQL, LABELLED_SQL,
        f"raw AS ({_raw_sql(_RAW[0], 'gene_seq', P1['CpG'])} UNION ALL {_raw_sql(_RAW[1], 'codon_seq', P2['S-Bias'])} UNION ALL {_raw_sql(_RAW[2], 'codon_seq', P2['TGC-Bias'])})",
        source="raw", keys="Panel, Feature, ExpressionCategory", value="v",
        more=", CASE ExpressionCategory WHEN 'Stimulated' THEN 1 WHEN 'NonDE' THEN 2 ELSE 3 END::BIGINT AS level",
    ),
)
def feature_distribution(data):
    """Three raw features by class, pooled and by host, from one long table."""
    return rounded(report.feature_distribution(_raw_rows(data), _RAW), *BOX_COLUMNS)


def _raw_rows(data):
    gene = data.part1_gene().select("HOST", "Gene", F.col("CpG").alias("CpG_EntireGene"))
    codon = data.part2_coding()
    gene_id = F.regexp_extract("SeqName", ">(.*)\\|", 1).alias("Gene")
    codon = codon.select("HOST", gene_id, col("S-Bias").alias("S-Bias_Coding"), col("TGC-Bias").alias("TGC-Bias_Coding"))
    return labelled_entities(data).drop("n_chars").join(gene, ["HOST", "Gene"], "left").join(codon, ["HOST", "Gene"], "left")


_GRID = 512


@query(
    "feature_density",
    with_sql(
        GENE_SQL, CODON_SQL, METADATA_SQL, LABELLED_SQL,
        f"raw AS ({_raw_sql(_RAW[0], 'gene_seq', P1['CpG'])} UNION ALL {_raw_sql(_RAW[1], 'codon_seq', P2['S-Bias'])} UNION ALL {_raw_sql(_RAW[2], 'codon_seq', P2['TGC-Bias'])})",
        f"""x AS (SELECT Panel, Feature, ExpressionCategory, v AS x FROM raw WHERE v IS NOT NULL),
        s AS (SELECT Panel, Feature, ExpressionCategory, count(*) AS n, min(x) AS lo, (max(x) - min(x)) / {_GRID - 1} AS step,
                0.9::DOUBLE * coalesce(nullif(least(stddev_samp(x), (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) / 1.34::DOUBLE), 0), nullif(stddev_samp(x), 0), 1.0) * power(count(*), -0.2::DOUBLE) AS bw
              FROM x GROUP BY ALL),
        p AS (SELECT x.Panel, x.Feature, x.ExpressionCategory, coalesce((x - lo) / nullif(step, 0), 0) AS place FROM x JOIN s USING (Panel, Feature, ExpressionCategory)),
        l AS (SELECT Panel, Feature, ExpressionCategory, place, least(floor(place), {_GRID - 1}) AS i FROM p),
        b AS (SELECT Panel, Feature, ExpressionCategory, i, sum(w) AS w FROM (
                SELECT Panel, Feature, ExpressionCategory, i, 1 - (place - i) AS w FROM l UNION ALL
                SELECT Panel, Feature, ExpressionCategory, least(i + 1, {_GRID - 1}), place - i FROM l) GROUP BY ALL)""",
        body=f"""SELECT Panel, Feature, ExpressionCategory, CAST(g AS BIGINT) AS GridIndex, round(min(lo) + g * min(step), 5) AS x,
                  round(sum(w * exp(-0.5::DOUBLE * pow((g - i) * step / bw, 2))) / (min(n) * min(bw) * sqrt(2 * pi())), 5) AS Density
                FROM b JOIN s USING (Panel, Feature, ExpressionCategory), range(0, {_GRID}) AS r(g) GROUP BY Panel, Feature, ExpressionCategory, g""",
    ),
)
def feature_density(data):
    """The same features' densities on the whole grid."""
    out = report.feature_density(_raw_rows(data), _RAW, grid=_GRID)
    return out.withColumns({c: F.round(c, 5) for c in ("x", "Density")})


@query(
    "density_by_class",
    with_sql(
        """v AS (SELECT event_type, value AS x FROM events WHERE value IS NOT NULL),
        s AS (SELECT event_type, count(*) AS n, min(x) AS lo, (max(x) - min(x)) / %d AS step,
                0.9::DOUBLE * least(stddev_samp(x), (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) / 1.34::DOUBLE) * power(count(*), -0.2::DOUBLE) AS bw
              FROM v GROUP BY event_type),
        p AS (SELECT v.event_type, (x - lo) / step AS place FROM v JOIN s USING (event_type)),
        l AS (SELECT event_type, place, least(floor(place), %d) AS i FROM p),
        b AS (SELECT event_type, i, sum(w) AS w FROM (
                SELECT event_type, i, 1 - (place - i) AS w FROM l UNION ALL SELECT event_type, least(i + 1, %d), place - i FROM l) GROUP BY ALL)"""
        % (_GRID - 1, _GRID - 1, _GRID - 1),
        body="""SELECT event_type, CAST(g AS BIGINT) AS GridIndex, round(min(lo) + g * min(step), 6) AS x,
                  round(sum(w * exp(-0.5::DOUBLE * pow((g - i) * step / bw, 2))) / (min(n) * min(bw) * sqrt(2 * pi())), 6) AS Density
                FROM b JOIN s USING (event_type), range(0, %d) AS r(g) GROUP BY event_type, g""" % _GRID,
    ),
)
def density_by_class(data):
    out = distribution.density(data.table("events"), ["event_type"], "value", grid=_GRID)
    return rounded(out, "x", "Density")


_DIST_SQL = """
  long_rows AS (SELECT HOST, 'CpG' AS Feature, ExpressionCategory AS c, Gene, CpG AS x FROM feature_rows WHERE CpG IS NOT NULL AND ExpressionCategory IS NOT NULL
    UNION ALL SELECT HOST, 'CG%', ExpressionCategory, Gene, CGp FROM feature_rows WHERE CGp IS NOT NULL AND ExpressionCategory IS NOT NULL)"""


def _distance_sql(condition: str, factor: str) -> str:
    return with_sql(
        GENE_SQL, METADATA_SQL, LABELLED_SQL, FEATURE_SQL, _DIST_SQL,
        body=f"""SELECT a.HOST, a.Feature, count(*) AS n_pairs, round({factor} * avg(abs(a.x - b.x)), 6) AS MeanDist,
          round({factor} * sqrt(avg(pow(a.x - b.x, 2))), 6) AS RmsDist, round({factor} * max(abs(a.x - b.x)), 6) AS MaxDist
          FROM long_rows a JOIN long_rows b ON a.HOST = b.HOST AND a.Feature = b.Feature AND a.Gene < b.Gene AND {condition} GROUP BY ALL""",
    )


def _distance_rows(data):
    return to_long(feature_rows(data, "CpG", "CG%"), ["HOST", "Gene", "ExpressionCategory"], ["CpG", "CG%"])


@query("pairwise_distance", _distance_sql("a.c = b.c", "sqrt(2)"))
def pairwise_distance(data):
    out = distribution.pair_distances(_distance_rows(data), ["HOST", "Feature"], "ExpressionCategory", "Value", "within")
    return rounded(out, "MeanDist", "RmsDist", "MaxDist")


@query("pairwise_distance_between", _distance_sql("a.c <> b.c", "1"))
def pairwise_distance_between(data):
    out = distribution.pair_distances(_distance_rows(data), ["HOST", "Feature"], "ExpressionCategory", "Value", "between")
    return rounded(out, "MeanDist", "RmsDist", "MaxDist")


@query("pairwise_distance_boxes", with_sql(
    GENE_SQL, METADATA_SQL, LABELLED_SQL, FEATURE_SQL, _DIST_SQL,
    "d AS (SELECT a.HOST, a.Feature, sqrt(2) * abs(a.x - b.x) AS v FROM long_rows a JOIN long_rows b ON a.HOST = b.HOST AND a.Feature = b.Feature AND a.Gene < b.Gene AND a.c = b.c)",
    body="""SELECT HOST, Feature, count(*) AS n_pairs, round(quantile_cont(v, 0.25), 6) AS q1, round(quantile_cont(v, 0.5), 6) AS median,
      round(quantile_cont(v, 0.75), 6) AS q3 FROM d GROUP BY ALL"""))
def pairwise_distance_boxes(data):
    """Quartiles of all within-class distances, counted without building the pairs."""
    out = pairs.pair_distance_boxes(_distance_rows(data), ["HOST", "Feature"], "ExpressionCategory", "Value", cuts=63)
    return out.select("HOST", "Feature", "n_pairs", *[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("q1", "median", "q3"))])


# ---- cohorts ----------------------------------------------------------------------------------


@query("cohort_profile", "SELECT count(*) AS n_rows, count(DISTINCT lang) AS n_hosts, string_agg(DISTINCT lang, ', ' ORDER BY lang) AS hosts FROM documents")
def cohort_profile(data):
    return cohorts.cohort_profile(data.table("documents").select(F.col("lang").alias("HOST")))


@query("cohort_all", with_sql(METADATA_SQL, LABELLED_SQL, body="SELECT HOST, Gene, ExpressionCategory, round(Log2FC, 6) AS Log2FC FROM labelled WHERE Log2FC IS NOT NULL AND ExpressionCategory IS NOT NULL"))
def cohort_all(data):
    rows = cohorts.observed_rows(labelled_entities(data)).select("HOST", "Gene", "ExpressionCategory", "Log2FC")
    return rounded(rows, "Log2FC")


@query(
    "cohort_top",
    with_sql(METADATA_SQL, LABELLED_SQL, body="""SELECT l.HOST, l.Gene, round(l.Log2FC, 6) AS Log2FC,
        CASE WHEN s.toxic = 1 THEN 'Stimulated' WHEN s.quality = 1 THEN 'NonDE' ELSE 'Repressed' END AS ExpressionCategory
        FROM labelled l JOIN labels s ON l.Gene = 'G' || lpad(CAST(s.doc_id AS VARCHAR), 8, '0')"""),
)
def cohort_top(data):
    listed = F.when(F.col("toxic") == 1, "ISG").when(F.col("quality") == 1, "Random").otherwise("IRG")
    lists = data.table("labels").join(data.table("documents").select("doc_id", F.col("lang").alias("HOST")), "doc_id").select("HOST", data._gene("doc_id"), listed.alias("Class"))
    rows = cohorts.selected_rows(labelled_entities(data), lists)
    return rounded(rows.select("HOST", "Gene", "Log2FC", "ExpressionCategory"), "Log2FC")


@query(
    "task_labels",
    with_sql(
        METADATA_SQL,
        "tasks(Task, ExpressionCategory, Level) AS (VALUES " + ", ".join(f"('{t}', '{c}', {i}::BIGINT)" for t, levels in cohorts.TASKS.items() for i, c in enumerate(levels, 1)) + ")",
        body="SELECT Task, Level, HOST, Gene, ExpressionCategory FROM metadata JOIN tasks USING (ExpressionCategory)",
    ),
)
def task_labels(data):
    return cohorts.task_rows(_clean_metadata(data).select("HOST", "Gene", "ExpressionCategory"))


@query("top_n_ties", """WITH m AS (SELECT l_partkey, max(l_discount) AS MaxChange FROM lineitem GROUP BY l_partkey)
    SELECT l_partkey, MaxChange FROM m QUALIFY rank() OVER (ORDER BY MaxChange DESC) <= 50""")
def top_n_ties(data):
    return ordering.top_with_ties(cohorts.best_per_key(data.table("lineitem"), "l_partkey", "l_discount"), "MaxChange", 50)


@query("bottom_n_ties", """WITH m AS (SELECT l_partkey, max(l_extendedprice) AS MinChange FROM lineitem GROUP BY l_partkey)
    SELECT l_partkey, MinChange FROM m QUALIFY rank() OVER (ORDER BY MinChange) <= 50""")
def bottom_n_ties(data):
    return ordering.top_with_ties(cohorts.best_per_key(data.table("lineitem"), "l_partkey", "l_extendedprice", name="MinChange"), "MinChange", 50, bottom=True)


@query("holdout_cohort", """WITH m AS (SELECT l_partkey, max(l_extendedprice) AS x FROM lineitem GROUP BY l_partkey)
    SELECT l_partkey, 'Stimulated' AS Label FROM (SELECT l_partkey FROM m QUALIFY rank() OVER (ORDER BY x DESC) <= 50)
    UNION ALL SELECT l_partkey, 'Repressed' FROM (SELECT l_partkey FROM m QUALIFY rank() OVER (ORDER BY x) <= 50)""")
def holdout_cohort(data):
    return holdout_labels(data.table("lineitem"), "l_partkey", "l_extendedprice")


@query("seeded_sample", "SELECT doc_id, lang FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR) || '-2342147'), doc_id LIMIT 50")
def seeded_sample(data):
    return cohorts.seeded_sample(data.table("documents").select("doc_id", "lang"), "doc_id", 50, 2342147)


@query("rank_min_ties", "SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity, l_extendedprice, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity DESC) AS Rank FROM lineitem")
def rank_min_ties(data):
    rows = data.table("lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_extendedprice")
    return ordering.rank_within(rows, ["l_returnflag"], F.col("l_quantity"), descending=True)


@query("group_broadcast", """SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity, round(l_quantity / max(l_quantity) OVER (PARTITION BY l_returnflag), 6) AS Relative,
    round(avg(l_quantity) OVER (PARTITION BY l_returnflag), 6) AS MeanQuantity FROM lineitem""")
def group_broadcast(data):
    rows = data.table("lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    out = attribution.broadcast_statistic(rows, ["l_returnflag"], {"__max": F.max("l_quantity"), "MeanQuantity": F.avg("l_quantity")})
    return out.select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", F.round(F.col("l_quantity") / F.col("__max"), 6).alias("Relative"), r6("MeanQuantity"))


@query("top_flag_by_class", with_sql(METADATA_SQL, LABELLED_SQL, """
    ranked AS (SELECT HOST, Gene, ExpressionCategory, rank() OVER (PARTITION BY ExpressionCategory ORDER BY Log2FC NULLS LAST) AS GeneRank FROM labelled)""",
    body="""SELECT HOST, Gene, ExpressionCategory, GeneRank, CASE ExpressionCategory
      WHEN 'Stimulated' THEN GeneRank >= max(GeneRank) OVER (PARTITION BY ExpressionCategory) - 50
      WHEN 'Repressed' THEN GeneRank <= 50 WHEN 'NonDE' THEN false END AS Top50 FROM ranked"""))
def top_flag_by_class(data):
    return attribution.top_flag(labelled_entities(data).select("HOST", "Gene", "ExpressionCategory", "Log2FC"), top=50).drop("Log2FC")


# ---- held-out accuracy ------------------------------------------------------------------------

JOINED_SQL = "joined AS (SELECT p.*, d.Host, d.Gene, d.ExpressionCategory, d.Log2FC, CASE WHEN pred = p.obs THEN 1.0 ELSE 0.0 END::DOUBLE AS hit FROM predictions p LEFT JOIN prediction_data d USING (rowIndex))"


def _joined(data):
    preds = resample_parts(data.predictions())
    return evaluation.enrich(preds, data.prediction_data(), ["rowIndex"])


@query("accuracy_by_grain", with_sql(PREDICTIONS_SQL, JOINED_SQL, body="""
    SELECT concat_ws(',', CASE WHEN grouping(obs) = 0 THEN 'obs' END, CASE WHEN grouping(Replicate) = 0 THEN 'Replicate' END, CASE WHEN grouping(Host) = 0 THEN 'Host' END) AS Grain,
      obs, Replicate, Host, count(*) AS n, round(avg(hit), 6) AS Accuracy
    FROM joined GROUP BY GROUPING SETS ((obs), (obs, Replicate), (obs, Host), (Host))"""))
def accuracy_by_grain(data):
    out = evaluation.accuracy_at_grains(_joined(data), [["obs"], ["obs", "Replicate"], ["obs", "Host"], ["Host"]])
    return rounded(out.select("Grain", "obs", "Replicate", "Host", "n", "Accuracy"), "Accuracy")


def _interval_sql(by: str) -> str:
    return with_sql(PREDICTIONS_SQL, JOINED_SQL, f"per_rep AS (SELECT obs, Replicate{by}, avg(hit) AS a FROM joined GROUP BY obs, Replicate{by})",
        body=f"""SELECT obs{by}, round(avg(a), 6) AS MeanAccuracy, round(quantile_cont(a, 0.025), 6) AS LwrAccuracy,
          round(quantile_cont(a, 0.975), 6) AS UprAccuracy FROM per_rep GROUP BY obs{by}""")


@query("accuracy_interval", _interval_sql(""))
def accuracy_interval(data):
    out = evaluation.accuracy_interval(resample_parts(data.predictions()))
    return rounded(out, "MeanAccuracy", "LwrAccuracy", "UprAccuracy")


@query("accuracy_interval_by_host", _interval_sql(", Host"))
def accuracy_interval_by_host(data):
    return rounded(evaluation.accuracy_interval(_joined(data), ["Host"]), "MeanAccuracy", "LwrAccuracy", "UprAccuracy")


@query("accuracy_mean_resample", with_sql(PREDICTIONS_SQL, JOINED_SQL, "r AS (SELECT Fold, Replicate, obs, avg(hit) AS a FROM joined GROUP BY ALL)", body="SELECT obs, round(avg(a), 6) AS MeanAccuracy FROM r GROUP BY obs"))
def accuracy_mean_resample(data):
    return rounded(evaluation.accuracy_mean_resample(data.predictions()), "MeanAccuracy")


@query("outlier_flags", with_sql(PREDICTIONS_SQL, JOINED_SQL,
    "rows_ AS (SELECT rowIndex, Host, obs, avg(hit) AS a FROM joined GROUP BY ALL)",
    "q AS (SELECT quantile_cont(a, 0.25) AS q1, quantile_cont(a, 0.75) AS q3 FROM rows_)",
    "f AS (SELECT rowIndex, Host, obs, a, a > q3 + 1.5 * (q3 - q1) AS OutlierHigh, a < q1 - 1.5 * (q3 - q1) AS OutlierLow FROM rows_, q)",
    body="SELECT rowIndex, Host, obs, round(a, 6) AS Accuracy, OutlierHigh, OutlierLow, CASE WHEN OutlierHigh OR OutlierLow THEN 'A' END AS OutlierShape FROM f"))
def outlier_flags(data):
    per_row = evaluation.accuracy(_joined(data), ["rowIndex", "Host", "obs"])
    return rounded(evaluation.flag_outliers(per_row), "Accuracy")


@query("log_loss", with_sql(PREDICTIONS_SQL, """scored AS (SELECT Fold, Replicate, CASE WHEN pred = obs THEN 0.6 + (rowIndex % 40) / 100.0 ELSE (rowIndex % 41) / 100.0 END::DOUBLE AS p FROM predictions)""",
    body="SELECT Fold, Replicate, count(*) AS n, round(avg(-ln(least(greatest(p, 1e-15), 1 - 1e-15))), 6) AS \"logLoss\" FROM scored GROUP BY ALL"))
def log_loss(data):
    row = F.col("rowIndex")
    p = F.when(F.col("pred") == F.col("obs"), 0.6 + (row % 40) / 100.0).otherwise((row % 41) / 100.0)
    return rounded(evaluation.log_loss(resample_parts(data.predictions()).withColumn("p", p), ["Fold", "Replicate"], "p"), "logLoss")


@query("oof_export", with_sql(PREDICTIONS_SQL, body="""SELECT Gene, Host AS Species, p.obs AS Observed, Fold, Replicate, pred AS Prediction
    FROM predictions p LEFT JOIN prediction_data d USING (rowIndex)"""))
def oof_export(data):
    return evaluation.sorted_export(evaluation.prediction_export(data.predictions(), data.prediction_data()))


@query("gene_accuracy", with_sql(PREDICTIONS_SQL, JOINED_SQL, body="""SELECT d.rowIndex, d.Host, d.Gene, d.ExpressionCategory, round(d.Log2FC, 6) AS Log2FC, round(a, 6) AS Accuracy
    FROM prediction_data d LEFT JOIN (SELECT rowIndex, avg(hit) AS a FROM joined GROUP BY rowIndex) USING (rowIndex)"""))
def gene_accuracy(data):
    return rounded(evaluation.gene_accuracy(data.predictions(), data.prediction_data()), "Log2FC", "Accuracy")


@query("sliding_accuracy", with_sql(PREDICTIONS_SQL, JOINED_SQL,
    "g AS (SELECT d.*, a FROM prediction_data d LEFT JOIN (SELECT rowIndex, avg(hit) AS a FROM joined GROUP BY rowIndex) USING (rowIndex))",
    "r AS (SELECT *, rank() OVER (PARTITION BY Host, ExpressionCategory ORDER BY round(abs(Log2FC), 9)) AS Rank FROM g)",
    """s AS (SELECT *, avg(a) OVER (PARTITION BY Host, ExpressionCategory ORDER BY Rank, rowIndex ROWS BETWEEN 4 PRECEDING AND 5 FOLLOWING) AS m,
         max(Rank) OVER (PARTITION BY Host, ExpressionCategory) AS top FROM r)""",
    body="SELECT rowIndex, Host, ExpressionCategory, Rank, round(m, 6) AS SlidingAccuracy FROM s WHERE Rank <= top - 10"))
def sliding_accuracy(data):
    genes = evaluation.gene_accuracy(data.predictions(), data.prediction_data()).withColumn("Log2FC", F.round("Log2FC", 9))
    out = evaluation.accuracy_by_effect(genes, width=10)
    return rounded(out.select("rowIndex", "Host", "ExpressionCategory", "Rank", "SlidingAccuracy"), "SlidingAccuracy")


# ---- resampling -------------------------------------------------------------------------------

_FOLD_ROWS_SQL = """label_rows AS (SELECT doc_id AS rowIndex, CASE WHEN quality = 0 THEN 'Repressed' WHEN toxic = 1 THEN 'Stimulated' ELSE 'NonDE' END AS obs FROM labels),
  folded AS (SELECT rowIndex, obs, rep::INT AS Rep, CAST((row_number() OVER (PARTITION BY rep, obs
      ORDER BY md5(concat_ws('-', rowIndex, rep, '1'))) - 1) % 5 + 1 AS INT) AS Fold FROM label_rows, range(1, 51) AS r(rep))"""


def _fold_rows(data):
    label = F.when(F.col("quality") == 0, "Repressed").when(F.col("toxic") == 1, "Stimulated").otherwise("NonDE")
    return data.table("labels").select(F.col("doc_id").alias("rowIndex"), label.alias("obs"))


@query("repeated_kfold", with_sql(_FOLD_ROWS_SQL, body="SELECT * FROM folded"))
def repeated_kfold(data):
    return resampling.repeated_folds(_fold_rows(data), repeats=50)


@query("downsample_train", with_sql(_FOLD_ROWS_SQL,
    "training AS (SELECT rowIndex, obs, Rep, f::INT AS Fold FROM folded, range(1, 6) AS g(f) WHERE f <> Fold)",
    "sizes AS (SELECT Rep, Fold, min(n) AS keep FROM (SELECT Rep, Fold, obs, count(*) AS n FROM training GROUP BY ALL) GROUP BY ALL)",
    "placed AS (SELECT *, row_number() OVER (PARTITION BY Rep, Fold, obs ORDER BY md5(concat_ws('-', rowIndex, Rep, Fold, 'down1'))) AS p FROM training)",
    body="SELECT rowIndex, obs, Rep, Fold FROM placed JOIN sizes USING (Rep, Fold) WHERE p <= keep"))
def downsample_train(data):
    folds = resampling.repeated_folds(_fold_rows(data), repeats=50)
    return resampling.downsample(resampling.training_rows(folds))
