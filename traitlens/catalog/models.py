"""Training, scoring and explaining on the sample tables, and the cohort plans."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from traitlens.catalog.registry import NUDGE, query, rounded, rounded_ratios, with_sql
from traitlens.catalog.tables import P1, P2, _round_sql
from traitlens.functions.names import col
from traitlens.operators import attribution, boosting, merging, shap
from traitlens.operators.boosting import BoostParams
from traitlens.operators.ordering import stable_row_id
from traitlens.plans import holdout, perturbation, prepare, training
from traitlens.sampledata import CODING_SQL, CODON_SQL, CONTRIBUTIONS_SQL, GENE_SQL, METADATA_SQL
from traitlens.sources.store import shared_root

# Small settings: the catalogue shows that each step works over whole tables,
# not how far a model can be tuned.
QUICK = BoostParams(rounds=3, max_depth=3, rate_drop=0.5, skip_drop=0.3, max_bins=32)
TWO = ("Stimulated", "Repressed")
THREE = ("NonDE", "Stimulated", "Repressed")


# ---- models -----------------------------------------------------------------------------------

_NULLABLE = [i for i in range(64) if i % 8 == 0]


def _gap_sql(i: int) -> str:
    value = f"embedding[{i + 1}]::DOUBLE"
    return f"CASE WHEN (vec_id + {i}) % 17 <> 0 THEN {value} END" if i in _NULLABLE else value


@query("missing_route_encode", "WITH g AS (SELECT vec_id AS rowIndex, "
    + ", ".join(f"{_gap_sql(i)} AS f{i:02d}" for i in range(64))
    + " FROM embeddings) SELECT rowIndex, "
    + ", ".join(
        f'round(f{i:02d}, 6) AS "f{i:02d}__low", f{i:02d} IS NULL AS "f{i:02d}__below", round(f{i:02d}, 6) AS "f{i:02d}__high", f{i:02d} IS NULL AS "f{i:02d}__above"'
        if i in _NULLABLE else f'round(f{i:02d}, 6) AS "f{i:02d}__all"'
        for i in range(64))
    + " FROM g")
def missing_route_encode(data):
    """All components: both copies of each nullable feature, the far stand-ins shown as flags; one copy of the others."""
    df, features = data.trainable()
    df = df.select("rowIndex", *features)
    encoded, names, _ = boosting.route_missing(df, features, boosting.nullable_features(df, features))
    shown = []
    for name in names:
        if name.endswith("__all"):
            shown.append(F.round(col(name), 6).alias(name))
            continue
        far = F.abs(col(name)) > 1e307
        low = name.endswith("__low")
        away = far & (col(name) < 0 if low else col(name) > 0)
        shown += [F.round(F.when(~far, col(name)), 6).alias(name), away.alias(name.replace("__low", "__below").replace("__high", "__above"))]
    return encoded.select("rowIndex", *shown)


def _fit(data, classes=2, params=QUICK):
    df, features = data.trainable(classes)
    return df, boosting.fit_dart(df, features, "obs", TWO if classes == 2 else THREE, params)


@query("train_score_dart")
def train_score_dart(data):
    df, model = _fit(data, 3)
    return rounded(model.score(df).select("rowIndex", "obs", "PredictedLabel", F.col("probability")[0].alias("p_first")), "p_first")


@query("train_score_gbt")
def train_score_gbt(data):
    df, features = data.trainable()
    score = boosting.fit_gbt(df, features, "obs", TWO, QUICK)
    return rounded(score(df).select("rowIndex", "obs", "PredictedLabel", F.col("probability")[0].alias("p_first")), "p_first")


def _search(data):
    df, features = data.trainable()
    candidates = boosting.random_candidates(2, seed=7, base=BoostParams(max_bins=32), max_rounds=2)
    return training.search(df, features, TWO, candidates, folds=2, repeats=1)


_FOLDS_SQL = """vec AS (SELECT vec_id AS rowIndex, CASE WHEN label < 5 THEN 'Stimulated' ELSE 'Repressed' END AS obs FROM embeddings),
  folded AS (SELECT rowIndex, obs, 1 AS Rep, CAST((row_number() OVER (PARTITION BY obs ORDER BY md5(concat_ws('-', rowIndex, 1, '1'))) - 1) % 2 + 1 AS INT) AS Fold FROM vec)"""


@query("random_search", with_sql(_FOLDS_SQL, body="""SELECT c::INT AS Candidate, Rep, Fold, count(*) AS n, true AS Finite
    FROM folded, range(1, 3) AS r(c) GROUP BY ALL"""))
def random_search(data):
    """One loss per candidate and resample, each over the whole fold held out."""
    metrics = _search(data).metrics
    finite = F.col("logLoss").isNotNull() & ~F.isnan("logLoss") & (F.col("logLoss") > 0) & (F.col("logLoss") < 34.6)
    return metrics.select("Candidate", "Rep", "Fold", "n", finite.alias("Finite"))


@query("oof_predictions", with_sql(_FOLDS_SQL, body="SELECT rowIndex, obs, 'Fold' || CAST(Fold AS VARCHAR) || '.Rep01' AS Resample, true AS Consistent FROM folded"))
def oof_predictions(data):
    """Every row held out in its own fold; the label agrees with the probability."""
    out = training.held_out_predictions(_search(data))
    p = F.col("p_observed")
    agrees = F.when(p == 0.5, True).otherwise((p > 0.5) == (F.col("pred") == F.col("obs")))
    return out.select("rowIndex", "obs", "Resample", (agrees & (p > 0) & (p < 1)).alias("Consistent"))


@query("fit_best", "SELECT vec_id AS rowIndex, true AS Same FROM embeddings")
def fit_best(data):
    """Refit, store, load again: the loaded model gives every row the same margin."""
    df, features = data.trainable()
    path = f"{shared_root(data.spark).rstrip('/')}/fit-{uuid.uuid4().hex}"
    model = training.refit(df, features, TWO, QUICK, path)
    loaded = boosting.Ensemble.load(data.spark, f"{path}/model")
    both = loaded.score(model.score(df, "first"), "second", "p2", "l2")
    return both.select("rowIndex", (F.col("first")[0] == F.col("second")[0]).alias("Same"))


@query("shap_contributions")
def shap_contributions(data):
    df, model = _fit(data, 3)
    return rounded(shap.shap_contributions(df, model), "SHAP")


@query("shap_additivity", "SELECT vec_id AS RowID, 'Stimulated' AS Label, true AS Additive FROM embeddings")
def shap_additivity(data):
    """Contributions and bias add up to the margin of every row; the twin states just that."""
    df, model = _fit(data)
    return shap.additivity(df, model).select("RowID", "Label", (F.col("Gap") < 1e-9).alias("Additive"))


_STUMP_FEATURES = ("l_quantity", "l_discount", "l_tax")


def _stump_sql(number: int, source: str) -> str:
    """The best weighted split of a table with columns g (gradient step) and h (weight)."""
    long = " UNION ALL ".join(f"SELECT '{f}' AS f, {f} AS x, g, h FROM {source}" for f in _STUMP_FEATURES)
    return f"""v{number} AS ({long}), c{number} AS (SELECT f, x, sum(h) AS h, sum(g) AS s FROM v{number} GROUP BY ALL),
    p{number} AS (SELECT f, x, sum(h) OVER w AS hl, sum(s) OVER w AS sl, sum(h) OVER (PARTITION BY f) AS ha, sum(s) OVER (PARTITION BY f) AS sa,
        (x + lead(x) OVER (PARTITION BY f ORDER BY x)) / 2 AS cut FROM c{number} WINDOW w AS (PARTITION BY f ORDER BY x)),
    best{number} AS (SELECT f AS f{number}, cut AS cut{number}, sl / (hl + 1) AS lo{number}, (sa - sl) / (ha - hl + 1) AS hi{number}, hl / ha AS share{number}
        FROM p{number} WHERE cut IS NOT NULL ORDER BY sl * sl / hl + (sa - sl) * (sa - sl) / (ha - hl) DESC LIMIT 1)"""


def _value_sql(number: int) -> str:
    picked = f"CASE f{number} WHEN 'l_quantity' THEN l_quantity WHEN 'l_discount' THEN l_discount ELSE l_tax END"
    return f"CASE WHEN ({picked}) <= cut{number} THEN lo{number} ELSE hi{number} END"


_STUMPS_SQL = (
    "t1 AS (SELECT l_quantity, l_discount, l_tax, y, y - 0.5::DOUBLE AS g, 0.25::DOUBLE AS h FROM (SELECT *, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y FROM lineitem))",
    _stump_sql(1, "t1"),
    f"t2 AS (SELECT l_quantity, l_discount, l_tax, y - p AS g, p * (1 - p) AS h FROM (SELECT *, 1 / (1 + exp(-0.3::DOUBLE * ({_value_sql(1)}))) AS p FROM t1, best1))",
    _stump_sql(2, "t2"),
)


def _line_items(data):
    label = F.when(F.col("l_returnflag") == "R", "Stimulated").otherwise("Repressed")
    return data.table("lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("rowIndex"), label.alias("obs"), *_STUMP_FEATURES)


_STUMP = BoostParams(rounds=1, max_depth=1, min_child_weight=0.0, rate_drop=0.0)


@query("train_dart_stumps", with_sql(*_STUMPS_SQL, body=f"""SELECT l_quantity, l_discount, l_tax, count(*) AS n,
    round(0.3::DOUBLE * ({_value_sql(1)}), 6) AS one_round,
    round(0.3::DOUBLE * ({_value_sql(1)}) + 0.3::DOUBLE * ({_value_sql(2)}), 6) AS two_rounds,
    round((0.3::DOUBLE / 1.3::DOUBLE + 0.3::DOUBLE / 1.3::DOUBLE) * ({_value_sql(1)}), 6) AS one_dropped
    FROM lineitem, best1, best2 GROUP BY ALL"""))
def train_dart_stumps(data):
    """Newton stumps over all line items against plain SQL: one round, two rounds,
    and a second round for which the first tree was dropped."""
    encoded = boosting.encode(_line_items(data), list(_STUMP_FEATURES), "obs", TWO)
    settings = {"one_round": _STUMP, "two_rounds": replace(_STUMP, rounds=2), "one_dropped": replace(_STUMP, rounds=2, rate_drop=1.0, skip_drop=0.0)}
    out = data.table("lineitem").groupBy(*_STUMP_FEATURES).agg(F.count("*").alias("n"))
    for name, params in settings.items():
        out = out.withColumn(name, F.round(boosting.fit_encoded(encoded, params).margin(), 6))
    return out


@query("score_probability", with_sql(*_STUMPS_SQL, body=f"""SELECT l_orderkey * 8 + l_linenumber AS rowIndex, round(p, 6) AS predicted_prob,
    CASE WHEN p >= 0.5 THEN 'Stimulated' ELSE 'Repressed' END AS PredictedLabel
    FROM (SELECT *, 1 / (1 + exp(-0.3::DOUBLE * ({_value_sql(1)}) - 0.3::DOUBLE * ({_value_sql(2)}))) AS p FROM lineitem, best1, best2)"""))
def score_probability(data):
    """Probability and label of every line item by two rounds of stumps."""
    rows = _line_items(data)
    model = boosting.fit_dart(rows, list(_STUMP_FEATURES), "obs", TWO, replace(_STUMP, rounds=2))
    scored = model.score(rows).select("rowIndex", F.col("probability")[0].alias("predicted_prob"), "PredictedLabel")
    return rounded(scored, "predicted_prob")


_SEEN_SQL = "seen AS (SELECT * FROM t1_all WHERE l_orderkey % 2 = 1)"
_ALL_SQL = "t1_all AS (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax, y, y - 0.5::DOUBLE AS g, 0.25::DOUBLE AS h FROM (SELECT *, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y FROM lineitem))"


@query("holdout_evaluate", with_sql(_ALL_SQL, _SEEN_SQL, _stump_sql(1, "seen"), f"""judged AS (
    SELECT CASE WHEN ({_value_sql(1)}) >= 0 THEN 'Stimulated' ELSE 'Repressed' END AS PredictedLabel,
      CASE WHEN l_linenumber <= 4 THEN CASE y WHEN 1 THEN 'Stimulated' ELSE 'Repressed' END END AS Label
    FROM t1_all, best1 WHERE l_orderkey % 2 = 0)""",
    body="""SELECT Label, CAST(sum(CASE WHEN Label IS NOT NULL THEN CASE WHEN PredictedLabel = Label THEN 1 ELSE 0 END END) AS BIGINT) AS Accuracy, count(*) AS n,
      round(avg(CASE WHEN Label IS NOT NULL THEN CASE WHEN PredictedLabel = Label THEN 1.0 ELSE 0.0 END END), 6) AS Proportion_accurate FROM judged GROUP BY Label"""))
def holdout_evaluate(data):
    """A model of the odd orders predicts the even ones, which it has not seen; the first four lines have known labels."""
    order, line = F.floor(F.col("rowIndex") / 8), F.col("rowIndex") % 8
    rows = _line_items(data)
    model = boosting.fit_dart(rows.where(order % 2 == 1), list(_STUMP_FEATURES), "obs", TWO, _STUMP)
    # Line numbers repeat within an order, so the rows get ids of their own.
    unseen = stable_row_id(rows.where(order % 2 == 0), ["rowIndex", *_STUMP_FEATURES, "obs"], "id")
    predicted = model.score(unseen).select(F.col("id").cast("string").alias("Gene"), "PredictedLabel")
    known = unseen.where(line <= 4).select(F.col("id").cast("string").alias("id"), F.col("obs").alias("Label"))
    _, accuracy = holdout.holdout_accuracy(predicted, known, "id")
    return rounded(accuracy.withColumn("Accuracy", F.col("Accuracy").cast("long")), "Proportion_accurate")


@query("shap_stump", with_sql(_STUMPS_SQL[0], _STUMPS_SQL[1], f"""cells AS (SELECT row_number() OVER (ORDER BY l_quantity, l_discount, l_tax) AS RowID, l_quantity, l_discount, l_tax
        FROM (SELECT DISTINCT l_quantity, l_discount, l_tax FROM lineitem))""",
    body=" UNION ALL ".join(f"""SELECT RowID, '{f}' AS Feature, CASE WHEN f1 = '{f}' THEN round(0.3::DOUBLE * (({_value_sql(1)}) - (share1 * lo1 + (1 - share1) * hi1)), 6) ELSE 0 END AS SHAP
        FROM cells, best1""" for f in _STUMP_FEATURES)))
def shap_stump(data):
    """Contributions of one stump have a closed form: the leaf minus the mean leaf."""
    model = boosting.fit_dart(_line_items(data), list(_STUMP_FEATURES), "obs", TWO, _STUMP)
    cells = stable_row_id(data.table("lineitem").select(*_STUMP_FEATURES).distinct(), _STUMP_FEATURES)
    return rounded(shap.shap_contributions(cells, model).drop("Label"), "SHAP")


# ---- plans ------------------------------------------------------------------------------------


@query("prepare_input", with_sql(GENE_SQL, CODING_SQL, CODON_SQL, METADATA_SQL, body=f"""
    SELECT HOST, Gene, a.* EXCLUDE (HOST, Gene), b.* EXCLUDE (HOST, Gene), c.* EXCLUDE (HOST, Gene),
      m.ExpressionCategory, round(m.Log2FC + {NUDGE}, 6) AS Log2FC, round(m.FDR + {NUDGE}, 6) AS FDR
    FROM (SELECT HOST, Gene, {_round_sql(P1, P1, '_Coding')} FROM coding_seq) a
    FULL JOIN (SELECT HOST, Gene, {_round_sql(P1, P1, '_EntireGene')} FROM gene_seq) b USING (HOST, Gene)
    FULL JOIN (SELECT HOST, Gene, {_round_sql(P2, P2, '_Coding')} FROM codon_seq) c USING (HOST, Gene)
    LEFT JOIN metadata m USING (HOST, Gene)"""))
def prepare_input(data):
    """Families selected, suffixed and merged with recoded classes, all columns."""
    species = {h.upper(): h for h in ("de", "en", "es", "fr")}
    identities = prepare.clean_identities(data.metadata(), species)
    merged = prepare.merge_features(data.part1_coding(), data.part1_gene(), data.part2_coding(), identities, unique_on=None)
    texts = ("HOST", "Gene", "ExpressionCategory")
    return rounded_ratios(merged, *[c for c in merged.columns if c not in texts])


def _experiment(data):
    """Scores, class effects, gene names and the lists that play the experiments: every part has a role by its size."""
    parts = data.table("part").select(
        "p_size", "p_brand", "p_type", F.concat(F.lit("P"), F.lpad(F.col("p_partkey").cast("string"), 8, "0")).alias("EnsemblID"), F.col("p_name").alias("Gene")
    )
    info = data.contribution_data().select(F.col("rowIndex").alias("RowID"), F.col("Gene").alias("EnsemblID"), "Log2FC", "ExpressionCategory")
    effects = merging.enrich(attribution.collapse(data.contributions(), only="CpG").drop("Label"), info, ["RowID"])
    scores = info.select("EnsemblID", F.round(1 / (1 + F.exp(-F.col("Log2FC"))), 6).alias("predicted_prob"))
    names = parts.select("EnsemblID", "Gene")
    kind = F.element_at(F.array(F.lit("IRG"), F.lit("ISG"), F.lit("Random")), F.col("p_size") % 3 + 1)
    top = parts.where(F.col("p_size") <= 10).select("EnsemblID", kind.alias("ExpressionCategory"), "Gene")
    random = perturbation.random_holdout(parts.where(F.col("p_size").between(11, 20)), names)
    listed = parts.where(F.col("p_size").between(21, 34)).select(
        F.col("Gene").alias("gene"), F.col("EnsemblID").alias("ensemble_id"),
        F.when(F.col("p_size") < 27, "ZAP-IN").otherwise("ZAP-DEP").alias("ko_experiment"),
        F.when(F.col("p_size") < 25, "ZAP-IN").when(F.col("p_size") < 31, "ZAP-DEP").alias("exogenous_zap_experiment"),
    )
    sheet = lambda low, high: parts.where(F.col("p_size").between(low, high)).select(
        F.when(F.col("p_size") == low, F.lit(None)).when(F.col("p_size") == low + 1, F.lit("NA")).otherwise(F.col("EnsemblID")).alias("EnsemblID"),
        F.element_at(F.array(F.lit("a-Top50-ISGs"), F.lit("b-other"), F.lit("c-Top50-IRGs")), F.col("p_size") % 3 + 1).alias("Rank"),
    )
    outside = parts.where(F.col("p_size") > 20).select(
        F.col("Gene").alias("Gene_Name"), "EnsemblID",
        F.element_at(F.array(F.lit("TOP50 UP"), F.lit("Random50"), F.lit("TOP50 DOWN"), F.lit("unlisted")), F.col("p_size") % 4 + 1).alias("Rank"),
    )
    baseline = perturbation.overview(top, random, effects, scores, check=False)
    return dict(effects=effects, scores=scores, names=names, baseline=baseline, random=random, listed=listed, control=sheet(35, 42), knocked=sheet(43, 50), outside=outside)


_EXPERIMENT_SQL = (
    CONTRIBUTIONS_SQL,
    "parts AS (SELECT p_size, 'P' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS EnsemblID, p_name AS Gene FROM part)",
    "effects AS (SELECT d.Gene AS EnsemblID, c.SHAP, round(1 / (1 + exp(-d.Log2FC)), 6) AS predicted_prob FROM contribution_data d LEFT JOIN collapsed c ON c.RowID = d.rowIndex AND c.FeatureClass = 'CpG')",
    "random_ AS (SELECT EnsemblID, Gene FROM parts WHERE p_size BETWEEN 11 AND 20 ORDER BY md5(EnsemblID || '-2342147'), EnsemblID LIMIT 50)",
    """overview AS (SELECT EnsemblID, Gene, CASE p_size % 3 WHEN 0 THEN 'Top 50 IRGs' WHEN 1 THEN 'Top 50 ISGs' ELSE 'Random' END AS Category FROM parts WHERE p_size <= 10
        UNION ALL SELECT EnsemblID, Gene, 'Holdout Random' FROM random_)""",
    """listed AS (SELECT EnsemblID, Gene, CASE WHEN p_size < 27 THEN 'ZAP-IN' ELSE 'ZAP-DEP' END AS ko,
        CASE WHEN p_size < 25 THEN 'ZAP-IN' WHEN p_size < 31 THEN 'ZAP-DEP' END AS exo FROM parts WHERE p_size BETWEEN 21 AND 34)""",
)
_RESULT_SQL = "SELECT {columns}, round(e.SHAP, 6) AS cpg_effect, e.predicted_prob FROM r LEFT JOIN effects e USING (EnsemblID)"
_SHARED = "Gene, EnsemblID, Category"


@query("cohort_consistent", with_sql(*_EXPERIMENT_SQL, "r AS (SELECT Gene, EnsemblID, ko AS Category FROM listed UNION ALL SELECT Gene, EnsemblID, Category FROM overview)", body=_RESULT_SQL.format(columns=_SHARED)))
def cohort_consistent(data):
    x = _experiment(data)
    return rounded(perturbation.consistent(x["listed"], x["baseline"], x["effects"], x["scores"]), "cpg_effect")


@query("cohort_overexpression", with_sql(*_EXPERIMENT_SQL, "r AS (SELECT Gene, EnsemblID, exo AS Category FROM listed WHERE exo IS NOT NULL UNION ALL SELECT Gene, EnsemblID, Category FROM overview)", body=_RESULT_SQL.format(columns=_SHARED)))
def cohort_overexpression(data):
    x = _experiment(data)
    return rounded(perturbation.overexpression(x["listed"], x["baseline"], x["effects"], x["scores"]), "cpg_effect")


_SHEET_SQL = """SELECT CASE WHEN p_size = {low} THEN NULL WHEN p_size = {low} + 1 THEN 'NA' ELSE EnsemblID END AS EnsemblID, '{name}' AS Treatment,
    CASE p_size % 3 WHEN 0 THEN 'ISG' WHEN 2 THEN 'IRG' END AS Category FROM parts WHERE p_size BETWEEN {low} AND {high}"""


@query("cohort_knockout", with_sql(*_EXPERIMENT_SQL,
    f"sheets AS (({_SHEET_SQL.format(low=35, high=42, name='no guide')}) UNION ALL SELECT * FROM ({_SHEET_SQL.format(low=43, high=50, name='KO')}) WHERE EnsemblID IS NOT NULL AND EnsemblID <> 'NA')",
    """r AS (SELECT s.EnsemblID, Treatment, Category, coalesce(Category, 'NA') || ' (' || Treatment || ')' AS Label, p.Gene FROM sheets s LEFT JOIN parts p USING (EnsemblID)
        UNION ALL SELECT EnsemblID, NULL, 'Holdout Random', 'Holdout Random', Gene FROM random_)""",
    body=_RESULT_SQL.format(columns="EnsemblID, Treatment, Category, Label, Gene")))
def cohort_knockout(data):
    x = _experiment(data)
    return rounded(perturbation.knockout(x["control"], x["knocked"], x["random"], x["names"], x["effects"], x["scores"]), "cpg_effect")


@query("cohort_exogenous", with_sql(*_EXPERIMENT_SQL, """r AS (SELECT Gene, EnsemblID, CASE p_size % 4 WHEN 0 THEN 'TOP50 UP' WHEN 1 THEN 'Random50' WHEN 2 THEN 'TOP50 DOWN' END AS Category FROM parts WHERE p_size > 20
    UNION ALL SELECT Gene, EnsemblID, 'Holdout Random' FROM random_)""", body=_RESULT_SQL.format(columns=_SHARED)))
def cohort_exogenous(data):
    x = _experiment(data)
    return rounded(perturbation.exogenous(x["outside"], x["random"], x["effects"], x["scores"]), "cpg_effect")
