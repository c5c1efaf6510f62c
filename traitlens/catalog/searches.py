"""Histogram trees, searches over resamples, and stored winners on the sample tables, each against plain SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from traitlens.catalog.registry import query, rounded, with_sql
from traitlens.operators import boosting, histograms, shap
from traitlens.operators.boosting import BoostParams
from traitlens.operators.ordering import stable_row_id
from traitlens.plans import tuning
from traitlens.sources.models import ModelStore
from traitlens.sources.store import new_shared_folder

TWO = ("Stimulated", "Repressed")
_FEATURES = ("q", "d", "t")


def _picked(n: int) -> str:
    return f"CASE fi{n} WHEN 0 THEN q WHEN 1 THEN d ELSE t END"


def _left(n: int) -> str:
    return f"coalesce(({_picked(n)}) <= cut{n}, ml{n})"


def _best_sql(n: int, source: str, keys: str = "", params: str = "params") -> str:
    """The split with the highest second-order gain per key (and candidate c) of a table with q, d, t, g and h; missing values on both sides."""
    k = f"{keys}, " if keys else ""
    long = " UNION ALL ".join(f"SELECT {k}{i} AS fi, {f} AS x, g, h FROM {source}" for i, f in enumerate(_FEATURES))
    return f"""long{n} AS ({long}), cell{n} AS (SELECT {k}fi, x, sum(g) AS g, sum(h) AS h FROM long{n} GROUP BY ALL),
    cum{n} AS (SELECT {k}fi, x, sum(g) OVER u AS gk, sum(h) OVER u AS hk, sum(g) OVER a AS ga, sum(h) OVER a AS ha,
        coalesce(sum(g) FILTER (x IS NULL) OVER a, 0) AS gm, coalesce(sum(h) FILTER (x IS NULL) OVER a, 0) AS hm
        FROM cell{n} WINDOW u AS (PARTITION BY {k}fi ORDER BY x NULLS LAST), a AS (PARTITION BY {k}fi)),
    side{n} AS (SELECT *, gk + CASE WHEN ml THEN gm ELSE 0 END AS gl, hk + CASE WHEN ml THEN hm ELSE 0 END AS hl FROM cum{n}, (VALUES (true), (false)) v(ml) WHERE x IS NOT NULL),
    gain{n} AS (SELECT *, round((gl * gl / (hl + lam) + (ga - gl) * (ga - gl) / (ha - hl + lam) - ga * ga / (ha + lam)) / 2 - gam, 9) AS gain FROM side{n}, {params}
        WHERE hl >= child AND ha - hl >= child AND least(hl, ha - hl) > 1e-9 * ha),
    first{n} AS (SELECT *, row_number() OVER (PARTITION BY {k}c ORDER BY gain DESC, fi, x, ml DESC) AS place FROM gain{n} WHERE gain > 0),
    best{n} AS (SELECT {k}c, fi AS fi{n}, cut AS cut{n}, ml AS ml{n}, -gl / (hl + lam) AS lo{n}, -(ga - gl) / (ha - hl + lam) AS hi{n} FROM first{n} JOIN cuts USING (fi, x) WHERE place = 1)"""


def _cuts_sql(source: str) -> str:
    values = " UNION ".join(f"SELECT {i} AS fi, {f} AS x FROM {source} WHERE {f} IS NOT NULL" for i, f in enumerate(_FEATURES))
    return f"cuts AS (SELECT fi, x, coalesce((x + lead(x) OVER (PARTITION BY fi ORDER BY x)) / 2, 1e308) AS cut FROM ({values}))"


_ITEMS_SQL = """items AS (SELECT l_quantity::DOUBLE AS q, CASE WHEN {gap_d} THEN l_discount::DOUBLE END AS d, CASE WHEN {gap_t} THEN l_tax::DOUBLE END AS t,
    0.5::DOUBLE - CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS g, 0.25::DOUBLE AS h FROM lineitem)"""
_ONE = "params AS (SELECT 1 AS c, 1.0::DOUBLE AS lam, {gam}::DOUBLE AS gam, 1.0::DOUBLE AS child)"


def _items(data, gaps: bool = False):
    label = F.when(F.col("l_returnflag") == "R", TWO[0]).otherwise(TWO[1])
    seen = (lambda key, n, c: F.when(F.col(key) % n != 0, F.col(c).cast("double"))) if gaps else (lambda key, n, c: F.col(c).cast("double"))
    return data.table("lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("rowIndex"), label.alias("obs"),
        F.col("l_quantity").cast("double").alias("q"), seen("l_partkey", 3, "l_discount").alias("d"), seen("l_suppkey", 4, "l_tax").alias("t"),
    )


_DEEP_SQL = (
    _ITEMS_SQL.format(gap_d="true", gap_t="true"), _ONE.format(gam="0.0"), _cuts_sql("items"), _best_sql(1, "items"),
    f"halves AS (SELECT items.*, {_left(1)} AS k FROM items, best1)", _best_sql(2, "halves", "k"),
)


@query("boost_depth_two", with_sql(*_DEEP_SQL, body=f"""SELECT q, d, t, count(*) AS n,
    round(0.3::DOUBLE * CASE WHEN fi2 IS NULL THEN CASE WHEN k THEN lo1 ELSE hi1 END WHEN {_left(2)} THEN lo2 ELSE hi2 END, 6) AS margin
    FROM halves CROSS JOIN best1 LEFT JOIN best2 USING (k) GROUP BY ALL"""))
def boost_depth_two(data):
    """A tree of two levels over all line items, grown by second-order gain."""
    rows = _items(data)
    model = histograms.fit_histogram(rows, _FEATURES, "obs", TWO, BoostParams(rounds=1, max_depth=2, rate_drop=0.0))
    return rows.groupBy(*_FEATURES).agg(F.count("*").alias("n")).withColumn("margin", F.round(model.margin(), 6))


# Every set of known features (a mask) is valued by walking the tree, and weighed as Shapley's definition says.
_SHARES_SQL = (
    "upper_ AS (SELECT avg(k::INT) AS share1 FROM halves)",
    f"lower_ AS (SELECT k, any_value(fi2) AS fi2, any_value(cut2) AS cut2, any_value(ml2) AS ml2, any_value(lo2) AS lo2, any_value(hi2) AS hi2, avg(({_left(2)})::INT) AS share2 FROM halves JOIN best2 USING (k) GROUP BY k)",
    "cells AS (SELECT row_number() OVER (ORDER BY q, d, t) AS RowID, q, d, t FROM (SELECT DISTINCT q, d, t FROM items))",
    f"""branches AS (SELECT RowID, mask, CASE WHEN (mask >> fi1) & 1 = 1 THEN (({_left(1)}) = k)::INT ELSE CASE WHEN k THEN share1 ELSE 1 - share1 END END AS reach,
        CASE WHEN (mask >> fi2) & 1 = 1 THEN ({_left(2)})::INT ELSE share2 END AS goes_left, fi2, lo2, hi2, CASE WHEN k THEN lo1 ELSE hi1 END AS leaf1
        FROM cells CROSS JOIN best1 CROSS JOIN upper_ CROSS JOIN range(8) AS m(mask) CROSS JOIN (VALUES (true), (false)) AS s(k) LEFT JOIN lower_ USING (k))""",
    "worth AS (SELECT RowID, mask, sum(reach * CASE WHEN fi2 IS NULL THEN leaf1 ELSE goes_left * lo2 + (1 - goes_left) * hi2 END) AS v FROM branches GROUP BY ALL)",
)


@query("shap_depth_two", with_sql(*_DEEP_SQL, *_SHARES_SQL, body="""SELECT RowID, Feature, round(0.3::DOUBLE * sum(v * CASE WHEN (mask >> i) & 1 = 1
        THEN CASE bit_count(mask) WHEN 2 THEN 1 ELSE 2 END ELSE CASE bit_count(mask) WHEN 1 THEN -1 ELSE -2 END END / 6.0::DOUBLE), 6) + 0.0::DOUBLE AS SHAP
    FROM worth, (VALUES (0, 'q'), (1, 'd'), (2, 't')) AS f(i, Feature) GROUP BY RowID, Feature"""))
def shap_depth_two(data):
    """Contributions of a tree of two levels, for every distinct line item, against Shapley's definition over all feature sets."""
    rows = _items(data)
    model = histograms.fit_histogram(rows, _FEATURES, "obs", TWO, BoostParams(rounds=1, max_depth=2, rate_drop=0.0))
    cells = stable_row_id(rows.select(*_FEATURES).distinct(), _FEATURES)
    return shap.shap_contributions(cells, model, "rowIndex").select("RowID", "Feature", (F.round("SHAP", 6) + 0.0).alias("SHAP"))


_GAPS_SQL = (
    _ITEMS_SQL.format(gap_d="l_partkey % 3 <> 0", gap_t="l_suppkey % 4 <> 0"), _ONE.format(gam="0.0"), _cuts_sql("items"), _best_sql(1, "items"),
    f"later AS (SELECT q, d, t, p - y AS g, p * (1 - p) AS h FROM (SELECT q, d, t, 0.5 - g AS y, 1 / (1 + exp(-0.3::DOUBLE * CASE WHEN {_left(1)} THEN lo1 ELSE hi1 END)) AS p FROM items, best1))",
    _best_sql(2, "later"),
)


@query("boost_missing_side", with_sql(*_GAPS_SQL, body=f"""SELECT q, d, t, count(*) AS n,
    round(0.3::DOUBLE * CASE WHEN {_left(1)} THEN lo1 ELSE hi1 END, 6) AS one_round,
    round(0.3::DOUBLE * CASE WHEN {_left(1)} THEN lo1 ELSE hi1 END + 0.3::DOUBLE * CASE WHEN {_left(2)} THEN lo2 ELSE hi2 END, 6) AS two_rounds
    FROM items, best1, best2 GROUP BY ALL"""))
def boost_missing_side(data):
    """Two rounds of stumps over line items with gaps: each split learns the side of missing values from their own bin."""
    rows = _items(data, gaps=True)
    binned = histograms.bin_rows(rows, _FEATURES, "obs", TWO)
    settings = BoostParams(rounds=1, max_depth=1, rate_drop=0.0)
    fits = [histograms.Fit(settings), histograms.Fit(BoostParams(rounds=2, max_depth=1, rate_drop=0.0))]
    histograms.grow_all(binned, fits)
    one, two = (f.ensemble(binned).margin() for f in fits)
    return rows.groupBy(*_FEATURES).agg(F.count("*").alias("n")).withColumns({"one_round": F.round(one, 6), "two_rounds": F.round(two, 6)})


# ---- searches ---------------------------------------------------------------------------------

_STUMPS = [
    BoostParams(rounds=1, max_depth=1, rate_drop=0.0, learning_rate=0.3, reg_lambda=1.0, min_child_weight=1.0),
    BoostParams(rounds=1, max_depth=1, rate_drop=0.0, learning_rate=0.05, reg_lambda=20.0, min_child_weight=100.0),
    BoostParams(rounds=1, max_depth=1, rate_drop=0.0, learning_rate=0.6, reg_lambda=0.0, gamma=0.5, min_child_weight=5.0),
    BoostParams(rounds=1, max_depth=1, rate_drop=0.0, learning_rate=0.6, reg_lambda=1.0, gamma=0.0, min_child_weight=0.0),
]
_SEARCH_SQL = (
    """rows_ AS (SELECT o_orderkey AS rowIndex, CASE WHEN o_orderstatus = 'F' THEN 'Stimulated' ELSE 'Repressed' END AS obs, month(o_orderdate)::DOUBLE AS q,
        CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS d, CASE WHEN o_custkey % 7 <> 0 THEN (o_custkey % 50)::DOUBLE END AS t FROM orders)""",
    "params(c, lr, lam, gam, child) AS (VALUES " + ", ".join(f"({i}, {p.learning_rate}::DOUBLE, {p.reg_lambda}::DOUBLE, {p.gamma}::DOUBLE, {p.min_child_weight}::DOUBLE)" for i, p in enumerate(_STUMPS, 1)) + ")",
    "folded AS (SELECT *, CAST((row_number() OVER (PARTITION BY obs ORDER BY md5(concat_ws('-', rowIndex, 1, '1'))) - 1) % 5 + 1 AS INT) AS own FROM rows_)",
    "training AS (SELECT r.*, f::INT AS Fold FROM folded r, range(1, 6) AS g(f) WHERE f <> own)",
    "sizes AS (SELECT Fold, min(n) AS keep FROM (SELECT Fold, obs, count(*) AS n FROM training GROUP BY ALL) GROUP BY ALL)",
    "placed AS (SELECT *, row_number() OVER (PARTITION BY Fold, obs ORDER BY md5(concat_ws('-', rowIndex, 1, Fold, 'down1'))) AS p FROM training)",
    "used AS (SELECT Fold, q, d, t, 0.5::DOUBLE - CASE WHEN obs = 'Stimulated' THEN 1 ELSE 0 END AS g, 0.25::DOUBLE AS h FROM placed JOIN sizes USING (Fold) WHERE p <= keep)",
    _cuts_sql("rows_"), _best_sql(1, "used", "Fold"),
    "roots AS (SELECT Fold, c, -ga / (ha + lam) AS root FROM (SELECT Fold, sum(g) AS ga, sum(h) AS ha FROM used GROUP BY Fold), params)",
    f"""judged AS (SELECT rowIndex, obs, own AS Fold, c, 1 / (1 + exp(-lr * CASE WHEN fi1 IS NULL THEN root WHEN {_left(1)} THEN lo1 ELSE hi1 END)) AS p
        FROM folded CROSS JOIN params JOIN roots ON roots.Fold = own AND roots.c = params.c LEFT JOIN best1 ON best1.Fold = own AND best1.c = params.c)"""
    .replace("SELECT rowIndex, obs, own AS Fold, c,", "SELECT rowIndex, obs, own AS Fold, params.c AS c,"),
    "losses AS (SELECT c, Fold, count(*) AS n, avg(-ln(CASE WHEN obs = 'Stimulated' THEN p ELSE 1 - p END)) AS loss FROM judged GROUP BY ALL)",
    "winner AS (SELECT c FROM losses GROUP BY c ORDER BY avg(loss), c LIMIT 1)",
)


def _orders(data):
    return data.table("orders").select(
        F.col("o_orderkey").alias("rowIndex"), F.when(F.col("o_orderstatus") == "F", TWO[0]).otherwise(TWO[1]).alias("obs"), F.month("o_orderdate").cast("double").alias("q"),
        F.substring("o_orderpriority", 1, 1).cast("double").alias("d"), F.when(F.col("o_custkey") % 7 != 0, (F.col("o_custkey") % 50).cast("double")).alias("t"),
    )


def _search(data):
    return tuning.search(_orders(data), _FEATURES, TWO, _STUMPS, folds=5, repeats=1)


@query("search_losses", with_sql(*_SEARCH_SQL, body="SELECT c AS Candidate, 1 AS Rep, Fold, n, round(loss, 6) AS logLoss FROM losses"))
def search_losses(data):
    """Four candidates over five balanced folds of all orders, grown together: each resample's held-out loss."""
    return rounded(_search(data).metrics, "logLoss")


@query("search_oof", with_sql(*_SEARCH_SQL, body="""SELECT rowIndex, obs, 'Fold' || CAST(Fold AS VARCHAR) || '.Rep01' AS Resample, round(CASE WHEN obs = 'Stimulated' THEN p ELSE 1 - p END, 6) AS p_observed,
    CASE WHEN p >= 0.5 THEN 'Stimulated' ELSE 'Repressed' END AS pred FROM judged JOIN winner USING (c)"""))
def search_oof(data):
    """Every order scored by the winner's fit that did not see it."""
    return rounded(tuning.held_out_predictions(_search(data)).select("rowIndex", "obs", "Resample", "p_observed", "pred"), "p_observed")


_REFIT_SQL = (
    *_SEARCH_SQL, "all_ AS (SELECT q, d, t, 0.5::DOUBLE - CASE WHEN obs = 'Stimulated' THEN 1 ELSE 0 END AS g, 0.25::DOUBLE AS h FROM rows_)",
    "chosen AS (SELECT params.* FROM params JOIN winner USING (c))", _best_sql(2, "all_", params="chosen"),
    "whole AS (SELECT -sum(g) / (sum(h) + any_value(lam)) AS root, any_value(lr) AS rate FROM all_, chosen)",
)


@query("search_refit", with_sql(*_REFIT_SQL, body=f"""SELECT rowIndex, round(1 / (1 + exp(-rate * CASE WHEN fi2 IS NULL THEN root WHEN {_left(2)} THEN lo2 ELSE hi2 END)), 6) AS predicted_prob
    FROM rows_ CROSS JOIN whole LEFT JOIN best2 ON true"""))
def search_refit(data):
    """The winner refitted on all orders, stored, loaded by its address, and applied to the stored rows."""
    store = ModelStore(data.spark, new_shared_folder(data.spark, "models"))
    tuning.refit_best(_search(data), _orders(data), store, "two-class", "run1", "ALL")
    model = store.model("two-class", "run1", "ALL")
    scored = model.score(store.rows("two-class", "run1", "ALL")).select("rowIndex", F.col("probability")[0].alias("predicted_prob"))
    return rounded(scored, "predicted_prob")


@query("search_embeddings", with_sql("""vec AS (SELECT vec_id AS rowIndex, CASE WHEN label < 5 THEN 'Stimulated' ELSE 'Repressed' END AS obs FROM embeddings),
  folded AS (SELECT CAST((row_number() OVER (PARTITION BY obs ORDER BY md5(concat_ws('-', rowIndex, 1, '1'))) - 1) % 5 + 1 AS INT) AS Fold FROM vec)""",
    body="SELECT c::INT AS Candidate, 1 AS Rep, Fold, count(*) AS n, true AS Finite FROM folded, range(1, 4) AS r(c) GROUP BY ALL"))
def search_embeddings(data):
    """Three random candidates over five folds and all 64 components with gaps: deep trees, drawn rows and features, dropout."""
    df, features = data.trainable()
    candidates = boosting.random_candidates(3, seed=7, base=BoostParams(max_bins=32), max_rounds=4)
    metrics = tuning.search(df, features, TWO, candidates, folds=5, repeats=1).metrics
    finite = F.col("logLoss").isNotNull() & ~F.isnan("logLoss") & (F.col("logLoss") > 0) & (F.col("logLoss") < 34.6)
    return metrics.select("Candidate", "Rep", "Fold", "n", finite.alias("Finite"))
