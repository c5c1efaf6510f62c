import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from traitlens.operators import ordering


def skewed(spark, rows=6000, seed=0):
    """One group with most rows, a NULL group, a value shared by 40 % of rows, NULL values."""
    rng = np.random.default_rng(seed)
    group = np.where(rng.random(rows) < 0.7, "a", np.where(rng.random(rows) < 0.5, "b", None))
    value = np.where(rng.random(rows) < 0.4, 1.5, np.round(rng.normal(size=rows), 2))
    value[rng.random(rows) < 0.05] = np.nan
    pdf = pd.DataFrame({"id": np.arange(rows), "g": group, "v": value})
    df = spark.createDataFrame([(int(i), g, None if np.isnan(v) else float(v)) for i, g, v in pdf.itertuples(index=False)], "id long, g string, v double")
    return pdf, df.repartition(6)


def test_exact_quantiles_match_type_seven(spark):
    pdf, df = skewed(spark)
    probs = [0.0, 0.025, 0.25, 0.5, 0.75, 0.975, 1.0]
    got = {r.g: (r.n, r.q) for r in ordering.exact_quantiles(df, ["g"], "v", probs).collect()}
    for g, part in pdf.groupby("g", dropna=False):
        x = part.v.dropna()
        n, q = got[g if isinstance(g, str) else None]
        assert n == len(x)
        assert np.allclose(q, np.quantile(x, probs))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-5, 5, allow_nan=False).map(lambda x: round(x, 1)), min_size=1, max_size=60), st.sampled_from([2, 5, 40]))
def test_exact_quantiles_property(spark, values, ranges):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = ordering.exact_quantiles(df, [], "v", [0.1, 0.5, 0.9], ranges=ranges).first().q
    assert np.allclose(got, np.quantile(values, [0.1, 0.5, 0.9]))


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("ranges", [3, 32])
def test_ranks_and_positions(spark, descending, ranges):
    pdf, df = skewed(spark)
    out = ordering.rank_within(df, ["g"], F.col("v"), descending=descending, average="Avg", position="Pos", tiebreak="id", ranges=ranges)
    got = out.toPandas().sort_values("id").reset_index(drop=True)
    group = pdf.g.fillna("~")
    signed = -pdf.v if descending else pdf.v
    known = pdf.v.notna()
    assert (got.Rank[known] == signed.groupby(group).rank(method="min")[known]).all()
    assert np.allclose(got.Avg[known], signed.groupby(group).rank(method="average")[known])
    # missing values rank last, together
    last = signed.groupby(group).transform("count") + 1
    assert (got.Rank[~known] == last[~known]).all()
    order = pd.DataFrame({"g": group, "s": signed, "id": pdf.id}).sort_values(["s", "id"], na_position="last")
    assert (got.Pos == order.groupby("g").cumcount().add(1).sort_index()).all()


def test_position_needs_a_tiebreak(spark):
    with pytest.raises(ValueError):
        ordering.rank_within(skewed(spark, 10)[1], ["g"], F.col("v"), position="p")


def test_no_task_gets_a_whole_hot_group(spark):
    """With one group and one shared value, the final window still spreads."""
    df = spark.range(20_000).select("id", F.lit("g").alias("g"), F.when(F.col("id") % 3 == 0, 1.0).otherwise(F.rand(1)).alias("v"))
    out = ordering.rank_within(df, ["g"], F.col("v"), position="p", tiebreak="id", ranges=32)
    biggest = (
        ordering._ranged(df.withColumn("__v", F.col("v")), ["g"], "__v", 32).where(~F.col("__point")).groupBy("__range").count().agg(F.max("count")).first()[0]
    )
    assert biggest < 20_000 / 8
    assert out.agg(F.count_distinct("p")).first()[0] == 20_000


def test_stable_row_id_is_dense_and_ordered(spark):
    pdf, df = skewed(spark, 2000)
    got = ordering.stable_row_id(df, ["g", "id"]).toPandas().sort_values("rowIndex")
    assert list(got.rowIndex) == list(range(1, 2001))
    assert list(got.id) == list(pdf.assign(g=pdf.g.fillna("")).sort_values(["g", "id"]).id)


@pytest.mark.parametrize("width", [1, 2, 10, 11])
def test_sliding_mean_over_block_edges(spark, width):
    rng = np.random.default_rng(1)
    x = rng.random(150)
    df = spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(x)], "p long, v double").repartition(4)
    got = ordering.sliding_mean(df, [], "p", "v", width, "m", block=13).toPandas().sort_values("p").m.to_numpy()
    after = width // 2
    before = width - 1 - after
    assert np.allclose(got, [x[max(0, i - before) : i + after + 1].mean() for i in range(150)])


def test_top_and_bottom_keep_ties_and_short_tables(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([5, 5, 4, 4, 3, 1, 1])] + [(99, None)], "id int, v double")
    ids = lambda frame: sorted(r.id for r in frame.collect())
    assert ids(ordering.top_with_ties(df, "v", 3)) == [0, 1, 2, 3]
    assert ids(ordering.top_with_ties(df, "v", 1, bottom=True)) == [5, 6]
    assert ids(ordering.top_with_ties(df, "v", 50)) == [0, 1, 2, 3, 4, 5, 6]


def test_hashed_position_is_a_permutation_per_group(spark):
    _, df = skewed(spark, 3000)
    out = ordering.hashed_position(df, ["g"], F.md5(F.col("id").cast("string")), "p").toPandas()
    for _, part in out.groupby("g", dropna=False):
        assert sorted(part.p) == list(range(1, len(part) + 1))


def test_hot_groups_are_ranked_like_any_other(spark, monkeypatch):
    from traitlens.operators import skew

    monkeypatch.setattr(skew, "HOT_ROWS", 50)
    pdf, df = skewed(spark, 3000)
    pdf["k"] = np.where(pdf.index % 3 == 0, -1, pdf.index)
    df = df.withColumn("k", F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")))
    assert len(skew.hot_keys([df], ["g", "k"])[0]) >= 2
    got = ordering.rank_groups(df, ["g", "k"], F.col("v"), descending=True).toPandas().sort_values("id").reset_index(drop=True)
    known = pdf.v.notna()
    want = (-pdf.v).groupby([pdf.g.fillna("~"), pdf.k]).rank(method="min")
    assert len(got) == 3000 and (got.Rank[known] == want[known]).all()


@pytest.mark.parametrize("hot_rows", [1, None])
@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("kind", ["long", "decimal(38,6)", "double", "date"])
def test_ranks_do_not_depend_on_group_size(spark, monkeypatch, hot_rows, descending, kind):
    """The window and the value ranges agree on exact types, NaN and NULL."""
    from traitlens.operators import skew

    if hot_rows:
        monkeypatch.setattr(skew, "HOT_ROWS", hot_rows)
    big = 2**53
    values = {
        "long": [big, big + 1, big + 1, None, -5],
        "decimal(38,6)": ["9007199254740993.000001", "9007199254740993.000002", None, "1"],
        "double": ["NaN", "1.5", "NaN", "Infinity", None, "-0.0", "0.0"],
        "date": ["2020-01-02", "2020-01-01", None, "2020-01-02"],
    }[kind]
    rows = [(g, None if v is None else str(v)) for g in "ab" for v in values]
    df = spark.createDataFrame(rows, "g string, s string").select("g", F.col("s").cast(kind).alias("v"))
    got = ordering.rank_groups(df, ["g"], F.col("v"), descending=descending).select("g", F.col("v").cast("string"), "Rank").collect()
    df.createOrReplaceTempView("ranked_rows")
    order = "DESC NULLS LAST" if descending else "ASC NULLS LAST"
    want = spark.sql(f"SELECT g, CAST(v AS string) AS v, CAST(rank() OVER (PARTITION BY g ORDER BY v {order}) AS long) AS Rank FROM ranked_rows").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, want), key=repr)


def test_text_is_refused_at_every_size(spark):
    with pytest.raises(TypeError):
        ordering.rank_groups(spark.createDataFrame([("a", "x")], "g string, v string"), ["g"], F.col("v"))


def test_pieces_of_one_value_follow_its_rows(spark, monkeypatch):
    """One value, NULLs and ids that lie together: no window gets many more rows than a piece."""
    monkeypatch.setattr(ordering, "PIECE_ROWS", 500)
    df = spark.range(20_000).select("id", F.when(F.col("id") < 8_000, F.lit(1.0)).when(F.col("id") < 12_000, F.lit(None)).otherwise(F.rand(3)).alias("v"))
    tagged = ordering._ranged(df.withColumn("__all", F.lit(1)), ["__all"], "v", 32)
    cut = ordering._with_tiebreak_slices(tagged, ["__all"], "id").where("__point")
    largest = cut.groupBy("__range", "__sub").count().agg(F.max("count")).first()[0]
    assert largest <= 510
    out = ordering.rank_within(df, [], F.col("v"), position="p", tiebreak="id").toPandas().sort_values("p")
    assert (out.p.to_numpy() == np.arange(1, 20_001)).all()
    known = out[out.v.notna()]
    assert known.v.is_monotonic_increasing and known[known.v == 1.0].id.is_monotonic_increasing


def test_splits_merged_in_two_stages_change_no_result(spark, monkeypatch):
    """Sketches meet by a salt first: ranks stay exact, splits stay even, empty groups and NULL keys keep a row."""
    pdf, df = skewed(spark)
    df = df.unionByName(spark.createDataFrame([(90_001, "empty", None)], "id long, g string, v double"))
    wanted = {r.id: r.Rank for r in ordering.rank_within(df, ["g"], F.col("v"), ranges=16).collect()}
    monkeypatch.setattr(ordering, "_FEW_SALTS", 1)
    splits = {r.g: r["__splits"] for r in ordering._split_table(df, ["g"], "v", 16, salts=3).collect()}
    assert set(splits) == {"a", "b", None, "empty"} and not splits["empty"]
    assert 1.5 in splits["a"] and len(splits["a"]) > 5
    assert {r.id: r.Rank for r in ordering.rank_within(df, ["g"], F.col("v"), ranges=16).collect()} == wanted
    got = {r.g: r.q for r in ordering.exact_quantiles(df.where("v is not null"), ["g"], "v", [0.25, 0.5]).collect()}
    assert np.allclose(got["a"], np.quantile(pdf.v[(pdf.g == "a") & pdf.v.notna()], [0.25, 0.5]))
