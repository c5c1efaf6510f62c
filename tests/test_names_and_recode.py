import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from traitlens.functions import names, recode


def one(df):
    return [tuple(r) for r in df.collect()]


def test_families_keep_case_and_source_order(spark):
    df = spark.createDataFrame([("h", "g", 1.0, 2.0, 3.0, 4.0)], ["HOST", "Gene", "CG%", "tpa", "CpG", "gccont"])
    assert names.select_families(df, ["HOST", "Gene"], ["dinucleotide_bias", "dinucleotide_percent"]).columns == ["HOST", "Gene", "CG%", "CpG"]


@pytest.mark.parametrize(
    "family,name,hit",
    [
        ("nucleotide_content", "GCcont", True),
        ("nucleotide_content", "GCcontent", False),
        ("bridge_dinucleotide", "brCpG", True),
        ("dinucleotide_bias", "brCpG", False),
        ("non_bridge_dinucleotide", "NonBrUpA", True),
        ("amino_acid_bias", "S-Bias", True),
        ("codon_bias", "S-Bias", False),
        ("codon_bias", "TGC-Bias", True),
        ("codon_bias", "TGC(C)-TGC(C)", False),
    ],
)
def test_family_patterns(family, name, hit):
    assert (names.family_columns([name], [family]) == [name]) is hit


def test_case_collision_is_refused():
    with pytest.raises(ValueError):
        names.check_case_collisions(["CpG", "x", "cpg"])


def test_suffix_prefix_alias_contains(spark):
    df = spark.createDataFrame([("g", 1.0, 2.0, 3.0)], ["Gene", "ApU", "S-Bias", "brCpG"])
    assert names.add_suffix(df, ["Gene"], "_Coding").columns == ["Gene", "ApU_Coding", "S-Bias_Coding", "brCpG_Coding"]
    assert names.harmonise(df).columns == ["Gene", "ApT", "S-Bias", "brCpG"]
    assert names.drop_prefixed(df, "br").columns == ["Gene", "ApU", "S-Bias"]
    assert names.containing(df.columns, "cpg", "bias") == ["S-Bias", "brCpG"]


def test_sanitised_and_quoted(spark):
    df = spark.createDataFrame([(1, 2)], ["ENSEMBL ID", "a`b.c"])
    assert names.sanitised(df).columns == ["ENSEMBL_ID", "a_b_c"]
    assert df.select(names.col("a`b.c").alias("x")).first().x == 2


def test_feature_class_is_idempotent_and_keeps_u(spark):
    df = spark.createDataFrame([("CG%_EntireGene",), ("brCpG_Coding",), ("NonBrTpA_Coding",), ("UpA_Coding",), ("TA%_Coding",), ("S-Bias_Coding",), ("GCcont_Coding",)], ["f"])
    once = names.feature_class(F.col("f"))
    got = {r.f: (r.a, r.b, r.c) for r in df.select("f", once.alias("a"), names.feature_class(once).alias("b"), names.feature_class(F.col("f"), u_to_t=True).alias("c")).collect()}
    assert got["CG%_EntireGene"][0] == got["brCpG_Coding"][0] == "CpG"
    assert got["UpA_Coding"] == ("UpA", "UpA", "TpA")  # spelled with U it stays its own class unless asked
    assert got["TA%_Coding"][0] == "TpA"
    assert got["S-Bias_Coding"][0] == "S-Bias" and got["GCcont_Coding"][0] == "GCcont"
    assert all(a == b for a, b, _ in got.values())


def test_recode_strict_fails_on_unknown_and_null(spark):
    maps = {"x": {"a": "A"}}
    assert one(recode.recode_strict(spark.createDataFrame([("a",)], ["x"]), maps)) == [("A",)]
    for bad in ("b", None):
        with pytest.raises(PySparkException):
            recode.recode_strict(spark.createDataFrame([("a",), (bad,)], "x string"), maps).collect()
    report = recode.unmapped(spark.createDataFrame([("a",), ("b",), ("b",)], ["x"]), maps)
    assert one(report.select("field", "value", "n")) == [("x", "b", 2)]


def test_ordinal_and_restricted(spark):
    df = spark.createDataFrame([("b",), ("a",), ("z",), (None,)], "x string")
    rows = one(df.select(recode.ordinal(F.col("x"), ["a", "b"]), recode.restricted(F.col("x"), ["a", "b"])))
    assert rows == [(2, "b"), (1, "a"), (None, None), (None, None)]


def test_null_tokens(spark):
    df = spark.createDataFrame([("NA",), ("-",), ("",), ("1.5",), (None,), ("x",)], "x string")
    assert [r[0] for r in df.select(recode.numeric_or_null(F.col("x"))).collect()] == [None, None, None, 1.5, None, None]


def test_selected_class_and_strict(spark):
    df = spark.createDataFrame([("Random",), ("ISG",), ("IRG",), ("odd",), (None,)], "c string")
    assert [r[0] for r in df.select(recode.selected_class(F.col("c"))).collect()] == ["NonDE", "Stimulated", "Repressed", "Repressed", None]
    with pytest.raises(PySparkException):
        df.select(recode.selected_class(F.col("c"), strict=True)).collect()


def test_label_prints_missing_category_as_na(spark):
    df = spark.createDataFrame([(None, "KO"), ("IRG", "KO")], "c string, t string")
    assert [r[0] for r in df.select(recode.labelled_treatment(F.col("c"), F.col("t"))).collect()] == ["NA (KO)", "IRG (KO)"]


def test_strict_recode_fails_even_when_the_column_is_not_read(spark):
    df = spark.createDataFrame([("x", 1), ("unknown", 2)], "a string, b int")
    checked = recode.recode_strict(df, {"a": {"x": "X"}})
    with pytest.raises(Exception, match="no mapping for unknown"):
        checked.select("b").collect()
    with pytest.raises(Exception, match="no mapping for unknown"):
        checked.count()
    assert [tuple(r) for r in recode.recode_strict(df.limit(1), {"a": {"x": "X"}}).collect()] == [("X", 1)]
