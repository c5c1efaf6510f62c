import pytest
from pyspark.sql import functions as F

from traitlens.functions.names import col
from traitlens.operators import cohorts, merging, reshape
from traitlens.plans import prepare
from traitlens.sources import readers, store


def rows(df, *names):
    return sorted((tuple(r) for r in (df.select(*[col(n) for n in names]) if names else df).collect()), key=repr)


def land(path, text):
    path.write_text(text)
    return str(path)


def test_ragged_and_plain_tsv(spark, tmp_path):
    ragged = land(tmp_path / "a.txt", "SeqName\tCpG\tS-Bias\n>G1|T1\t0.5\tNA\t\n>G2|T2\t1\t2\t\n")
    df = readers.read_ragged_tsv(spark, ragged)
    assert df.columns == ["SeqName", "CpG", "S-Bias"]
    assert rows(df) == [(">G1|T1", 0.5, None), (">G2|T2", 1.0, 2.0)]
    plain = land(tmp_path / "b.txt", "Gene\tCpG\nG1\t0.5\n")
    assert rows(readers.read_ragged_tsv(spark, plain)) == [("G1", 0.5)]
    header_tab = land(tmp_path / "c.txt", "Gene\tCpG\t\nG1\t0.5\t\n")
    assert rows(readers.read_ragged_tsv(spark, header_tab)) == [("G1", 0.5)]


def test_hosts_with_differing_headers(spark, tmp_path):
    land(tmp_path / "cow_x.txt", "Gene\tCpG\nA\t1\n")
    land(tmp_path / "dog_x.txt", "Gene\tCpG\tGCcont\nB\t2\t3\n")
    df = readers.read_hosts(spark, ["cow", "dog"], "_x.txt", str(tmp_path))
    assert rows(df, "HOST", "Gene", "CpG", "GCcont") == [("cow", "A", 1.0, None), ("dog", "B", 2.0, 3.0)]


def test_strings_csv_keeps_text_and_empty_is_null(spark, tmp_path):
    path = land(tmp_path / "l.csv", "gene,ensemble_id,ko,exo\nA,E01,ZAP-IN,\nB,E02,ZAP-DEP,ZAP-IN\n")
    df = readers.read_strings_csv(spark, path, ["gene", "ensemble_id", "ko", "exo"])
    assert rows(df) == [("A", "E01", "ZAP-IN", None), ("B", "E02", "ZAP-DEP", "ZAP-IN")]


def test_artifacts_prune_by_run_and_host(spark, tmp_path):
    df = spark.createDataFrame([("cow", 1), ("dog", 2)], "HOST string, x int")
    store.write_artifact(df, str(tmp_path), "Data", "r1")
    store.write_artifact(df.withColumn("x", F.col("x") * 10), str(tmp_path), "Data", "r2")
    back = store.read_artifact(spark, str(tmp_path), "Data", "r2", "dog")
    assert rows(back, "x") == [(20,)]
    assert "PartitionFilters: [isnotnull(runid" in back._jdf.queryExecution().toString()


def test_settle_uses_the_sessions_folder(spark, tmp_path):
    spark.conf.set("spark.checkpoint.dir", str(tmp_path)) if spark.conf.isModifiable("spark.checkpoint.dir") else None
    df = store.settle(spark.range(5).toDF("a%b-c"))
    assert rows(df) == [(i,) for i in range(5)]
    if spark.conf.isModifiable("spark.checkpoint.dir"):
        assert any(tmp_path.iterdir())
        spark.conf.unset("spark.checkpoint.dir")


def test_outer_merge_with_plain_and_null_safe_keys(spark):
    a = spark.createDataFrame([("x", 1), (None, 2)], "k string, a int")
    b = spark.createDataFrame([("y", 3), (None, 4)], "k string, b int")
    assert rows(merging.merge_outer([a, b], ["k"])) == sorted([("x", 1, None), ("y", None, 3), (None, 2, None), (None, None, 4)], key=repr)
    assert rows(merging.merge_outer([a, b], ["k"], null_safe=True)) == sorted([("x", 1, None), ("y", None, 3), (None, 2, 4)], key=repr)


def test_enrich_renames_clashes_and_keeps_rows(spark):
    left = spark.createDataFrame([("g1", "a"), ("g2", "b"), (None, "c")], "Gene string, Cat string")
    right = spark.createDataFrame([("g1", "z", 9), ("g1", "y", 8)], "Id string, Cat string, v int")
    out = merging.enrich(left, right, {"Gene": "Id"})
    assert out.columns == ["Gene", "Cat", "Cat_other", "v"]
    assert rows(out) == sorted([("g1", "a", "z", 9), ("g1", "a", "y", 8), ("g2", "b", None, None), (None, "c", None, None)], key=repr)


def test_membership_and_key_checks(spark):
    a = spark.createDataFrame([(1,), (2,), (2,)], "k int")
    b = spark.createDataFrame([(2,), (3,)], "k int")
    assert rows(merging.members(a, b, ["k"])) == [(2,), (2,)]
    assert rows(merging.strangers(a, b, ["k"])) == [(1,)]
    assert rows(merging.key_violations(a, ["k"])) == [(2, 2)]
    for check in (lambda: merging.require_disjoint(a, b, ["k"]), lambda: merging.require_contained(a, b, ["k"]), lambda: merging.require_unique(a, ["k"]), lambda: merging.require_rows(a, 4)):
        with pytest.raises(ValueError):
            check()
    merging.require_unique(b, ["k"])
    merging.require_rows(a, 3)


def test_uniqueness_key_is_a_choice(spark):
    """The same gene under two hosts breaks the gene key but not the composite one."""
    df = spark.createDataFrame([("human", "g"), ("biomart", "g")], ["HOST", "Gene"])
    with pytest.raises(ValueError):
        merging.require_unique(df, ["Gene"])
    merging.require_unique(df, ["HOST", "Gene"])


def test_long_wide_round_trip_keeps_nulls(spark):
    df = spark.createDataFrame([(1, 0.5, None), (2, 1.5, 2.5)], "id int, `CG%` double, `S-Bias` double")
    long = reshape.to_long(df, ["id"])
    assert long.count() == 4 and long.where("Value is null").count() == 1
    assert rows(reshape.to_wide(long, ["id"], "Feature", "Value", ["CG%", "S-Bias"])) == rows(df)


def test_identifiers_and_resamples(spark):
    df = spark.createDataFrame([(">G|T",), ("G2",)], ["SeqName"])
    assert rows(reshape.identifier_parts(df)) == sorted([("G", "T"), ("G2", None)], key=repr)
    assert rows(reshape.resample_parts(spark.createDataFrame([("Fold1.Rep01",)], ["Resample"]))) == [("Fold1", "Rep01")]


def test_relabelled_copy(spark):
    df = spark.createDataFrame([("human", 1), ("cow", 2)], ["HOST", "x"])
    assert rows(reshape.relabelled_copy(df, "HOST", "human", "biomart")) == [("biomart", 1), ("cow", 2), ("human", 1)]


def test_cohorts_and_tasks(spark):
    merged = spark.createDataFrame(
        [("h", "a", "Stimulated", 1.0), ("h", "b", "NonDE", None), ("h", "c", None, 0.5), ("h", "d", "Repressed", -1.0)], "HOST string, Gene string, ExpressionCategory string, Log2FC double"
    )
    assert rows(cohorts.observed_rows(merged), "Gene") == [("a",), ("d",)]
    lists = spark.createDataFrame([("h", "c", "ISG"), ("h", "d", "Random"), ("h", "q", "IRG")], ["HOST", "Gene", "Class"])
    assert rows(cohorts.selected_rows(merged, lists), "Gene", "ExpressionCategory") == [("c", "Stimulated"), ("d", "NonDE")]
    tasks = rows(cohorts.task_rows(merged), "Task", "Gene", "Level")
    assert ("ISGvsIRG", "a", 1) in tasks and ("ISGvsIRG", "d", 2) in tasks and not any(t[0] == "ISGvsIRG" and t[1] == "b" for t in tasks)
    assert ("3Class", "b", 1) in tasks and ("IRGvsRandom", "d", 1) in tasks
    assert rows(cohorts.task_data(merged, "ISGvsRandom"), "Gene") == [("a",), ("b",)]
    with pytest.raises(ValueError):
        cohorts.task_data(merged, "nothing")


def test_holdout_bottom_uses_each_keys_largest_value_by_default(spark):
    df = spark.createDataFrame([("a", 5.0), ("a", -9.0), ("b", 1.0), ("c", 0.0)], "g string, x double")
    low = lambda how: rows(cohorts.holdout_extremes(df, "g", "x", 1, how).where("Label = 'Repressed'"), "g")
    assert low("max") == [("c",)]
    assert low("min") == [("a",)]


def test_seeded_sample_repeats(spark):
    df = spark.range(500).withColumnRenamed("id", "k")
    first = rows(cohorts.seeded_sample(df.repartition(3), "k", 20, 7))
    assert first == rows(cohorts.seeded_sample(df.repartition(5), "k", 20, 7)) and len(first) == 20
    assert first != rows(cohorts.seeded_sample(df, "k", 20, 8))


def test_prepare_end_to_end(spark, tmp_path):
    one = tmp_path / "one"
    two = tmp_path / "two"
    one.mkdir(), two.mkdir()
    for host, gene in (("human", "A"), ("cow", "B")):
        land(one / f"{host}{prepare.PART_ONE_CODING}", f"Gene\tGCcont\tCpG\tCG%\tjunk\n{gene}\t50\t0.5\t3\t1\n")
        land(one / f"{host}{prepare.PART_ONE_GENE}", f"Gene\tGCcont\tCpG\tCG%\n{gene}\t40\t0.4\t2\n{gene}x\t1\t1\t1\n")
        land(two / f"{host}{prepare.PART_TWO}", f"SeqName\tbrCpG\tS-Bias\tTGC-Bias\tATG(M)-TGC(C)\n>{gene}|T\t1\t2\t3\t4\t\n>{gene}y|T\t1\t2\t3\t4\t\n")
    meta = land(
        tmp_path / "ids.csv",
        "Species,ENSEMBL ID,Gene,Expression,log2 Fold Change,FDR\nHomo sapiens,A,S1,up_regulated,2.5,-\nHomo sapiens,A,S1,up_regulated,2.5,-\nBos taurus,B,S2,not_differentially_expressed,NA,0.5\n",
    )
    out = prepare.prepare_input(spark, ["human", "cow"], str(one), str(two), meta, str(tmp_path / "out"))
    assert out.count() == 6
    assert {"CpG_Coding", "CG%_EntireGene", "S-Bias_Coding", "brCpG_Coding", "TGC-Bias_Coding"} <= set(out.columns)
    assert not any("junk" in c or "(" in c for c in out.columns)
    got = {r.Gene: r for r in out.collect()}
    assert got["A"].ExpressionCategory == "Stimulated" and got["A"].Log2FC == 2.5 and got["A"].FDR is None
    assert got["B"].ExpressionCategory == "NonDE" and got["B"].Log2FC is None
    assert got["Ax"]["CpG_Coding"] is None and got["Ay"]["CpG_EntireGene"] is None and got["Ay"]["S-Bias_Coding"] == 2.0


def test_biomart_copy_needs_the_composite_key(spark):
    raw = spark.createDataFrame([("Homo sapiens", "A", "S", "down_regulated", -1.0, 0.1)], list(prepare.IDENTITY_COLUMNS))
    assert rows(prepare.clean_identities(raw, duplicate_for=("human", "biomart")), "HOST", "ExpressionCategory") == [("biomart", "Repressed"), ("human", "Repressed")]


@pytest.mark.parametrize("null_safe", [False, True])
def test_hot_keys_take_the_split_merge_with_the_same_result(spark, monkeypatch, null_safe):
    from traitlens.operators import skew

    a = spark.createDataFrame([("x", i) for i in range(40)] + [(None, 1), (None, 2), ("left", 3)], "k string, a int")
    b = spark.createDataFrame([("x", 1), ("y", 3), (None, 4)], "k string, b int")
    c = spark.createDataFrame([("x", 7), ("z", 8)], "k string, c int")
    plain = rows(merging.merge_outer([a, b, c], ["k"], null_safe), "k", "a", "b", "c")
    monkeypatch.setattr(skew, "HOT_ROWS", 20)
    assert skew.hot_keys([a, b], ["k"]) == [{'{"k":"x"}'}, set()]
    assert rows(merging.merge_outer([a, b, c], ["k"], null_safe), "k", "a", "b", "c") == plain


def test_partitioned_settle_prunes(spark):
    df = store.settle(spark.range(40).selectExpr("id", "id % 4 AS Rep", "id % 2 AS Fold"), ["Rep", "Fold"])
    part = df.where("Rep = 1 AND Fold = 1")
    assert df.columns == ["id", "Rep", "Fold"] and part.count() == 10
    assert "PartitionFilters: [isnotnull(Rep" in part._jdf.queryExecution().toString()


def test_split_merge_reads_each_input_once_beyond_the_search(spark, monkeypatch):
    """The search for hot keys reads the inputs; the joins that the merge is put together from read what was written."""
    from traitlens.operators import skew

    monkeypatch.setattr(skew, "HOT_ROWS", 20)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    frames = [spark.createDataFrame([("x" if i % 2 else f"{v}{i}", i) for i in range(60)], f"k string, {v} long").mapInPandas(counted, f"k string, {v} long") for v in "ab"]
    assert all(skew.hot_keys(frames, ["k"]))
    search = read.value
    merged = merging.merge_outer(frames, ["k"])
    assert merged.count() == 30 * 30 + 30 + 30
    assert read.value == 2 * search + 60 * len(frames)
