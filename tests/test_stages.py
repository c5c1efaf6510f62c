import os

import pytest
from pyspark.sql import functions as F

from traitlens.operators.boosting import BoostParams
from traitlens.operators.merging import enrich
from traitlens.plans import jobs, prepare, tuning
from traitlens.sources.models import ModelStore
from traitlens.sources.stages import Checked, Stages, files_fingerprint, write_checked
from traitlens.sources.store import new_shared_folder

STUMP = BoostParams(rounds=1, max_depth=1, rate_drop=0.0)


@pytest.fixture
def stages(spark):
    return Stages(spark, new_shared_folder(spark, "stages"))


def files_under(root):
    found = {}
    for folder, _, names in os.walk(root.removeprefix("file:")):
        found |= {os.path.join(folder, n): os.path.getmtime(os.path.join(folder, n)) for n in names}
    return found


def test_checks_are_counted_while_writing(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, "b")], "k int, v string")
    path = lambda: new_shared_folder(spark, "checked")
    assert write_checked(spark, Checked(df, never={"negative": F.col("k") < 0}, rows=3), path()) == 3
    # A condition that is NULL for a row is not met by it.
    assert write_checked(spark, Checked(df, never={"z": F.col("v") == "z"}), path()) == 3
    with pytest.raises(ValueError, match="no value.*1"):
        write_checked(spark, Checked(df, never={"no value": F.col("v").isNull(), "negative": F.col("k") < 0}), path())
    with pytest.raises(ValueError, match="expected 4 rows, found 3"):
        write_checked(spark, Checked(df, rows=4), path())
    with pytest.raises(ValueError, match="repeated keys"):
        write_checked(spark, Checked(df, unique=("k",)), path())
    assert write_checked(spark, Checked(df.where("k > 9"), never={"negative": F.col("k") < 0}, rows=0, unique=("k",)), path()) == 0


def test_membership_is_checked_in_the_joining_pass(spark):
    left = spark.createDataFrame([("a",), ("b",)], "k string")
    known = spark.createDataFrame([("a", True)], "k string, found boolean")
    joined = enrich(left, known, ["k"])
    with pytest.raises(ValueError, match="unknown"):
        write_checked(spark, Checked(joined, never={"unknown": F.col("found").isNull()}), new_shared_folder(spark, "checked"))


def test_a_stage_is_made_once_per_state(spark, stages):
    made = []
    source = new_shared_folder(spark, "source")
    spark.range(3).write.parquet(source)

    def build(_):
        made.append(1)
        return {"t": Checked(spark.read.parquet(source).withColumn("p", F.lit("007")), partition_by=("p",)), "empty": spark.range(0)}, {"n": len(made)}

    run = lambda **kw: stages.run("s", build, files=[source], **kw)
    first = run(settings={"a": 1})
    assert first.made and first.rows == {"t": 3, "empty": 0} and first.notes == {"n": 1}
    before = files_under(stages.root)
    again = Stages(spark, stages.root).run("s", build, files=[source], settings={"a": 1})
    assert not again.made and len(made) == 1 and files_under(stages.root) == before
    # Values of partition columns keep their type and spelling.
    assert {r.p for r in again["t"].collect()} == {"007"} and again["empty"].count() == 0
    assert run(settings={"a": 2}).made and not run(settings={"a": 2}).made
    spark.range(1).write.mode("append").parquet(source)
    grown = run(settings={"a": 1})
    assert grown.made and grown.rows["t"] == 4 and len(made) == 3
    after = lambda stage: stages.run("later", lambda _: ({"t": stage["t"]}, {}), after=[stage])
    assert after(first).made and after(grown).made and not after(grown).made


def test_a_failed_check_leaves_no_stage(spark, stages):
    bad = lambda _: ({"t": Checked(spark.range(2), rows=3)}, {})
    with pytest.raises(ValueError):
        stages.run("s", bad)
    good = stages.run("s", lambda _: ({"t": Checked(spark.range(3), rows=3)}, {}))
    assert good.made and good["t"].count() == 3


def test_fingerprints_follow_the_files(spark):
    folder = new_shared_folder(spark, "files")
    spark.range(2).write.csv(f"{folder}/a")
    one = files_fingerprint(spark, [f"{folder}/a"])
    spark.range(2).write.csv(f"{folder}/b")
    assert files_fingerprint(spark, [f"{folder}/a"]) == one != files_fingerprint(spark, [f"{folder}/a", f"{folder}/b"])
    assert files_fingerprint(spark, []) == ""


# ---- whole jobs ---------------------------------------------------------------------------------


def ragged(path, header, rows):
    with open(path, "w") as f:
        f.write("\t".join(header) + "\n" + "".join("\t".join(map(str, r)) + "\t\n" for r in rows))


@pytest.fixture(scope="module")
def landed(tmp_path_factory):
    """Two hosts with 30 genes each; high values go with one class."""
    root = tmp_path_factory.mktemp("landed")
    identities = ["Species,ENSEMBL ID,Gene,Expression,log2 Fold Change,FDR"]
    terms = ("up_regulated", "down_regulated", "not_differentially_expressed")
    for host, species in (("human", "Homo sapiens"), ("cow", "Bos taurus")):
        genes = [f"{host}{i:02d}" for i in range(30)]
        up = lambda i: 10 if i % 3 == 0 else 0
        ragged(root / f"{host}{prepare.PART_ONE_CODING}", ["Gene", "GCcont", "CpG"], [(g, 40 + up(i) + i % 4, "NA" if i % 5 == 0 else i % 7) for i, g in enumerate(genes)])
        ragged(root / f"{host}{prepare.PART_ONE_GENE}", ["Gene", "GCcont"] + (["TpA"] if host == "cow" else []), [(g, i % 6) + ((1,) if host == "cow" else ()) for i, g in enumerate(genes)])
        ragged(root / f"{host}{prepare.PART_TWO}", ["SeqName", "brCpG"], [(f">{g}|T", i % 9) for i, g in enumerate(genes) if i % 2])
        identities += [f"{species},{g},S,{terms[i % 3]},{i - 15},{'-' if i == 4 else 0.01}" for i, g in enumerate(genes)]
        listed = [f"{g},{('ISG', 'IRG', 'Random')[i % 3]},x" for i, g in enumerate(genes[:12])]
        (root / f"{host}{jobs.LISTED}").write_text("\n".join(["Ensembl gene ID,Class,Other", *listed]) + "\n")
    (root / "identities.csv").write_text("\n".join(identities) + "\n")
    ragged(root / "cds.txt", ["SeqName", "CpG", "brCpG"], [(f">m{i}|T", i % 7, i % 9) for i in range(8)] * 2)
    ragged(root / "cg.txt", ["Gene", "GCcont"], [(f"m{i}", 40 + (10 if i < 4 else 0)) for i in range(8)])
    ragged(root / "cdna.txt", ["Gene", "GCcont", "TpA"], [(f"m{i}", 3, 1) for i in range(8)])
    (root / "measured.csv").write_text("Ensembl ID,Fold Change\n" + "".join(f"m{i},{v}\n" for i in range(8) for v in (8 - i, -i, "-")))
    return str(root)


@pytest.fixture(scope="module")
def shared(spark):
    """One root for all jobs, so that what one test prepared is read by the next."""
    return Stages(spark, new_shared_folder(spark, "jobs"))


SPECIES = {"Homo sapiens": "human", "Bos taurus": "cow"}


def prepared(stages, landed, **kw):
    return jobs.prepare(stages, ["human", "cow"], landed, landed, f"{landed}/identities.csv", species=SPECIES, **kw)


def test_jobs_from_files_to_report(spark, shared, landed, monkeypatch):
    models = ModelStore(spark, f"{shared.root}/models")
    merged = prepared(shared, landed)
    assert merged.rows == {"merged": 60} and merged["merged"].where("`TpA_EntireGene` is null").count() == 30
    train = lambda: jobs.train(shared, models, merged, "ISGvsIRG", "run1", [STUMP], folds=3, repeats=2)
    trained = train()
    assert trained.rows["data"] == 40 and trained.rows["predictions"] == 80 and trained.rows["metrics"] == 6
    assert "FDR" not in trained.notes["features"] and {r.Host for r in trained["data"].select("Host").distinct().collect()} == {"human", "cow"}
    found = jobs.report(shared, trained, jobs.explain(shared, models, trained), reference="GCcont_Coding", width=3)
    accuracy = {(r.Host, r.obs): r.MeanAccuracy for r in found["accuracy"].collect()}
    assert accuracy == {(h, c): 1.0 for h in ("human", "cow") for c in ("Stimulated", "Repressed")}
    assert found["importance"].orderBy("Rank").first().Feature == "GCcont_Coding"
    assert found.rows["genes"] == 40 and found.rows["class_rank"] == 40 and found.rows["predictions"] == 80
    assert set(found.notes["features"]) == {"CpG_Coding", "brCpG_Coding"}
    # One value only: the feature keeps its row without a correlation.
    assert {r.Feature: r.Correlation for r in found["correlations"].collect()}["TpA_EntireGene"] is None
    assert {r.Panel for r in found["boxes"].select("Panel").distinct().collect()} == {"all", "human", "cow"}
    held = jobs.hold_out(shared, models, trained, f"{landed}/measured.csv", "Ensembl ID", "Fold Change", f"{landed}/cds.txt", f"{landed}/cg.txt", f"{landed}/cdna.txt", n=2)
    told = {r.Gene: (r.ActualLabel, r.PredictedLabel) for r in held["predictions"].collect()}
    assert told["m0"] == ("Stimulated", "Stimulated") and told["m7"] == ("Repressed", "Repressed") and told["m4"] == (None, "Repressed") and len(told) == 8
    # Nothing changed: a second run reads, fits and writes nothing.
    monkeypatch.setattr(tuning, "search", lambda *a, **k: pytest.fail("searched again"))
    before = files_under(shared.root)
    assert not any(s.made for s in (prepared(shared, landed), train(), jobs.report(shared, trained, jobs.explain(shared, models, trained), reference="GCcont_Coding", width=3)))
    assert files_under(shared.root) == before
    # The stage's own version answers, whatever is stored under its address later.
    models.save("ISGvsIRG", "run1", "AllHosts", jobs.model_of(models, trained), trained["data"], {})
    assert trained.notes["version"] == models.versions("ISGvsIRG", "run1", "AllHosts")[0]


def test_listed_training_needs_every_listed_gene(spark, shared, landed):
    models, merged = ModelStore(spark, f"{shared.root}/models"), prepared(shared, landed)
    listed = jobs.selection(shared, ["human", "cow"], landed)
    assert listed.rows == {"listed": 24}
    trained = jobs.train(shared, models, merged, "3Class", "run-top", [STUMP], listed=listed, folds=2, repeats=1)
    assert trained.rows["data"] == 24
    missing = shared.run("more", lambda _: ({"listed": listed["listed"].union(spark.createDataFrame([("cow", "nobody", "ISG")], listed["listed"].schema))}, {}))
    with pytest.raises(ValueError, match="25 listed genes, 24"):
        jobs.train(shared, models, merged, "3Class", "run-top", [STUMP], listed=missing, folds=2, repeats=1)


def test_preparation_refuses_repeated_genes(spark, shared, landed, tmp_path):
    text = open(f"{landed}/identities.csv").read().splitlines()
    path = tmp_path / "identities.csv"
    path.write_text("\n".join([*text, text[1].replace("-15", "3")]) + "\n")
    with pytest.raises(ValueError, match="repeated keys"):
        jobs.prepare(shared, ["human", "cow"], landed, landed, str(path), species=SPECIES)
