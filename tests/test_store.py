import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from traitlens.sources import store


def folders(spark):
    root = store.shared_root(spark).removeprefix("file:")
    return {f for f in os.listdir(root) if f.startswith("settled-")}


def test_no_settled_folder_outlives_its_scope(spark):
    before = folders(spark)
    with store.settled_scope(spark):
        rows = entry.queries()["box_stats"](spark, "/root/testdata/sf0.001").collect()
        assert folders(spark) > before
    assert rows and folders(spark) == before


def test_scopes_nest_and_clean_up_after_errors(spark):
    before = folders(spark)
    with pytest.raises(ZeroDivisionError), store.settled_scope(spark):
        with store.settled_scope(spark):
            assert store.settle(spark.range(3)).count() == 3
        kept = store.settle(spark.range(4).withColumn("x", F.lit(1)))
        assert kept.count() == 4
        raise ZeroDivisionError
    assert folders(spark) == before
