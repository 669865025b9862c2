"""Lineage cuts, code for the workers, and the rule for the checkpoint folder."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from statuta import session as S


def test_cut_reads_back_equal_rows(spark):
    df = spark.range(5).withColumn("x.y", F.col("id") * 2)
    got = S.cut(df)
    assert got.columns == df.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, df.collect()))
    # A union of a cut frame with itself after a filter must not stumble over old constraints.
    assert got.where("id > 2").unionByName(got.where("id <= 2")).distinct().count() == 5


def test_code_is_shipped_once(spark):
    S.ship(spark)
    before = list(spark.sparkContext._python_includes)
    S.ship(spark)
    assert list(spark.sparkContext._python_includes) == before and any(p.endswith("statuta.zip") for p in before)


def context(master, directory=None, named=None):
    seen = {}
    sc = SimpleNamespace(master=master, getCheckpointDir=lambda: directory, setCheckpointDir=lambda d: seen.setdefault("dir", d))
    return SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda k, d: named)), seen


def test_checkpoint_folder():
    spark, seen = context("spark://host", directory="/shared/x")
    assert S.checkpoint_dir(spark) == "/shared/x" and not seen
    spark, seen = context("spark://host", named="/shared/y")
    assert S.checkpoint_dir(spark) == "/shared/y" == seen["dir"]
    spark, _ = context("local-cluster[2,1,512]")
    with pytest.raises(ValueError):
        S.checkpoint_dir(spark)
    spark, seen = context("local[2]")
    assert S.checkpoint_dir(spark) == seen["dir"]
