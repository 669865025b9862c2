"""Mixtures: shares, caps, repeatability, and unbiased choice."""

import random

import pytest
from pyspark.sql import functions as F

from statuta.llm import mixing as M
from statuta.llm.tokens import token_counts

TARGET = "source string, weight double, max_repeats int"


def corpus(spark, n=600):
    rng = random.Random(2)
    rows = [(i, rng.choice(["A", " a", "b ", "B", "c", None, "none"]), rng.randrange(0, 60)) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, source string, tokens long"), rows


def test_shares_and_caps(spark):
    docs, rows = corpus(spark)
    targets = spark.createDataFrame([("a", 0.5, 1), ("B", 0.3, 2), ("c", 0.1, 4), ("gone", 0.4, 1), ("zero", 0.0, 1)], TARGET)
    mixed = M.mixture(docs, targets).cache()
    shares = {r.source: r for r in M.shares(mixed, targets).collect()}
    assert set(shares) == {"a", "b", "c", "gone", "zero"} and shares["gone"].target_share is None and shares["gone"].docs == 0
    total = sum(r.size for r in shares.values())
    largest = max(r[2] for r in rows)
    for source, weight, cap in (("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.1, 4)):
        r = shares[source]
        assert abs(r.target_share - weight / 0.9) < 1e-9
        assert abs(r.share - r.target_share) * total <= 2 * largest and r.max_copies <= cap
    again = {(r.doc_id, r.copies) for r in M.mixture(docs.repartition(7), targets).collect()}
    assert again == {(r.doc_id, r.copies) for r in mixed.collect()}
    assert {(r.doc_id, r.copies) for r in M.mixture(docs, targets, seed=5).collect()} != again


def test_a_total_beyond_the_caps(spark):
    docs, rows = corpus(spark)
    targets = spark.createDataFrame([("a", 0.5, 1), ("c", 0.5, None)], TARGET)
    mixed = M.mixture(docs, targets, total=1e9).collect()
    # Every document with a size once: nothing is repeated beyond its cap.
    assert {r.doc_id for r in mixed} == {i for i, s, t in rows if (s or "").strip().lower() in ("a", "c") and t > 0} and {r.copies for r in mixed} == {1}


def test_whole_copies_come_first(spark):
    docs = spark.createDataFrame([(i, "s", 10) for i in range(100)] + [(1000 + i, "t", 10) for i in range(1000)], "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("s", 0.5, 9), ("t", 0.5, 9)], TARGET)
    mixed = M.mixture(docs, targets, total=5000.0)
    counts = {(r.source, r.copies): r["count"] for r in mixed.groupBy("source", "copies").count().collect()}
    assert counts == {("s", 2): 50, ("s", 3): 50, ("t", 1): 250}


def test_every_document_has_its_chance(spark):
    docs = spark.createDataFrame([(i, "s", 1 + i % 3) for i in range(60)] + [(100, "t", 60)], "doc_id long, source string, tokens long").cache()
    targets = spark.createDataFrame([("s", 0.5, 1), ("t", 0.5, 1)], TARGET)
    seen = {}
    for seed in range(12):
        for r in M.mixture(docs, targets, seed=seed).where("source = 's'").collect():
            seen[r.doc_id] = seen.get(r.doc_id, 0) + 1
    assert len(seen) > 50 and max(seen.values()) <= 12


def test_unequal_weights_and_caps(spark):
    docs = spark.createDataFrame([(i, "s", 10, 8.0 if i < 10 else 1.0) for i in range(200)] + [(900, "s", 10, None), (901, "s", 10, 0.0)] + [(1000, "t", 1000, 1.0)], "doc_id long, source string, tokens long, w double")
    targets = spark.createDataFrame([("s", 0.5, 2), ("t", 0.5, 2)], TARGET)
    heavy = light = 0
    for seed in range(4):
        mixed = M.mixture(docs, targets, total=2000.0, weight="w", seed=seed).where("source = 's'").collect()
        assert abs(sum(r.copies * r.size for r in mixed) - 1000) <= 10 and max(r.copies for r in mixed) <= 2
        heavy += sum(r.copies for r in mixed if r.doc_id < 10)
        light += sum(r.copies for r in mixed if r.doc_id >= 10)
    # Ten documents reach their cap of two copies, the others share what is left: 80 of 190.
    assert heavy == 4 * 20 and abs(light - 4 * 80) <= 4


@pytest.mark.parametrize("weighted,total", [(False, None), (False, 4000.0), (True, 3000.0)])
def test_error_bound(spark, weighted, total):
    """Every source misses its target by half its largest document at most."""
    docs, rows = corpus(spark, 900)
    docs = docs.withColumn("w", F.when(F.col("doc_id") % 3 == 0, 5.0).otherwise(0.5))
    targets = spark.createDataFrame([("a", 0.5, 1), ("B", 0.3, 2), ("c", 0.1, 4)], TARGET)
    sizes = docs.select(M.source_key(F.col("source")).alias("source"), F.col("tokens").alias("size"))
    goal = {r.source: r.target for r in M.plan(sizes, targets, total).collect()}
    for seed in range(3):
        got = {r.source: r.n for r in M.mixture(docs, targets, total=total, seed=seed, weight="w" if weighted else None).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("n")).collect()}
        assert all(abs(got[s] - goal[s]) <= 59 / 2 + 1 for s in goal)


def test_empty(spark):
    docs, _ = corpus(spark)
    targets = spark.createDataFrame([("a", 1.0, 1)], TARGET)
    assert M.mixture(docs.limit(0), targets).count() == 0
    assert M.mixture(docs, targets.limit(0)).count() == 0


def test_token_counts(spark):
    df = spark.createDataFrame([("Ala ma kota.",), ("",), (None,), ("słowo " * 20_000,)], "text string")
    n = [r.n for r in df.select(token_counts(spark, F.col("text")).alias("n")).collect()]
    assert 3 <= n[0] <= 8 and n[1:3] == [0, 0] and n[3] >= 20_000
