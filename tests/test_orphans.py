"""Orphan references: match rules for keys with nulls, and the reasons of citations."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from statuta.operators.orphans import FULL, PARTIAL, SIMPLE, citation_orphans, orphan_references, orphan_report

REFS = [(1, "a"), (1, "z"), (None, "a"), (None, "z"), (2, None), (9, None), (None, None), (1, "z")]
TARGETS = [(1, "a"), (1, "b"), (2, "c"), (None, "z"), (1, "a")]


@pytest.mark.parametrize(
    "match,expected",
    [
        (SIMPLE, [(1, "z"), (1, "z")]),
        (PARTIAL, [(1, "z"), (1, "z"), (9, None)]),
        (FULL, [(1, "z"), (1, "z"), (None, "a"), (None, "z"), (2, None), (9, None)]),
    ],
)
def test_match_rules(spark, match, expected):
    refs = spark.createDataFrame(REFS, "k1 int, k2 string").withColumn("__key0", F.lit(5))
    targets = spark.createDataFrame(TARGETS, "k1 int, k2 string")
    got = orphan_references(refs, targets, [("k1", "k1"), ("k2", "k2")], match)
    assert got.columns == ["k1", "k2", "__key0"]
    key = lambda r: (str(r[0]), str(r[1]))
    # A null in a target matches nothing, but its other column still counts.
    partial_targets = {"z"} if match == PARTIAL else set()
    rows = [(r.k1, r.k2) for r in got.collect()]
    assert sorted(rows, key=key) == sorted([e for e in expected if not (e[0] is None and e[1] in partial_targets)], key=key)


@pytest.mark.parametrize("match", [SIMPLE, PARTIAL, FULL])
def test_three_columns_and_salt_by_brute_force(spark, match):
    import random

    rng = random.Random(3)
    value = lambda: rng.choice([None, 1, 2, 3])
    refs = [(value(), value(), value(), i) for i in range(300)] + [(1, 1, 1, 300 + i) for i in range(200)]
    targets = [(value(), value(), value()) for _ in range(12)]

    def orphan(r):
        asked = [i for i in range(3) if r[i] is not None]
        if not asked or match == SIMPLE and len(asked) < 3:
            return False
        if match == FULL and len(asked) < 3:
            return True
        return not any(all(t[i] == r[i] for i in asked) for t in targets)

    columns = [("a", "a"), ("b", "b"), ("c", "c")]
    r, t = spark.createDataFrame(refs, "a int, b int, c int, n int"), spark.createDataFrame(targets, "a int, b int, c int")
    for salt in ((), ("n",)):
        assert sorted(x.n for x in orphan_references(r, t, columns, match, salt).collect()) == [x[3] for x in refs if orphan(x)]


def test_hot_join_both_ways(spark, monkeypatch):
    from statuta import session

    left = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 7), (None, 8)], "k int, n int")
    right = spark.createDataFrame([(1, "x"), (3, "y")], "k int, v string")
    for most in (True, False):
        monkeypatch.setattr(session, "is_small", lambda df, most=most: most)
        got = sorted((r.n, r.v) for r in session.hot_join(left, right, ["k"], ["n"]).where("v IS NOT NULL").collect())
        assert got == [(i, "x") for i in range(50)]
        assert session.hot_join(left, right, ["k"], ["n"]).count() == 52


def test_unknown_rule(spark):
    df = spark.createDataFrame(REFS, "k1 int, k2 string")
    with pytest.raises(ValueError):
        orphan_references(df, df, [("k1", "k1")], "loose")


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


ACT = "nro long, elements map<string, struct<children: array<string>, parent: string, text: string, keywords: array<int>>>, fetched_at timestamp, withdrawn_at timestamp"
QUESTION = "nro long, relatedActs array<struct<nro: bigint, relationData: array<struct<nro: bigint, id: string>>>>, fetched_at timestamp"
KEYWORD = "conceptId long, instanceOfType long, actRelations array<struct<relationData: struct<units: array<struct<nro: bigint, id: string>>>>>, fetched_at timestamp"


def test_reasons(spark):
    leaf = ([], None, None, None)
    acts = [
        (1, {"art(1)": leaf, "art(4)": leaf}, day(0), None), (1, {"art(9)": leaf}, day(-5), None),
        (2, {"art(1)": leaf}, day(0), day(10)), (3, {}, day(20), None), (4, None, day(0), None),
    ]
    cited = lambda n, *ids: (n, [(n, i) for i in ids])
    questions = [
        (10, [cited(1, "art(1)", "art(IV)", "@ART(4)", "art(9)", "art(1)-art(IV)", "art(1)-art(7)", "all()", None, "art(7)", "art(7)")], day(10)),
        (10, [cited(77)], day(1)),
        (11, [cited(2, "art(1)"), cited(3, "x"), cited(5, "art(1)"), (None, None), (4, None)], day(10)),
        (12, [cited(2), (4, [(4, "art(1)")])], day(9)), (13, None, day(1)), (None, [cited(5)], day(1)),
    ]
    keywords = [(7, 8, [(([(1, "art(4)"), (1, "art(5)")],),), ((None,),), (None,)], day(3)), (7, 8, [(([(5, "x")],),)], day(2))]
    orphans = citation_orphans(
        spark.createDataFrame(questions, QUESTION), spark.createDataFrame(keywords, KEYWORD), spark.createDataFrame(acts, ACT)
    )
    got = {(r.field, r.owner, r.act_nro, r.ref_id, r.reason) for r in orphans.collect()}
    assert got == {
        ("citation", "10", 1, "art(9)", "missing"), ("citation", "10", 1, "art(1)-art(7)", "missing"), ("citation", "10", 1, "art(7)", "missing"),
        ("relatedact", "11", 2, "", "deleted"), ("citation", "11", 2, "art(1)", "deleted"), ("relatedact", "11", 3, "", "later"),
        ("citation", "11", 3, "x", "later"), ("relatedact", "11", 5, "", "missing"), ("citation", "11", 5, "art(1)", "missing"),
        ("citation", "12", 4, "art(1)", "missing"), ("unit", "7_8", 1, "art(5)", "missing"),
    }
    counts = {(r.field, r.month, r.reason): r.n for r in orphan_report(orphans).collect()}
    assert counts["citation", "2024-01", "missing"] == 6  # a citation that stands twice counts twice
    assert orphan_report(orphans.limit(0)).count() == 0


def test_empty_tables(spark):
    none = [spark.createDataFrame([], s) for s in (QUESTION, KEYWORD, ACT)]
    assert citation_orphans(*none).count() == 0
