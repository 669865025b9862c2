"""Vector search, questions, stores, sources, markup and streams."""

import json

import pytest
from pyspark.sql import functions as F

from statuta import schemas
from statuta.functions.embed import HashingEmbedder, embed_rows
from statuta.operators import questions as Q
from statuta.operators import references as K
from statuta.operators import store as S
from statuta.operators import vector as V
from statuta.operators.current import current_rows
from statuta.plans import evaluate as E
from statuta.sources import json_files, markup, pages
from statuta.streaming.incremental import arrivals_per_window, embed_arrivals


def vectors(spark):
    return spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [-1.0, 0.0]), (4, [2.0, 0.0]), (5, None), (6, [0.0, 0.0]), (7, [1.0])], "id long, vector array<float>")


@pytest.mark.parametrize("block", [4096, 1])
def test_topk(spark, monkeypatch, block):
    for name, value in (("BLOCK", block), ("PART", block), ("MANY", 1)):
        monkeypatch.setattr(V, name, value)
    q = spark.createDataFrame([(10, [1.0, 0.0], 1), (11, [1.0, 0.0], 99), (12, None, 1)], "qid long, vector array<float>, own long")
    got = V.topk(q, vectors(spark), 3, dim=2).orderBy("qid", "rank").collect()
    assert [(r.qid, r.id, round(r.score, 6)) for r in got] == [(q, i, s) for q in (10, 11) for i, s in ((1, 1.0), (4, 1.0), (2, 0.6))]
    got = V.topk(q, vectors(spark), 3, dim=2, exclude=True).orderBy("qid", "rank").collect()
    assert [r.id for r in got] == [4, 2, 3, 1, 4, 2]
    assert V.topk(q.limit(0), vectors(spark), 3, dim=2).count() == 0


@pytest.mark.parametrize("block", [4096, 3])
def test_filtered_topk(spark, monkeypatch, block):
    """Against brute force, with a hot act, keyword lists, budgets and unusable vectors."""
    import random

    for name, value in (("BLOCK", block), ("PART", block), ("MANY", 1)):
        monkeypatch.setattr(V, name, value)
    rng = random.Random(4)
    vec = lambda: [rng.uniform(-1, 1), rng.uniform(-1, 1)]
    kw = lambda: [(rng.randrange(3), rng.randrange(3)) for _ in range(rng.randrange(3))]
    corpus = [(i, rng.choice([7, 7, 8, 9, None]), vec(), rng.choice([None, kw()])) for i in range(60)] + [(60, 7, None, None), (61, 7, [0.0, 0.0], None)]
    queries = [(q, vec(), rng.choice([[], [0, 1], [2]]), [0, 2], 1 + q % 4) for q in range(12)]
    allowed = [(q, a) for q in range(12) for a in (7, 8, 9, 77) if rng.random() < 0.6] + [(0, 7), (0, 7), (1, None), (99, 7)]
    c = spark.createDataFrame(corpus, "id long, act long, vector array<float>, keywords array<struct<conceptId: bigint, instanceOfType: bigint>>")
    q = spark.createDataFrame(queries, "qid long, vector array<float>, concepts array<bigint>, types array<bigint>, budget int")
    a = spark.createDataFrame(allowed, "qid long, act long")
    cos = lambda x, y: sum(i * j for i, j in zip(x, y)) / (sum(i * i for i in x) * sum(j * j for j in y)) ** 0.5
    for flag in (False, True):
        expected = {}
        for n, v, cs, ts, k in queries:
            fits = [
                (-round(cos(v, w), 9), i) for i, act, w, ks in corpus
                if (n, act) in allowed and w and any(w) and (not flag or not cs or any(x in cs and y in ts for x, y in ks or []))
            ]
            expected[n] = [i for _, i in sorted(fits)[:k]]
        got = {n: [] for n in expected}
        for r in V.filtered_topk(q, a, c, "budget", flag, dim=2).orderBy("qid", "rank").collect():
            got[r.qid].append(r.id)
        assert got == expected
    assert V.filtered_topk(q, a.limit(0), c, 3, dim=2).count() == 0


@pytest.mark.parametrize("part,parts", [(4096, 1), (2, 7), (5, 3)])
def test_near_ties_do_not_depend_on_blocks(spark, monkeypatch, part, parts):
    """Scores that differ by less than the rounding are ties, which go to the smaller id."""
    monkeypatch.setattr(V, "PART", part)
    rows = [(i, [1.0, 1e-6 * (9 - i), 1.0]) for i in range(10)] + [(i, [3.0 * i, 0.0, 3.0 * i]) for i in range(10, 20)]
    corpus = spark.createDataFrame(rows, "id long, vector array<double>").repartition(parts)
    q = spark.createDataFrame([(1, [1.0, 0.0, 1.0])], "qid long, vector array<double>")
    assert [r.id for r in V.topk(q, corpus, 12, dim=3).orderBy("rank").collect()] == list(range(12))


def test_records_of_large_numbers(spark):
    relations = spark.createDataFrame([(1, 2, n, "t", "l", "v", None) for n in (7, 5_000_000_000, 5, -5_000_000_000)], "conceptId long, instanceOfType long, nro long, title string, lawType string, validity string, units array<string>")
    got = K.keyword_records(spark.createDataFrame([(1, 2), (3, 4)], "conceptId long, instanceOfType long"), relations).orderBy("conceptId").collect()
    assert [[r.nro for r in row.relations] for row in got] == [[-5_000_000_000, 5, 7, 5_000_000_000], []]


def test_sample_by_brute_force(spark):
    import hashlib

    keys = [*range(900), 5, 5, None]
    df = spark.createDataFrame([(k, "x") for k in keys], "nro long, y string").repartition(3)
    order = sorted(keys, key=lambda k: (k is None, hashlib.md5(str(k).encode()).hexdigest()))
    for part in (1, 20, 400, 2000):
        assert sorted(map(str, (r.nro for r in E.sample(df, part=part).collect()))) == sorted(map(str, order[: max(1, len(keys) // part)]))
    assert E.sample(df.limit(0)).count() == 0


def test_small_sides_are_measured(spark):
    from statuta.session import small

    df = spark.createDataFrame([(1, "x" * 1000, ["y" * 500]), (2, None, None)], "a long, b string, c array<string>")
    plan = lambda d: spark.range(3).join(d, F.col("id") == F.col("a"))._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan(small(df)) and "broadcast" not in plan(small(df, 1500))
    assert small(df.limit(0)).count() == 0


def test_nested_filter(spark):
    df = spark.createDataFrame([([(1, 2), (3, 4)],), ([],), (None,)], "k array<struct<conceptId: bigint, instanceOfType: bigint>>")
    lists = [F.array(*[F.lit(x) for x in v]) for v in ((1, 9), (4, 2))]
    assert [r[0] for r in df.select(V.any_keyword(F.col("k"), *lists)).collect()] == [True, False, None]
    pairs = F.array(F.struct(F.lit(1).cast("long").alias("conceptId"), F.lit(4).cast("long").alias("instanceOfType")))
    assert [r[0] for r in df.select(V.any_keyword(F.col("k"), *lists, pairs=pairs)).collect()] == [False, False, None]


def test_evaluation(spark):
    rows = spark.createDataFrame([(["a", "b"], ["b", "c"]), (["d"], ["d", "e"]), ([], ["x"])], "g array<string>, h array<string>")
    r = rows.select(E.recall(F.col("g"), F.col("h")).alias("r"))
    assert [x.r for x in r.collect()] == [0.5, 1.0, None]
    assert r.agg(F.avg("r")).first()[0] == 0.75
    for n, size in ((0, 0), (19, 1), (40, 2)):
        assert E.sample(spark.range(n).withColumnRenamed("id", "nro")).count() == size


ACTS = "array<struct<nro: bigint, title: string, lawType: string, validity: string, relationData: array<struct<nro: bigint, id: string, name: string>>>>"
QUESTION = f"nro long, title string, relatedActs {ACTS}, keywords array<struct<label: string, conceptId: bigint, instanceOfType: bigint>>"


def test_question_cleaning(spark):
    act = lambda n, t, v, ids: (n, t, "u", v, None if ids is None else [(n, i, i) for i in ids])
    k = [("k", 1, 1)]
    rows = [
        (1, "q", [act(100, "Ustawa", "ACTUAL", ["art(1)ust(1)", "dz(1)", "rozp(1)"]), act(101, "Zmiana ustawy", "ACTUAL", []), act(102, "X", "OLD", []), act(103, "Y", "ACTUAL", [])], k),
        (2, "q", [act(100, "Ustawa", "ACTUAL", None)], None), (3, "q", [act(102, "X", "OLD", [])], k), (4, "q", [act(100, "Ustawa", "ACTUAL", None)], k), (5, "q", None, k),
    ]
    parsable = spark.createDataFrame([(100,), (101,), (102,), (102,)], "nro long")
    clean = Q.clean_questions(spark.createDataFrame(rows, QUESTION), parsable)
    got = {r.nro: [(a.nro, [c.id for c in a.relationData]) for a in r.relatedActs] for r in clean.collect()}
    assert got == {1: [(100, ["art(1)ust(1)"])], 4: [(100, [])]}
    assert {r.nro for r in E.eligible(clean).collect()} == {1}
    assert {r.nro for r in Q.frequent_only(clean, 2).collect()} == {1, 4} and Q.frequent_only(clean, 3).count() == 0


def test_current_rows(spark):
    rows = [(1, "a", "2024-01-01"), (1, "b", "2024-02-01"), (1, "b", "2024-02-01"), (None, "x", "2024-01-01"), (2, "c", None), (2, None, "2020-01-01"), (3, "y", "2024-01-01"), (3, "z", "2024-01-01")]
    df = spark.createDataFrame(rows, "k int, v string, t string").withColumn("fetched_at", F.col("t").cast("timestamp")).withColumn("__rank", F.lit(1)).drop("__rank")
    got = [(r.k, r.v) for r in current_rows(df, ["k"]).orderBy("k").collect()]
    assert got[:2] == [(1, "b"), (2, None)] and got[2][0] == 3 and len(got) == 3


def test_unit_repair(spark):
    nodes = spark.createDataFrame([(1, "art(4)"), (1, "art(5)")], "nro long, node_id string")
    units = lambda *ids: [(1, i, i, "s") for i in ids]
    rows = [(1, 1, 1, units("art(4)", "@ART(IV)", "art(9)")), (2, 1, 1, units("art(9)")), (3, 1, 1, None), (4, 1, 1, units("art(IV)-art(5)", "art(4)-art(8)"))]
    rel = spark.createDataFrame(rows, "conceptId long, instanceOfType long, nro long, units array<struct<nro: bigint, id: string, name: string, stateName: string>>")
    got = {r.conceptId: r.units for r in K.repair_relations(rel, nodes).collect()}
    assert got == {1: ["art(4)", "art(4)"], 3: None, 4: ["art(4)-art(5)"]}


def test_store(spark, tmp_path):
    store = S.Store(spark, S.local_root(str(tmp_path / "store")))
    assert store.names() == []
    store.create("t", "k int, v string")
    store.create("t", "other string")
    new = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "k int, v string")
    assert sorted(r.k for r in store.insert_only("t", new, ["k"], ["v"]).collect()) == [1, 2]
    assert store.insert_only("t", new, ["k"], ["v"]).count() == 0
    store.upsert("t", spark.createDataFrame([(2, "x"), (3, "y")], "k int, v string"), ["k"], ["v"])
    assert sorted((r.k, r.v) for r in store.read("t").collect()) == [(1, "a"), (2, "x"), (3, "y")]
    store.delete("t", spark.createDataFrame([(1,)], "k int"), ["k"])
    assert store.names() == ["t"] and store.counts().first().n == 2
    store.drop("t")
    assert not store.exists("t")
    twice = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    assert sorted(r.v for r in S.delete_one(twice, twice.where("k = 1"), ["k"], ["v"]).collect()) == ["b", "c"]
    assert S.same_keys(twice, twice, ["k"]).first().same and not S.same_keys(twice, twice.where("k = 1"), ["k"]).first().same


def test_json_files(spark, tmp_path):
    acts = tmp_path / "acts"
    acts.mkdir()
    body = {"nro": 1, "citeLink": "l/", "elements": {"z(1)": {"children": [], "parent": None, "text": "t", "keywords": None}, "a(1)": {"children": ["b"]}}, "extra": 1}
    (acts / "1.json").write_text(json.dumps(body))
    (acts / "index.txt").write_text("no")
    got = json_files.tree_acts(spark, str(acts)).select(F.map_keys("elements").alias("k"), "nro").first()
    assert got.k == ["z(1)", "a(1)"] and got.nro == 1
    keywords = tmp_path / "keywords"
    keywords.mkdir()
    (keywords / "12_(3).json").write_text(json.dumps({"1": {"nro": 1, "title": "t", "relationData": {}}, "2": {"nro": 2, "relationData": {"units": []}}}))
    (keywords / "13_(3).json").write_text("[]")
    got = {r.conceptId: r for r in json_files.keywords(spark, str(keywords)).collect()}
    assert [r.relationData.units for r in got[12].actRelations] == [None, []] and got[13].actRelations == []
    qs = tmp_path / "questions"
    qs.mkdir()
    (qs / "q.json").write_text(json.dumps({"last_update": "x", "questions": {"5": {"nro": 5, "title": "T", "keywords": [{"label": "l", "conceptId": 1, "instanceOfType": 2}]}}}))
    assert json_files.questions(spark, str(qs)).first().keywords[0].conceptId == 1
    leafs = tmp_path / "leafs"
    leafs.mkdir()
    (leafs / "1.json").write_text(json.dumps({"nro": 1, "reconstruct": {"a": {"cite_id": "a", "text": "t"}}, "elements": {"a": [{"act_nro": 1, "text": "t"}, {"act_nro": 1, "text": "u"}]}}))
    assert json_files.leaf_acts(spark, str(leafs)).count() == 1 and json_files.act_vectors(spark, str(leafs)).count() == 2
    assert schemas.struct_of("a BIGINT, b MAP<STRING, INT>") == "STRUCT<a: BIGINT, b: MAP<STRING, INT>>"


def test_pages(spark):
    pages.register(spark)
    got = spark.read.format("statuta_pages").option("total", 205).option("size", 100).load().orderBy("page").collect()
    assert [(r.page, r.start, r.size) for r in got] == [(0, 0, 100), (1, 100, 100), (2, 200, 5)]
    plan = pages.page_plan(spark.createDataFrame([("a", 51), ("b", 0), ("c", 25)], "key string, n int"), 25)
    assert sorted((r.key, r.size) for r in plan.collect()) == [("a", 1), ("a", 25), ("a", 25), ("c", 25)]
    html = spark.createDataFrame([(1, '<a class="act" href="/a-7">x</a><a href="/b-7" class="act">x</a><a class="no" href="/n-8">'), (2, '<a class="act" href="/c-7">')], "page int, html string")
    assert [tuple(r) for r in pages.links(html, "act", "skip").collect()] == [("7", "/c-7")]
    body = spark.range(1).select(pages.search_request(F.lit(0), F.lit(25), {"tax": 4})).first()[0]
    assert json.loads(body) == {"query": "", "domains": [{"label": "tax", "conceptId": 4}], "start": 0, "size": 25}


def test_markup(spark):
    q = spark.createDataFrame([(1, "", '<div class="qa_q">Czy<a href="#">art. 1</a> jest?</div>', '<div class="qa_a-cont"> Tak. </div>'), (2, "t", None, "x")], "nro long, title string, questionContent string, answerContent string")
    assert [tuple(r) for r in markup.parse_questions(q).collect()] == [(1, None, "Czy art. 1 jest?", "Tak.", None)]
    html = '<div id=\\"art(1)\\">A<p>x</p><div><div id=\\"art(1)ust(1)\\">B</div><div id=\\"note\\">n</div></div></div>'
    acts = spark.createDataFrame([(1, html, ["art(1)", "art(1) ust(1)"]), (2, html, None)], "nro long, html string, units array<string>")
    got = markup.parse_acts(acts).orderBy("pos").collect()
    assert [(r.node_id, r.children, r.parent, r.text) for r in got] == [("art(1)", ["art(1)ust(1)"], None, "A x n"), ("art(1)ust(1)", [], "art(1)", "B")]
    assert markup.parse_acts(acts, compat=True).where("pos = 0").first().children == ["art(1)ust(1)", "note"]
    texts = spark.createDataFrame([("a\u00a0b",), ("a    b",), ('\\"a\\"',)], "t string").select(markup.clean_text(F.col("t")).alias("t"))
    assert [r.t for r in texts.collect()] == ["ab", "a  b", "a"]


def test_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    store = S.Store(spark, S.local_root(str(tmp_path / "store")))
    rows = lambda *r: spark.createDataFrame(r, "id long, text string")
    rows((1, "ala ma kota"), (1, "ala ma kota"), (2, None)).write.parquet(source)
    run = lambda: embed_arrivals(spark, source, rows((1, "")).schema, store, "v", ["id"], "text", HashingEmbedder(16), str(tmp_path / "cp")).awaitTermination()
    run()
    assert store.read("v").count() == 1
    rows((1, "again"), (3, "pies")).write.mode("append").parquet(source)
    run()
    got = {r.id: r.embedding for r in store.read("v").collect()}
    assert set(got) == {1, 3} and abs(sum(x * x for x in got[3]) - 1) < 1e-5
    again = embed_rows(rows((1, "ala ma kota")), ["id"], "text", HashingEmbedder(16)).first().embedding
    assert again == got[1]
    events = spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:50:00", "a"), ("2024-01-01 01:10:00", "b")], "t string, kind string").withColumn("t", F.col("t").cast("timestamp"))
    assert sorted(r.n for r in arrivals_per_window(events, "t", "kind").collect()) == [1, 2]
