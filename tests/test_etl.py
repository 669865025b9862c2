"""The pipeline over landed responses and stored tables."""

import json

from pyspark.sql import functions as F

from statuta.functions.embed import HashingEmbedder
from statuta.operators import store as S
from statuta.operators.entities import act_nodes, current_acts, current_keywords, current_questions, keyword_relations
from statuta.operators.trees import leaf_roots
from statuta.plans import etl
from statuta.session import table
from statuta.sources import landed


def test_landed_questions(spark):
    q = spark.createDataFrame([(1, "T", '<div class="qa_q">Q?</div>', '<div class="qa_a-cont">A.</div>'), (2, "U", None, "x"), (3, "", '<div class="qa_q">R?</div>', None)], "nro long, title string, questionContent string, answerContent string")
    acts = spark.createDataFrame([(1, [(9, "t", "u", "ACTUAL", [(9, "art(1)", "art. 1")]), (8, "t", "u", "OLD", [])]), (3, [])], f"nro long, documentList {landed.DOCUMENTS}")
    keywords = spark.createDataFrame([(1, [("l", 1, 2)])], "nro long, keywords array<struct<label: string, conceptId: bigint, instanceOfType: bigint>>")
    got = {r.nro: r for r in landed.complete_questions(q, acts, keywords).collect()}
    assert set(got) == {1, 3}
    assert [(a.nro, a.relationData and a.relationData[0].id) for a in got[1].relatedActs] == [(9, "art(1)"), (8, None)]
    assert got[1].keywords[0].conceptId == 1 and got[3].relatedActs is None and got[3].keywords is None and got[3].title is None


def test_landed_acts(spark):
    html = '<div id=\\"art(1)\\">A <div id=\\"art(1)ust(1)\\">B</div></div>'
    bodies = [{"nro": 1, "title": "x  y", "html": html, "units": [{"unitId": "art(1)", "unitName": "n"}, {"unitId": "art(1) ust(1)"}]}, {"nro": 2, "title": "none"}]
    files = spark.createDataFrame([(json.dumps(b),) for b in bodies], "body string")
    responses = landed.parse_responses(files, "body", landed.ACT_RESPONSE)
    links = spark.createDataFrame([("1", "/akt-1")], "key string, link string")
    acts = landed.landed_acts(responses, links).collect()
    assert [(a.nro, a.title, a.citeLink, a.keywords, a.actLawType) for a in acts] == [(1, "x y", "/akt-1", [], None)]
    elements = landed.elements_map(landed.landed_nodes(responses)).select(F.map_keys("elements").alias("k"), "elements").first()
    assert elements.k == ["art(1)", "art(1)ust(1)"] and elements.elements["art(1)ust(1)"].parent == "art(1)"
    body = spark.range(1).select(landed.request_body({"a": "b", "nro": "0"}, nro=F.lit(7))).first()[0]
    assert json.loads(body) == {"a": "b", "nro": 7}


def test_roman_roots(spark):
    rows = [(1, 0, "art(V)", ["art(5)ust(1)"]), (1, 1, "art(5)ust(1)", []), (1, 2, "art(6)ust(1)", [])]
    nodes = spark.createDataFrame(rows, "nro long, pos long, node_id string, children array<string>")
    assert [(r.root, r.pos) for r in leaf_roots(nodes).collect()] == [("art(V)", 1)]


def test_pipeline_is_incremental(spark, small, tmp_path):
    store = S.Store(spark, S.local_root(str(tmp_path / "store")))
    questions, acts = current_questions(table(spark, small, "raw_questions")), current_acts(table(spark, small, "tree_acts"))
    keywords = current_keywords(table(spark, small, "keywords"))
    relations = keyword_relations(keywords)
    run = lambda q: etl.run(store, q, acts, act_nodes(acts), keywords, relations, HashingEmbedder(8)).collect()
    first = run(questions.where("nro % 2 = 0"))
    assert first and all(r.ok for r in first)
    before = {r.name: r.n for r in store.counts().collect()}
    assert all(r.ok for r in run(questions))
    after = {r.name: r.n for r in store.counts().collect()}
    assert after["questions"] > before["questions"] and after["vector_acts"] >= before["vector_acts"] and after["act_vectors"] == after["vector_acts"]
    run(questions)
    assert {r.name: r.n for r in store.counts().collect()} == after
