"""Landed files and responses: written from the tables into the shared folder, read back and parsed."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta import schemas as S
from statuta.functions.embed import HashingEmbedder, embed_rows, pending
from statuta.functions.ids import roman_first_bracket
from statuta.operators import store as ST
from statuta.operators.entities import keyword_relations
from statuta.operators.hierarchy import hierarchy
from statuta.operators.vector import filtered_topk
from statuta.plans import etl
from statuta.plans import retrieval as R
from statuta.queries import chunks as CQ
from statuta.queries import common as C
from statuta.queries import keywords as KQ
from statuta.queries import parsing as PQ
from statuta.queries import problems as P
from statuta.queries import questions as QQ
from statuta.queries import retrieval as RQ
from statuta.session import checkpoint_dir, cut
from statuta.sources import json_files, landed, markup, pages


def _folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"


def _json(*fields) -> Column:
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def json_questions(spark: SparkSession, d: str) -> DataFrame:
    """Question files, seven records of a last digit each, beside a file that is no JSON and is not read."""
    path = _folder(spark)
    record = F.struct("nro", "title", "question", "answer", "justification", "relatedActs", "keywords")
    grouped = C.questions(spark, d).groupBy((F.col("nro") % 7).alias("g")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("nro").cast("string"), record))).alias("questions"))
    files = grouped.select(F.concat(F.lit("questions_"), "g", F.lit(".json")).alias("file"), _json(F.lit("now").alias("last_update"), "questions").alias("body"))
    other = spark.range(1).select(F.lit("notes.txt").alias("file"), F.lit("no json").alias("body"))
    json_files.write_files(files.unionByName(other), path)
    read = json_files.questions(spark, path, raw=True)
    return read.select(
        "nro", "title", "question", "answer", F.col("relatedActs").isNull().alias("no_acts"), F.greatest(F.size("relatedActs"), F.lit(0)).cast("long").alias("n_acts"),
        F.array_join(F.transform("keywords", lambda k: k["conceptId"]), ",").alias("concepts"),
    )


def json_keywords(spark: SparkSession, d: str) -> DataFrame:
    """Keyword files named by concept and type: relations by act, ``[]`` for none."""
    path = _folder(spark)
    known = F.filter("actRelations", lambda r: r["nro"].isNotNull())
    # Of repeated acts in one list only the first is in the file.
    firsts = F.filter(known, lambda r, i: F.array_position(F.transform(known, lambda x: x["nro"]), r["nro"]) == i + 1)
    unique = F.map_from_entries(F.transform(firsts, lambda r: F.struct(r["nro"].cast("string"), r)))
    rows = C.keywords(spark, d).select(
        F.format_string("%d_(%d).json", "conceptId", "instanceOfType").alias("file"),
        F.when(F.size(firsts) > 0, F.to_json(unique, {"ignoreNullFields": "false"})).otherwise("[]").alias("body"),
    )
    json_files.write_files(rows, path)
    read = json_files.keywords(spark, path)
    return read.select("conceptId", "instanceOfType", F.array_join(F.array_sort(F.transform("actRelations", lambda r: r["nro"])), ",").alias("acts"))


def json_tree_acts(spark: SparkSession, d: str) -> DataFrame:
    """Act files, whose elements keep their order."""
    path = _folder(spark)
    columns = ["nro", "id", "citeLink", "actLawType", "title", "shortQuote", "elements", "keywords"]
    json_files.write_files(C.acts(spark, d).select(F.format_string("act_%d.json", "nro").alias("file"), _json(*columns).alias("body")), path)
    read = json_files.tree_acts(spark, path)
    return read.select(
        "nro", "title", F.array_join(F.coalesce(F.map_keys("elements"), F.array().cast("array<string>")), ";").alias("ids"),
        F.array_join(F.transform(F.coalesce(F.map_values("elements"), F.array().cast(f"array<{S.ELEMENT}>")), lambda e: F.coalesce(e["parent"], F.lit("-"))), ";").alias("parents"),
    )


def json_leaf_acts(spark: SparkSession, d: str) -> DataFrame:
    """Leaf act files with their parts by key."""
    path = _folder(spark)
    parts = CQ.leaf_reconstruct(spark, d).where("key IS NOT NULL").groupBy("nro", "key").agg(F.min_by(F.struct("cite_id", "text"), "pos").alias("r"))
    listed = parts.groupBy("nro").agg(F.map_from_entries(F.collect_list(F.struct("key", "r"))).alias("reconstruct"))
    rows = C.acts(spark, d).select("nro", "title", "actLawType", "citeLink").join(listed, "nro")
    json_files.write_files(rows.select(F.format_string("%d.json", "nro").alias("file"), _json("nro", "title", "actLawType", "citeLink", "reconstruct").alias("body")), path)
    return json_files.leaf_acts(spark, path).select("nro", "title", "actLawType", "citeLink", F.explode("reconstruct").alias("key", "r")).select(
        "nro", "title", "actLawType", "citeLink", "key", "r.cite_id"
    )


def json_act_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vector rows in files of an act, listed by their parent."""
    path = _folder(spark)
    columns = ["act_nro", "parent_id", "reconstruct_id", "text", "parent_tokens", "text_tokens", "chunk_id", "total_chunks", "keywords", "node_ids"]
    rows = C.chunk_rows(spark, d).groupBy("act_nro", F.coalesce("parent_id", F.lit("")).alias("p")).agg(F.collect_list(F.struct(*columns)).alias("l"))
    acts = rows.groupBy("act_nro").agg(F.map_from_entries(F.collect_list(F.struct("p", "l"))).alias("elements"))
    json_files.write_files(acts.select(F.format_string("%d.json", "act_nro").alias("file"), _json("elements").alias("body")), path)
    read = json_files.act_vectors(spark, path)
    return read.select("act_nro", "reconstruct_id", "text", F.col("chunk_id").cast("long").alias("chunk_id"), F.array_join("node_ids", ",").alias("node_ids"))


def landed_questions(spark: SparkSession, d: str) -> DataFrame:
    """Questions completed from three landed responses each; those of every ninth number lack the one on acts."""
    q = C.questions(spark, d)
    div = lambda css, c: F.concat(F.lit(f'<div class="{css}"><p>'), PQ._escaped(F.col(c)), F.lit("</p></div>"))
    contents = q.select("nro", "title", div("qa_q", "question").alias("questionContent"), F.concat(div("qa_a-cont", "answer"), div("qa_a-just", "justification")).alias("answerContent"))
    documents = F.transform("relatedActs", lambda a: F.struct(a["nro"].alias("nro"), a["title"].alias("title"), a["lawType"].alias("lawType"), a["validity"].alias("validity"), a["relationData"].alias("units")))
    acts = q.where("nro % 9 != 0").select("nro", documents.alias("documentList"))
    found = landed.complete_questions(contents, acts, q.select("nro", "keywords"))
    cites = F.transform("relatedActs", lambda a: F.concat_ws(":", a["nro"], F.array_join(F.transform(a["relationData"], lambda c: c["id"]), ",")))
    return found.select("nro", "title", "answer", F.array_join(cites, ";").alias("acts"), F.array_join(F.transform("keywords", lambda k: k["conceptId"]), ",").alias("concepts"))


def landed_acts(spark: SparkSession, d: str) -> DataFrame:
    """Acts from JSON responses: those without a list of units cannot be parsed, links come from the pages."""
    listed = F.transform(F.map_keys("elements"), lambda i: F.struct(i.alias("unitId"), i.alias("unitName")))
    body = _json("nro", "id", "citeLink", "actLawType", "title", "shortQuote", listed.alias("units"), "keywords")
    responses = landed.parse_responses(C.acts(spark, d).select(body.alias("body")), "body", landed.ACT_RESPONSE)
    links = PQ.link_dedupe(spark, d)
    return landed.landed_acts(responses, links).select("nro", "id", "citeLink", "title", F.size("keywords").cast("long").alias("n_keywords"))


def keyword_documents(spark: SparkSession, d: str) -> DataFrame:
    """Pages of a search on keywords, flattened to the fields of their entries."""
    documents = F.transform("actRelations", lambda r: F.struct(r["nro"].alias("nro"), r["title"].alias("title"), r["lawType"].alias("lawType"), r["validity"].alias("validity")))
    responses = C.keywords(spark, d).select(F.concat_ws("_", "conceptId", "instanceOfType").alias("key"), F.lit(0).alias("page"), documents.alias("documentList"))
    return pages.keyword_documents(responses).select("key", F.col("pos").cast("long").alias("pos"), "nro", "title", "validity")


def page_responses(spark: SparkSession, d: str) -> DataFrame:
    """Landed responses of pages of fifty questions through the data source, flattened to numbers; the last page is missing."""
    path = _folder(spark)
    numbered = ST.batches(C.questions(spark, d).select("nro"), ["nro"], 50)
    body = _json(F.array_sort(F.collect_list(F.struct("nro"))).alias("questions"))
    found = numbered.groupBy(F.col("batch").alias("page")).agg(body.alias("body"))
    last = found.agg(F.max("page")).first()[0]
    json_files.write_files(found.where(F.col("page") < last).select(F.format_string("page_%d.json", "page").alias("file"), "body"), path)
    pages.register(spark)
    read = spark.read.format("statuta_pages").option("total", numbered.count()).option("size", 50).option("path", path).load()
    listed = F.from_json("body", "STRUCT<questions: ARRAY<STRUCT<nro: BIGINT>>>")["questions"]["nro"]
    return read.select(F.col("page").cast("long").alias("page"), "start", "size", F.explode_outer(listed).alias("nro"))


def request_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Bodies of requests as text: one for every question, one for every page of a keyword."""
    asked = C.questions(spark, d).select(F.col("nro").cast("string").alias("key"), landed.request_body({"lang": "pl", "nro": "0"}, nro=F.col("nro")).alias("body"))
    plan = PQ.page_plan(spark, d).select(F.concat_ws("#", "key", "page").alias("key"), pages.search_request(F.col("start"), F.col("size"), {"taxes": 5}, F.col("key")).alias("body"))
    return asked.unionByName(plan)


def html_nested_units(spark: SparkSession, d: str) -> DataFrame:
    """Elements as divs nested as deep as their trees are, parsed back to parents and children."""
    nodes = C.nodes(spark, d)
    sound = hierarchy(nodes).where("NOT broken").select("nro", "node_id", "depth", "path")
    step = sound.select("nro", "node_id", "depth", F.posexplode("path").alias("level", "at"))
    places = nodes.select("nro", F.col("node_id").alias("at"), "pos")
    keys = step.join(places, ["nro", "at"]).groupBy("nro", "node_id", "depth").agg(F.array_sort(F.collect_list(F.struct("level", "pos"))).alias("k"))
    rows = keys.select("nro", "node_id", "depth", F.transform("k", lambda x: x["pos"]).alias("k")).join(nodes.select("nro", "node_id", "text"), ["nro", "node_id"])
    div = F.concat(F.lit('<div id=\\"'), F.col("node_id"), F.lit('\\"><span>'), PQ._escaped(F.col("text")), F.lit("</span>"))
    acts = rows.groupBy("nro").agg(F.array_sort(F.collect_list(F.struct("k", "depth", div.alias("h"), "node_id"))).alias("l"))
    before = lambda i: F.when(i > 0, F.try_element_at("l", i)["depth"]).otherwise(F.lit(-1).cast("long"))
    piece = F.transform("l", lambda x, i: F.concat(F.repeat(F.lit("</div>"), (before(i) - x["depth"] + 1).cast("int")), x["h"]))
    html = F.concat(F.array_join(piece, ""), F.repeat(F.lit("</div>"), (F.element_at("l", -1)["depth"] + 1).cast("int")))
    made = acts.select("nro", html.alias("html"), F.transform("l", lambda x: x["node_id"]).alias("units"))
    return markup.parse_acts(made).select("nro", "node_id", "parent", F.size("children").cast("long").alias("n_children"), "text")


def roman_roots(spark: SparkSession, d: str) -> DataFrame:
    """Element ids with the first digit in brackets as a Roman numeral."""
    return C.nodes(spark, d).select("node_id").distinct().select("node_id", roman_first_bracket(F.col("node_id")).alias("roman"))


def point_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Stable numbers of the points of all chunks, counted in the order of their keys."""
    rows = C.chunk_rows(spark, d).select("act_nro", "reconstruct_id")
    return ST.batches(rows, ["act_nro", "reconstruct_id"], 1).select("act_nro", "reconstruct_id", (F.col("batch") + 1).alias("point"))


def embed_pending(spark: SparkSession, d: str) -> DataFrame:
    """Questions embedded so far and those of a second run, which embeds only what is missing: vectors by number."""
    q = C.questions(spark, d).select("nro", "title")
    embedder = HashingEmbedder(16)
    done = embed_rows(q.where("nro % 3 = 0"), ["nro"], "title", embedder)
    fresh = embed_rows(pending(q, done, ["nro"]), ["nro"], "title", embedder)
    both = done.withColumn("run", F.lit(1)).unionByName(fresh.withColumn("run", F.lit(2)))
    norm = F.aggregate("embedding", F.lit(0.0), lambda n, x: n + x.cast("double") * x.cast("double"))
    return both.select("nro", F.col("run").cast("long").alias("run"), F.size("embedding").cast("long").alias("dim"), F.round(norm, 3).alias("norm"))


def pipeline_checks(spark: SparkSession, d: str) -> DataFrame:
    """The whole pipeline in two deliveries, its checks after loading, and whether a third run adds a row."""
    store = ST.Store(spark, _folder(spark))
    q, acts, keywords = C.questions(spark, d), C.acts(spark, d), C.keywords(spark, d)
    run = lambda rows: etl.run(store, rows, acts, C.nodes(spark, d), keywords, keyword_relations(keywords), HashingEmbedder(8))
    run(q.where("nro % 2 = 0"))
    run(q)
    before = {r["name"]: r["n"] for r in store.counts().collect()}
    # Read before a table is dropped.
    checks = cut(run(q).select("check", "ok", F.col("n_bad").cast("long").alias("n")))
    after = {r["name"]: r["n"] for r in store.counts().collect()}
    store.drop("question_vectors")
    rows = [("nothing new", before == after, 0), ("dropped", store.exists("question_vectors") is False, 0), ("questions", True, after["questions"])]
    return checks.unionByName(spark.createDataFrame([(c, o, int(n)) for c, o, n in rows], "check string, ok boolean, n long"))


def acts_retrieve(spark: SparkSession, d: str) -> DataFrame:
    """Parts of acts as a response: every question of the query set is a request for its related acts.

    The pairs of (act, query) of a request share a budget of 100 chunks; the parts that hits name come in document
    order, and the response is written as JSON, with its parts and words counted.
    """
    q = C.query_vectors(spark, d)
    asked = q.select("qid", F.col("own").alias("nro")).join(C.questions(spark, d).select("nro", "relatedActs"), "nro")
    pairs = asked.select("qid", F.explode("relatedActs.nro").alias("act")).where("act IS NOT NULL").distinct()
    budget = pairs.groupBy("qid").agg(F.greatest(F.lit(1), F.floor(F.lit(100) / F.count(F.lit(1)))).cast("int").alias("k"))
    # Every pair is a query of its own, with the act in its key.
    key = F.struct("qid", "act").alias("pair")
    one = pairs.join(budget, "qid").join(q.select("qid", "vector"), "qid").select(F.to_json(key).alias("qid"), F.col("act").alias("own_act"), "k", "vector")
    chunks = C.chunks(spark, d)
    hits = filtered_topk(one.select("qid", "k", "vector"), one.select("qid", F.col("own_act").alias("act")), chunks, "k")
    named = hits.join(chunks.select("id", "act", "parent_id", "reconstruct_id"), "id").withColumn("qid", F.get_json_object("qid", "$.qid").cast("long"))
    parts = R.reconstruct(named, RQ._stored(spark, d), C.acts(spark, d))
    acts = parts.groupBy("qid", "nro", "title").agg(F.array_sort(F.collect_list(F.struct("pos", "cite_id", "text"))).alias("p"))
    body = F.struct("nro", "title", F.transform("p", lambda x: F.struct(x["cite_id"].alias("link"), F.coalesce(x["text"], F.lit("")).alias("text"))).alias("parts"))
    whole = acts.groupBy("qid").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("nro", body.alias("b")))), lambda x: x["b"])).alias("response"))
    parsed = F.from_json("response", "ARRAY<STRUCT<nro: BIGINT, title: STRING, parts: ARRAY<STRUCT<link: STRING, text: STRING>>>>")
    texts = F.flatten(F.transform(parsed, lambda a: F.transform(a["parts"], lambda x: x["text"])))
    return whole.select(
        "qid", F.array_join(F.transform(parsed, lambda a: a["nro"]), ",").alias("acts"), F.size(texts).cast("long").alias("n_parts"),
        F.aggregate(texts, F.lit(0).cast("long"), lambda n, t: n + F.size(F.filter(F.split(t, " "), lambda w: w != ""))).alias("n_words"),
        F.md5(F.array_join(texts, "|")).alias("texts"),
    )


_CONCEPTS = "coalesce(array_to_string(list_transform(q.keywords, lambda k: k.conceptId), ','), '')"
_STRIPPED = PQ._STRIP.format("coalesce(n.e.text, '')")

QUERIES = {
    "json_questions": (
        json_questions,
        f"""WITH {C.CUR} SELECT nro, title, question, answer, relatedActs IS NULL AS no_acts, coalesce(len(relatedActs), 0) AS n_acts,
CASE WHEN keywords IS NOT NULL THEN array_to_string(list_transform(keywords, lambda k: k.conceptId), ',') END AS concepts FROM cur_q""",
    ),
    "json_keywords": (
        json_keywords,
        f"""WITH {C.CUR} SELECT conceptId, instanceOfType, coalesce(array_to_string(list_sort(list_distinct(list_filter(list_transform(actRelations, lambda r: r.nro), lambda n: n IS NOT NULL))), ','), '') AS acts FROM cur_k""",
    ),
    "json_tree_acts": (
        json_tree_acts,
        f"""WITH {C.CUR}, l AS (SELECT nro, string_agg(node_id, ';' ORDER BY pos) AS ids, string_agg(coalesce(e.parent, '-'), ';' ORDER BY pos) AS parents FROM node GROUP BY nro)
SELECT a.nro, a.title, coalesce(l.ids, '') AS ids, coalesce(l.parents, '') AS parents FROM cur_a a LEFT JOIN l ON l.nro = a.nro""",
    ),
    "json_leaf_acts": (
        json_leaf_acts,
        f"""SELECT p.nro, a.title, a.actLawType, a.citeLink, p.key, arg_min(p.cite_id, p.pos) AS cite_id
FROM ({CQ.QUERIES["leaf_reconstruct"][1]}) p JOIN (WITH {C.CUR} SELECT nro, title, actLawType, citeLink FROM cur_a) a ON a.nro = p.nro WHERE p.key IS NOT NULL GROUP BY ALL""",
    ),
    "json_act_vectors": (
        json_act_vectors,
        f"""WITH {C.CUR} SELECT act_nro, reconstruct_id, text, CAST(chunk_id AS BIGINT) AS chunk_id,
CASE WHEN node_ids IS NOT NULL THEN array_to_string(node_ids, ',') END AS node_ids FROM cur_v""",
    ),
    "landed_questions": (
        landed_questions,
        f"""WITH {C.CUR},
cited AS (SELECT qnro, string_agg(concat_ws(':', a.nro, array_to_string(list_transform(a.relationData, lambda c: c.id), ',')), ';' ORDER BY apos) AS acts FROM rel GROUP BY qnro)
SELECT q.nro, nullif(q.title, '') AS title, {PQ._PART.format("q.answer")} AS answer, CASE WHEN q.nro % 9 <> 0 AND len(q.relatedActs) > 0 THEN c.acts END AS acts,
CASE WHEN len(q.keywords) > 0 THEN {_CONCEPTS} END AS concepts FROM cur_q q LEFT JOIN cited c ON c.qnro = q.nro""",
    ),
    "landed_acts": (
        landed_acts,
        f"""SELECT a.nro, a.id, coalesce(l.link, a.citeLink) AS citeLink, replace(replace(replace(a.title, '\\"', ''), '  ', ' '), chr(160), '') AS title,
coalesce(len(a.keywords), 0) AS n_keywords
FROM (WITH {C.CUR} SELECT * FROM cur_a WHERE elements IS NOT NULL) a LEFT JOIN ({PQ.QUERIES["link_dedupe"][1]}) l ON l.key = CAST(a.nro AS VARCHAR)""",
    ),
    "keyword_documents": (
        keyword_documents,
        f"""WITH {C.CUR} SELECT key, pos, r.nro AS nro, r.title AS title, r.validity AS validity FROM (
SELECT concat_ws('_', conceptId, instanceOfType) AS key, unnest(actRelations) AS r, unnest(range(CAST(len(actRelations) AS BIGINT))) AS pos FROM cur_k)""",
    ),
    "page_responses": (
        page_responses,
        f"""WITH {C.CUR}, r AS (SELECT nro, (row_number() OVER (ORDER BY nro) - 1) // 50 AS page, count(*) OVER () AS n FROM cur_q)
SELECT page, page * 50 AS start, least(50, n - page * 50) AS size, nro FROM r WHERE page < (n - 1) // 50
UNION ALL SELECT (n - 1) // 50, (n - 1) // 50 * 50, n - (n - 1) // 50 * 50, NULL FROM (SELECT count(*) AS n FROM cur_q)""",
    ),
    "request_bodies": (
        request_bodies,
        f"""SELECT key, body FROM (WITH {C.CUR} SELECT CAST(nro AS VARCHAR) AS key, '{{"lang":"pl","nro":' || nro || '}}' AS body FROM cur_q)
UNION ALL SELECT concat_ws('#', key, page), '{{"query":"' || key || '","domains":[{{"label":"taxes","conceptId":5}}],"start":' || start || ',"size":' || size || '}}'
FROM ({PQ.QUERIES["page_plan"][1]})""",
    ),
    "html_nested_units": (
        html_nested_units,
        f"""WITH RECURSIVE {P.TREE_SQL},
kids AS (SELECT nro, p, count(*) AS n FROM sound WHERE p IS NOT NULL GROUP BY nro, p)
SELECT t.nro, t.node_id, CASE WHEN len(t.path) > 1 THEN t.path[len(t.path) - 1] END AS parent, coalesce(k.n, 0) AS n_children,
       replace(replace({_STRIPPED}, '  ', ' '), chr(160), '') AS text
FROM tree t JOIN act_nodes n ON n.nro = t.nro AND n.node_id = t.node_id LEFT JOIN kids k ON k.nro = t.nro AND k.p = t.node_id""",
    ),
    "roman_roots": (
        roman_roots,
        rf"""WITH {C.CUR}, i AS (SELECT DISTINCT node_id FROM node)
SELECT node_id, CASE WHEN regexp_matches(node_id, '^[^(]*\([1-9]') THEN regexp_extract(node_id, '^([^(]*\()', 1)
  || ['I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][CAST(regexp_extract(node_id, '^[^(]*\(([1-9])', 1) AS INT)]
  || regexp_replace(node_id, '^[^(]*\([1-9]', '') ELSE node_id END AS roman FROM i""",
    ),
    "point_numbers": (point_numbers, f"WITH {C.CUR} SELECT act_nro, reconstruct_id, row_number() OVER (ORDER BY act_nro, reconstruct_id) AS point FROM cur_v"),
    "embed_pending": (
        embed_pending,
        f"""WITH {C.CUR} SELECT nro, CASE WHEN nro % 3 = 0 THEN 1 ELSE 2 END AS run, CAST(16 AS BIGINT) AS dim,
CASE WHEN len(trim(title)) > 0 THEN 1.0 ELSE 0.0 END AS norm FROM cur_q WHERE title IS NOT NULL""",
    ),
    "pipeline_checks": (
        pipeline_checks,
        f"""SELECT unnest(['question keys', 'leaf act keys', 'vector keys', 'vector without leaf act', 'vector without embedding', 'question without embedding', 'nothing new', 'dropped']) AS check,
true AS ok, CAST(0 AS BIGINT) AS n
UNION ALL SELECT 'questions', true, count(*) FROM ({QQ.QUERIES["question_act_filter"][1]})""",
    ),
    "acts_retrieve": (
        acts_retrieve,
        f"""WITH {RQ._OWN},
pair AS (SELECT qid, act, count(*) OVER (PARTITION BY qid) AS n FROM allowed WHERE act IS NOT NULL),
hits AS (SELECT s.qid, c.act, c.parent_id, c.reconstruct_id FROM (
  SELECT q.qid, c.id, p.n, row_number() OVER (PARTITION BY q.qid, p.act ORDER BY round(list_cosine_similarity(q.v, c.v), 9) DESC, c.id) AS r
  FROM pair p JOIN query q USING (qid) JOIN chunk c ON c.act = p.act) s JOIN chunk c USING (id) WHERE s.r <= greatest(1, 100 // s.n)),
wanted AS (SELECT DISTINCT qid, act AS nro, unnest([parent_id, reconstruct_id]) AS key FROM hits),
part AS (SELECT w.qid, n.nro, n.pos, coalesce(n.e.text, '') AS text FROM wanted w JOIN node n ON n.nro = w.nro AND n.node_id = w.key JOIN cur_a a ON a.nro = w.nro)
SELECT qid, (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT nro AS x FROM part i WHERE i.qid = o.qid)) AS acts, count(*) AS n_parts,
CAST(sum(len(list_filter(string_split(text, ' '), lambda w: w <> ''))) AS BIGINT) AS n_words, md5(string_agg(text, '|' ORDER BY nro, pos)) AS texts FROM part o GROUP BY qid""",
    ),
}
