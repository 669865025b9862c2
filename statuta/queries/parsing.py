"""Parsing of markup and paged responses, on markup made from the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.queries import common as C
from statuta.sources import markup, pages


def _escaped(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def html_question_parts(spark: SparkSession, d: str) -> DataFrame:
    """Questions wrapped in markup and parsed again."""
    part = lambda css, c: F.concat(F.lit(f'<div class="{css}"><p>'), _escaped(F.col(c)), F.lit("</p></div>"))
    q = C.questions(spark, d).select(
        "nro", "title", part("qa_q", "question").alias("questionContent"),
        F.concat(part("qa_a-cont", "answer"), part("qa_a-just", "justification")).alias("answerContent"),
    )
    return markup.parse_questions(q)


def html_act_units(spark: SparkSession, d: str) -> DataFrame:
    """Elements as divs inside one unit, parsed to nodes with parents and clean texts."""
    div = F.concat(F.lit('<div id=\\"'), F.col("node_id"), F.lit('\\"><span>'), _escaped(F.col("text")), F.lit("</span></div>"))
    rows = C.nodes(spark, d).groupBy("nro").agg(F.array_sort(F.collect_list(F.struct("pos", div.alias("h"), "node_id"))).alias("l"))
    acts = rows.select(
        "nro", F.concat(F.lit('<div id=\\"akt\\">'), F.array_join(F.transform("l", lambda x: x["h"]), ""), F.lit("</div>")).alias("html"),
        F.concat(F.array(F.lit("akt")), F.transform("l", lambda x: x["node_id"])).alias("units"),
    )
    return markup.parse_acts(acts).select("nro", "pos", "node_id", "parent", F.size("children").cast("long").alias("n_children"), "text")


def link_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Links to acts on question pages: first of a page, last of the pages; links with 'zmiana' skipped."""
    anchor = F.transform("relatedActs", lambda a: F.concat(
        F.lit('<a class="act" href="/'), F.lower(F.regexp_replace(F.coalesce(a["title"], F.lit("akt")), "[^a-zA-Z]+", "-")), F.lit("-"), a["nro"].cast("string"), F.lit('">x</a>')
    ))
    made = C.questions(spark, d).where("relatedActs IS NOT NULL").select(F.col("nro").alias("page"), F.array_join(anchor, "\n").alias("html"))
    return pages.links(made, "act", "zmiana")


def page_plan(spark: SparkSession, d: str) -> DataFrame:
    """Pages of 25 for the relations of each keyword."""
    hits = C.keywords(spark, d).select(F.concat_ws("_", "conceptId", "instanceOfType").alias("key"), F.greatest(F.size("actRelations"), F.lit(0)).alias("n"))
    return pages.page_plan(hits, 25).withColumn("page", F.col("page").cast("long"))


def pages_last_wins(spark: SparkSession, d: str) -> DataFrame:
    """Relations of keywords as pages of two entries, flattened to one row per act: the last wins."""
    from statuta.operators.entities import keyword_relations

    rows = keyword_relations(C.keywords(spark, d)).where("nro IS NOT NULL").select(
        F.concat_ws("_", "conceptId", "instanceOfType", "nro").alias("key"), F.floor(F.col("rpos") / 2).alias("page"), (F.col("rpos") % 2).alias("pos"), "title"
    )
    out = pages.last_page_wins(rows, "key")
    return out.select("key", "title", (F.col("place.page") * 2 + F.col("place.pos")).alias("place"))


_STRIP = r"regexp_replace({}, '^[\s\x{{00a0}}\x{{1c}}-\x{{1f}}\x{{85}}\x{{2000}}-\x{{200a}}\x{{202f}}\x{{205f}}\x{{3000}}]+|[\s\x{{00a0}}\x{{1c}}-\x{{1f}}\x{{85}}\x{{2000}}-\x{{200a}}\x{{202f}}\x{{205f}}\x{{3000}}]+$', '', 'g')"
_PART = "nullif(" + _STRIP + ", '')"

QUERIES = {
    "html_question_parts": (
        html_question_parts,
        f"""WITH {C.CUR} SELECT nro, nullif(title, '') AS title, {_PART.format('question')} AS question, {_PART.format('answer')} AS answer,
{_PART.format('justification')} AS justification FROM cur_q""",
    ),
    "html_act_units": (
        html_act_units,
        f"""WITH {C.CUR}
SELECT nro, pos + 1 AS pos, node_id, 'akt' AS parent, CAST(0 AS BIGINT) AS n_children,
       replace(replace({_STRIP.format("coalesce(e.text, '')")}, '  ', ' '), chr(160), '') AS text FROM node
UNION ALL SELECT nro, 0, 'akt', NULL, count(*), '' FROM node GROUP BY nro""",
    ),
    "link_dedupe": (
        link_dedupe,
        f"""WITH {C.CUR},
l AS (SELECT qnro, apos, CAST(a.nro AS VARCHAR) AS key, '/' || lower(regexp_replace(coalesce(a.title, 'akt'), '[^a-zA-Z]+', '-', 'g')) || '-' || a.nro AS link FROM rel WHERE a.nro IS NOT NULL),
f AS (SELECT key, qnro, arg_min(link, apos) AS link FROM l WHERE NOT contains(link, 'zmiana') GROUP BY key, qnro)
SELECT key, arg_max(link, qnro) AS link FROM f GROUP BY key""",
    ),
    "page_plan": (
        page_plan,
        f"""WITH {C.CUR}, h AS (SELECT concat_ws('_', conceptId, instanceOfType) AS key, len(actRelations) AS n FROM cur_k),
p AS (SELECT key, n, unnest(range(0, (n + 24) // 25)) AS page FROM h WHERE n > 0)
SELECT key, page, page * 25 AS start, least(25, n - page * 25) AS size FROM p""",
    ),
    "pages_last_wins": (
        pages_last_wins,
        f"""WITH {C.CUR},
r AS (SELECT concat_ws('_', conceptId, instanceOfType, r.nro) AS key, r.title AS title, p FROM (
  SELECT conceptId, instanceOfType, unnest(actRelations) AS r, unnest(range(CAST(len(actRelations) AS BIGINT))) AS p FROM cur_k) WHERE r.nro IS NOT NULL)
SELECT key, arg_max(title, p) AS title, min(p) AS place FROM r GROUP BY key""",
    ),
}
