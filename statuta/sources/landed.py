"""Landed service responses to records: questions completed by acts and keywords, acts with defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta import schemas as S
from statuta.sources.markup import clean_text, parse_acts, parse_question_acts, parse_question_keywords, parse_questions

ACT_RESPONSE = (
    "nro BIGINT, id STRING, citeLink STRING, actLawType STRING, title STRING, shortQuote STRING, html STRING, "
    "units ARRAY<STRUCT<unitId: STRING, unitName: STRING>>, keywords ARRAY<" + S.KW + ">"
)
DOCUMENTS = f"ARRAY<STRUCT<nro: BIGINT, title: STRING, lawType: STRING, validity: STRING, units: ARRAY<{S.CITATION}>>>"


def parse_responses(files: DataFrame, body: str, schema: str) -> DataFrame:
    """Columns of JSON bodies of a declared schema; fields that a body lacks are null."""
    return files.select(F.from_json(body, S.struct_of(schema)).alias("r")).where("r IS NOT NULL").select("r.*")


def complete_questions(questions: DataFrame, acts: DataFrame, keywords: DataFrame) -> DataFrame:
    """Raw questions from three landed responses by question number.

    ``questions(nro, title, questionContent, answerContent)``, ``acts(nro, documentList)``,
    ``keywords(nro, keywords)``. A question whose other responses are missing has null acts and no
    keywords; one without content is dropped. A number answered twice counts once.
    """
    parsed = parse_questions(questions.dropDuplicates(["nro"]))
    related = acts.dropDuplicates(["nro"]).select("nro", parse_question_acts(F.col("documentList")).alias("relatedActs"))
    labels = keywords.dropDuplicates(["nro"]).select("nro", F.nullif(parse_question_keywords(F.col("keywords")), F.array().cast(f"ARRAY<{S.KW}>")).alias("keywords"))
    return parsed.join(related, "nro", "left").join(labels, "nro", "left")


def is_parsable(units: Column) -> Column:
    """Whether an act's response can be parsed: it has a list of units."""
    return units.isNotNull()


def landed_acts(responses: DataFrame, cite_links: DataFrame, compat: bool = False) -> DataFrame:
    """Tree acts (without elements) from act responses: missing fields are null, links come from ``cite_links(key, link)``.

    The link of an act is that of its number; a response's own link is kept where none was found.
    """
    links = cite_links.select(F.col("key").try_cast("long").alias("nro"), "link").dropDuplicates(["nro"])
    acts = responses.where(is_parsable(F.col("units"))).join(links, "nro", "left")
    return acts.select(
        "nro", "id", F.coalesce("link", "citeLink").alias("citeLink"), "actLawType", clean_text(F.col("title")).alias("title"),
        clean_text(F.col("shortQuote")).alias("shortQuote"), F.coalesce("keywords", F.array().cast(f"ARRAY<{S.KW}>")).alias("keywords"),
    )


def landed_nodes(responses: DataFrame, compat: bool = False) -> DataFrame:
    """Element rows of act responses, without keywords."""
    units = F.transform("units", lambda u: u["unitId"])
    return parse_acts(responses.select("nro", "html", units.alias("units")), compat)


def elements_map(nodes: DataFrame) -> DataFrame:
    """``nro, elements``: element rows as an ordered map, for writing acts as they are stored."""
    none = F.array().cast(f"ARRAY<{S.KW}>")
    value = F.struct("children", "parent", "text", none.alias("keywords"))
    listed = nodes.groupBy("nro").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("node_id").alias("key"), value.alias("value")))).alias("l"))
    return listed.select("nro", F.map_from_entries(F.transform("l", lambda x: F.struct(x["key"], x["value"]))).alias("elements"))


def request_body(template: dict[str, str], **values: Column) -> Column:
    """A request body as JSON text: fixed fields and, over them, values per row."""
    fixed = [F.lit(v).alias(k) for k, v in template.items() if k not in values]
    return F.to_json(F.struct(*fixed, *[v.alias(k) for k, v in values.items()]))
