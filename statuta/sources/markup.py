"""Acts and questions from HTML: units to trees, texts without their children, question parts."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statuta.session import ship

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class Node:
    """An element with its attributes and its contents: texts and further elements."""

    __slots__ = ("attrs", "contents", "tag", "up")

    def __init__(self, tag: str, attrs: dict[str, str], up: Node | None):
        self.tag, self.attrs, self.up, self.contents = tag, attrs, up, []

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.contents) if isinstance(c, Node))


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.contents.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.contents.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node.up is not None and node.tag != tag:
            node = node.up
        if node.up is not None:
            self.at = node.up

    def handle_data(self, data):
        if self.at.contents and isinstance(self.at.contents[-1], str):
            self.at.contents[-1] += data
        else:
            self.at.contents.append(data)


def parse(html: str | None) -> Node:
    builder = _Builder()
    # Markup that sits inside JSON text has its quotes escaped.
    builder.feed((html or "").replace('\\"', '"'))
    builder.close()
    return builder.root


def unit_id(text: str) -> str:
    """A unit id from a div id: without surrounding quotes and backslashes and without spaces."""
    return text.strip('\\"').replace(" ", "")


def div_id(text: str) -> str:
    return f'\\"{text}\\"'


def child_units(div: Node | None, units: set[str], compat: bool = False) -> list[str]:
    """Ids of the first level of divs below ``div`` that holds a unit; with ``compat`` other divs' ids as well."""
    if div is None:
        return []
    stack = [div]
    while stack:
        node = stack.pop()
        if node.tag == "div":
            ids = [unit_id(c.attrs["id"]) for c in node.contents if isinstance(c, Node) and c.tag == "div" and c.attrs.get("id")]
            if not units.isdisjoint(ids):
                return ids if compat else [i for i in ids if i in units]
        stack.extend(c for c in reversed(node.contents) if isinstance(c, Node))
    return []


def _texts(div: Node, without: set[str] = frozenset()) -> Iterator[str]:
    """Pieces of text below a div in their order, whatever the depth, except below the divs of ``without``."""
    waiting = list(reversed(div.contents))
    while waiting:
        item = waiting.pop()
        if isinstance(item, str):
            yield item.strip()
        elif item.tag != "div" or unit_id(item.attrs.get("id", "")) not in without:
            waiting.extend(reversed(item.contents))


def own_text(div: Node | None, without: set[str]) -> str:
    """Texts below a div, each stripped and followed by a space, without the divs of ``without``."""
    return "" if div is None else " ".join(_texts(div, without)).strip()


def act_rows(html: str | None, ids: list[str], compat: bool = False) -> list[tuple[int, str, list[str], str]]:
    """(pos, node id, children, text) of the units of an act."""
    root = parse(html)
    units = [i.replace(" ", "") for i in ids]
    divs: dict[str, Node] = {}
    for node in root.walk():
        if node.tag == "div" and node.attrs.get("id"):
            divs.setdefault(unit_id(node.attrs["id"]), node)
    known, out = set(units), []
    for pos, unit in enumerate(dict.fromkeys(units)):
        children = child_units(divs.get(unit), known, compat)
        out.append((pos, unit, children, own_text(divs.get(unit), set(children))))
    return out


_ACT = T.ArrayType(T.StructType([
    T.StructField("pos", T.LongType()), T.StructField("node_id", T.StringType()),
    T.StructField("children", T.ArrayType(T.StringType())), T.StructField("text", T.StringType()),
]))


def clean_text(text: Column) -> Column:
    """Without escaped quotes, double spaces halved in one pass, non-breaking spaces deleted."""
    return F.replace(F.replace(F.replace(text, F.lit('\\"'), F.lit("")), F.lit("  "), F.lit(" ")), F.lit("\u00a0"), F.lit(""))


def parse_acts(acts: DataFrame, compat: bool = False) -> DataFrame:
    """``nro, pos, node_id, children, parent, text`` from ``acts(nro, html, units)``.

    ``units`` are unit ids in order; acts without them give no rows. The parent of a unit is the
    first unit that has it as a child.
    """

    def run(html: pd.Series, units: pd.Series) -> pd.Series:
        return pd.Series([act_rows(h, list(u), compat) for h, u in zip(html, units)], dtype=object)

    ship(acts.sparkSession)
    rows = acts.where("units IS NOT NULL").select("nro", F.explode(F.pandas_udf(run, _ACT)("html", "units")).alias("e")).select("nro", "e.*")
    up = rows.select("nro", "pos", F.col("node_id").alias("up"), F.explode("children").alias("node_id")).groupBy("nro", "node_id").agg(
        F.min_by("up", "pos").alias("parent")
    )
    return rows.join(up, ["nro", "node_id"], "left").select("nro", "pos", "node_id", "children", "parent", clean_text(F.col("text")).alias("text"))


def part_text(root: Node, css_class: str) -> str:
    """The text of the first div of a class: stripped pieces joined by spaces; a space stands before links."""
    for node in root.walk():
        if node.tag == "div" and css_class in node.attrs.get("class", "").split():
            return " ".join(filter(None, _texts(node)))
    return ""


# The classes of question, answer and justification.
PARTS = {"question": "qa_q", "answer": "qa_a-cont", "justification": "qa_a-just"}


def parse_questions(pages: DataFrame) -> DataFrame:
    """``nro, title, question, answer, justification`` from ``pages(nro, title, questionContent, answerContent)``.

    Pages without question content give no row; empty parts are null.
    """
    ship(pages.sparkSession)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in PARTS])

    def run(html: pd.Series) -> pd.DataFrame:
        roots = [parse(h) for h in html]
        return pd.DataFrame({name: [part_text(r, c) or None for r in roots] for name, c in PARTS.items()})

    html = F.concat("questionContent", F.coalesce("answerContent", F.lit("")))
    out = pages.where("questionContent IS NOT NULL").select("nro", F.nullif("title", F.lit("")).alias("title"), F.pandas_udf(run, schema)(html).alias("p"))
    return out.select("nro", "title", "p.*")


def parse_question_acts(documents: Column) -> Column:
    """Related acts of a response's ``documentList``; null for none."""
    acts = F.transform(documents, lambda d: F.struct(
        d["nro"].alias("nro"), d["title"].alias("title"), d["lawType"].alias("lawType"), d["validity"].alias("validity"),
        F.when(F.size(d["units"]) > 0, F.transform(d["units"], lambda u: F.struct(u["nro"].alias("nro"), u["id"].alias("id"), u["name"].alias("name")))).alias("relationData"),
    ))
    return F.when(F.size(acts) > 0, acts)


def parse_question_keywords(keywords: Column) -> Column:
    """Label, concept and type of a response's keywords; an empty list for none."""
    some = F.transform(keywords, lambda k: F.struct(k["label"].alias("label"), k["conceptId"].alias("conceptId"), k["instanceOfType"].alias("instanceOfType")))
    return F.coalesce(some, F.array().cast("array<struct<label:string,conceptId:bigint,instanceOfType:bigint>>"))
