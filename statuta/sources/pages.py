"""Page plans and landed responses of paged services; request bodies as data."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from statuta.session import ship


def page_plan(hits: DataFrame, size: int) -> DataFrame:
    """``hits(key, n)`` as ``key, page, start, size``: whole pages and a last one of the remainder; none for no hits."""
    pages = hits.where("n > 0").select("key", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / size).cast("int"))).alias("page"))
    return pages.select("key", "page", (F.col("page") * size).cast("long").alias("start"), F.least(F.lit(size), F.col("n") - F.col("page") * size).cast("long").alias("size"))


def last_page_wins(rows: DataFrame, key: str, page: str = "page", pos: str = "pos") -> DataFrame:
    """Pages flattened, one row per key: its last occurrence, at the place of its first."""
    where = F.struct(page, pos)
    rest = [c for c in rows.columns if c != key]
    g = rows.groupBy(key).agg(F.max_by(F.struct(*rest), where).alias("r"), F.min(where).alias("__first"))
    return g.select(key, "__first", *[F.col(f"r.{c}").alias(c) for c in rest if c not in (page, pos)]).withColumnRenamed("__first", "place")


def keyword_documents(responses: DataFrame) -> DataFrame:
    """``key, page, pos`` and the five fields of each entry of a response's ``documentList``."""
    return responses.select("key", "page", F.posexplode("documentList").alias("pos", "d")).select("key", "page", "pos", "d.*")


def links(pages: DataFrame, css_class: str, without: str) -> DataFrame:
    """``key, link``: hrefs of anchors of a class by the text after their last dash.

    Links that contain ``without`` are skipped. Within a page the first link of a key counts, of
    several pages the last.
    """
    anchor = f'(?s)<a\\b(?=[^>]*\\bclass="{css_class}")[^>]*\\bhref="([^"]*)"'
    found = pages.select("page", F.posexplode(F.regexp_extract_all("html", F.lit(anchor), F.lit(1))).alias("pos", "link"))
    keyed = found.where(~F.contains("link", F.lit(without))).withColumn("key", F.substring_index("link", "-", -1))
    first = keyed.groupBy("key", "page").agg(F.min_by("link", "pos").alias("link"))
    return first.groupBy("key").agg(F.max_by("link", "page").alias("link"))


def search_request(start: Column, size: Column, domains: dict[str, int], query: Column | None = None) -> Column:
    """The body of a search request as JSON text; domains become a list of label and concept."""
    listed = F.array(*[F.struct(F.lit(k).alias("label"), F.lit(v).alias("conceptId")) for k, v in domains.items()])
    asked = F.lit("") if query is None else F.coalesce(query, F.lit(""))
    return F.to_json(F.struct(asked.alias("query"), listed.alias("domains"), start.alias("start"), size.alias("size")))


class _Pages(DataSourceReader):
    def __init__(self, total: int, size: int, path: str | None):
        self.total, self.size, self.path = total, size, path

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in range(-(-self.total // self.size))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        page = partition.value
        yield page, page * self.size, min(self.size, self.total - page * self.size), self._body(page)

    def _body(self, page: int) -> str | None:
        if self.path is None:
            return None
        system, folder = fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", self.path))
        try:
            with system.open_input_stream(f"{folder}/page_{page}.json") as found:
                return found.read().decode()
        except FileNotFoundError:
            return None


class PageSource(DataSource):
    """Requests of pages and their landed responses as a table, one partition a page: ``spark.read.format("statuta_pages")``.

    Options: ``total`` entries in pages of ``size``, and the folder ``path`` in which the response of page n has
    landed as ``page_n.json``; the body of a page that is missing there is null.
    """

    @classmethod
    def name(cls) -> str:
        return "statuta_pages"

    def schema(self) -> str:
        return "page int, start long, size long, body string"

    def reader(self, schema) -> DataSourceReader:
        return _Pages(int(self.options.get("total", 0)), int(self.options.get("size", 100)), self.options.get("path"))


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(PageSource)
