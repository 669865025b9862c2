"""Landed JSON files as tables, with explicit schemas. Files are whole texts; maps keep their order."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta import schemas as S
from statuta.session import ship


def read_json(spark: SparkSession, path: str, schema: str, glob: str = "*.json", strict: bool = True) -> DataFrame:
    """``file, value``: one row per file; other files in the folder are ignored.

    ``strict`` fails on text that is not JSON of the schema's shape, else the value is null.
    """
    files = spark.read.option("pathGlobFilter", glob).text(path, wholetext=True)
    mode = {"mode": "FAILFAST" if strict else "PERMISSIVE"}
    return files.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.from_json("value", schema, mode).alias("value"))


def questions(spark: SparkSession, path: str, raw: bool = False) -> DataFrame:
    """Records of question files ``{last_update, questions: {nro: record}}``; no file gives no rows."""
    record = S.struct_of(S.RAW_QUESTION if raw else S.QUESTION)
    found = read_json(spark, path, f"STRUCT<last_update: STRING, questions: MAP<STRING, {record}>>")
    return found.select(F.explode(F.map_values("value.questions")).alias("q")).select("q.*")


def tree_acts(spark: SparkSession, path: str) -> DataFrame:
    """Acts, one file each; map order is document order."""
    return read_json(spark, path, S.struct_of(S.TREE_ACT)).where("value IS NOT NULL").select("value.*")


def leaf_acts(spark: SparkSession, path: str) -> DataFrame:
    """The five stored fields of leaf acts."""
    return read_json(spark, path, S.struct_of(S.LEAF_ACT)).where("value IS NOT NULL").select("value.*")


def act_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Vector rows of leaf acts: ``{elements: {root: [vector]}}``."""
    found = read_json(spark, path, f"STRUCT<elements: MAP<STRING, ARRAY<{S.struct_of(S.VECTOR_ACT)}>>>")
    lists = found.select(F.explode(F.map_entries("value.elements")).alias("e"))
    return lists.select(F.inline("e.value"))


def keywords(spark: SparkSession, path: str) -> DataFrame:
    """Keywords from files ``concept_(type).json``: a map by act, or ``[]`` for none."""
    found = read_json(spark, path, f"MAP<STRING, {S.RELATION}>", strict=False)
    name = F.url_decode(F.col("file"))
    part = lambda i: F.regexp_extract(name, r"^(-?\d+)_\((-?\d+)\)", i).try_cast("long")
    none = F.array().cast(f"array<{S.RELATION}>")
    return found.select(part(1).alias("conceptId"), part(2).alias("instanceOfType"), F.coalesce(F.map_values("value"), none).alias("actRelations")).where(
        "conceptId IS NOT NULL"
    )


def write_json(rows: DataFrame, path: str) -> None:
    """Rows as lines of JSON, one object a row."""
    rows.write.mode("overwrite").json(path)


def write_files(files: DataFrame, path: str) -> None:
    """``files(file, body)`` as files of these names in a folder that all executors share; an existing one is overwritten.

    Every task writes its own files, so that a repeated task writes the same again.
    """
    root = re.sub(r"^file:/+", "/", path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, folder = fs.FileSystem.from_uri(root)
        system.create_dir(folder)
        for batch in batches:
            for name, body in zip(batch["file"], batch["body"]):
                with system.open_output_stream(f"{folder}/{name}") as out:
                    out.write((body or "").encode())
            yield pd.DataFrame({"n": [len(batch)]})

    ship(files.sparkSession)
    files.select("file", "body").mapInPandas(run, "n long").agg(F.sum("n")).collect()
