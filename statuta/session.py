"""Session helpers: table access and lineage cuts that survive the loss of an executor."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ship(spark: SparkSession) -> None:
    """Make this package importable for the session's Python workers, wherever they run.

    The package goes to the executors as a zip file, once per context; nothing is done where it was
    itself loaded from an archive that Spark distributes.
    """
    context = spark.sparkContext
    home = os.path.dirname(os.path.abspath(__file__))
    if getattr(context, "_statuta_shipped", False) or not os.path.isdir(home):
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="statuta-code-"), "statuta.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in sorted(os.walk(home)):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.join("statuta", os.path.relpath(path, home)))
    context.addPyFile(archive)
    context._statuta_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory (a file or a folder of files)."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints.

    The session's ``spark.checkpoint.dir`` wins. Only where it is unset, as in tests on one
    machine, a temporary folder is used; on a cluster an unset folder is an error.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not (context.master.startswith("local[") or context.master == "local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="statuta-checkpoint-")
    context.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder once and read it from there afterwards.

    The columns get fresh identities: a checkpoint carries constraints on attributes of the plan it
    replaces, at which a union over it would stumble.
    """
    checkpoint_dir(df.sparkSession)
    ship(df.sparkSession)
    return df.checkpoint(eager=True).toDF(*df.columns)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a compressed table in the shared checkpoint folder, for large results that are read more than once.

    It lives as long as the folder, which may be emptied when the session has ended.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    ship(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes, as measured, up to which a side of a join is broadcast.
BROADCAST_BYTES = 32 << 20


def _width(column: Column, kind: T.DataType) -> Column:
    """Bytes that a value takes, roughly; nested values by their text."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StringType, T.BinaryType)):
        return F.aggregate(F.coalesce(column, F.array().cast(kind)), F.lit(24), lambda n, x: n + F.coalesce(F.octet_length(x), F.lit(0)) + 16)
    if isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, (T.ArrayType, T.StructType, T.MapType)):
        return F.greatest(F.size(column), F.lit(0)) * 8 + 24
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        return F.coalesce(F.length(F.to_json(F.struct(column))), F.lit(0)) + 24
    return F.lit(8)


def is_small(df: DataFrame, most: int = BROADCAST_BYTES) -> bool:
    """Whether the rows of ``df`` take at most ``most`` bytes, measured on all of them."""
    width = sum((_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(8))
    return (df.agg(F.sum(width.cast("long"))).first()[0] or 0) <= most


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if it was measured to be small, else as it is."""
    return F.broadcast(df) if is_small(df, most) else df


def hot_join(left: DataFrame, right: DataFrame, on: list[str], spread: list[str], how: str = "left", salts: int = 16) -> DataFrame:
    """``left`` joined to the unique keys of ``right``, where one key may hold a large part of ``left``.

    ``right`` is broadcast if it was measured to be small. Else rows of ``left`` get a salt by a hash of the columns
    ``spread``, and ``right`` is repeated for every salt, so that a popular key is met in as many tasks.
    """
    if is_small(right):
        return left.join(F.broadcast(right), on, how)
    salted = left.withColumn("__salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    each = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(each, [*on, "__salt"], how).drop("__salt")
