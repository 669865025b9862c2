"""Keyed tables as files: insert-only and last-wins merges, deletes, key indexes, lookups, catalog."""

from __future__ import annotations

import os
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statuta.session import cut


def _known(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(keys))


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """One row per key, the first by ``order``; rows with a null key are left out."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return _known(df, keys).withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def insert_only(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """``old`` and the rows of ``new`` whose key it lacks; of repeated new keys the first."""
    return old.unionByName(first_wins(new, keys, order).join(old.select(*keys), list(keys), "left_anti").select(*old.columns))


def inserted_keys(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    return _known(new, keys).select(*keys).distinct().join(old.select(*keys), list(keys), "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """``new`` over ``old``: new rows replace those of equal key; ``order`` puts the row that counts first."""
    fresh = first_wins(new, keys, order).select(*old.columns)
    return old.join(fresh.select(*keys), list(keys), "left_anti").unionByName(fresh)


def delete(df: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(gone.select(*keys), list(keys), "left_anti")


def delete_one(df: DataFrame, gone: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """Without the first row of each given key, where keys repeat."""
    w = Window.partitionBy(*keys).orderBy(*order)
    flag = gone.select(*keys).distinct().withColumn("__gone", F.lit(True))
    ranked = df.withColumn("__r", F.row_number().over(w)).join(flag, list(keys), "left")
    return ranked.where("NOT (coalesce(__gone, false) AND __r = 1)").drop("__r", "__gone")


def missing_keys(wanted: DataFrame, index: DataFrame, keys: Sequence[str]) -> DataFrame:
    return _known(wanted, keys).select(*keys).distinct().join(index.select(*keys), list(keys), "left_anti")


def index_union(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    return old.select(*keys).unionByName(new.select(*keys)).distinct()


def same_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: whether two tables hold the same set of keys, and how many each has alone."""
    sides = a.select(*keys).distinct().withColumn("__s", F.lit(1)).unionByName(b.select(*keys).distinct().withColumn("__s", F.lit(2)))
    per = sides.groupBy(*keys).agg(F.sum("__s").alias("s"))
    return per.agg(
        F.count_if(F.col("s") == 1).alias("only_left"), F.count_if(F.col("s") == 2).alias("only_right")
    ).select(((F.col("only_left") == 0) & (F.col("only_right") == 0)).alias("same"), "only_left", "only_right")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The check that stands for a unique index: keys with more than one row."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def by_keys(df: DataFrame, key: str, values: Sequence) -> DataFrame:
    return df.where(F.col(key).isin(list(values)))


def page(df: DataFrame, order: Sequence, skip: int, size: int) -> DataFrame:
    return df.orderBy(*order).offset(skip).limit(size)


def batches(df: DataFrame, order: Sequence[str], size: int) -> DataFrame:
    """``df`` with ``batch``: runs of ``size`` rows in order.

    Rows are numbered per range of the order, and ranges by their counts (a row per partition), so that
    no task sees all of them.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Written once, since the partition numbers must not change between the two uses.
    ranged = cut(df.repartitionByRange(parts, *order).withColumn("__p", F.spark_partition_id()))
    counts = ranged.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.withColumn("__before", F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).drop("__n")
    inside = F.row_number().over(Window.partitionBy("__p").orderBy(*order)) - 1
    numbered = ranged.withColumn("__i", inside).join(F.broadcast(before), "__p")
    return numbered.withColumn("batch", F.floor((F.col("__before") + F.col("__i")) / size)).drop("__p", "__i", "__before")


class Store:
    """Tables as folders of Parquet files under a root that all executors see."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        fs, path = self._fs()
        return fs.exists(path(self.path(name)))

    def names(self) -> list[str]:
        fs, path = self._fs()
        if not fs.exists(path(self.root)):
            return []
        return sorted(s.getPath().getName() for s in fs.listStatus(path(self.root)) if s.isDirectory() and not s.getPath().getName().startswith("_"))

    def create(self, name: str, schema: str) -> None:
        """An empty table, unless it exists."""
        if not self.exists(name):
            self.spark.createDataFrame([], schema).write.parquet(self.path(name))

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def append(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.path(name))

    def replace(self, name: str, rows: DataFrame) -> None:
        """Write beside the table, then rename: a reader of the old table is never left without files half-way."""
        fs, path = self._fs()
        rows.write.mode("overwrite").parquet(self.path(f"_{name}_next"))
        fs.delete(path(self.path(name)), True)
        fs.rename(path(self.path(f"_{name}_next")), path(self.path(name)))

    def insert_only(self, name: str, rows: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
        """Append rows of new keys; returns their keys."""
        old = self.read(name)
        fresh = cut(first_wins(rows, keys, order).join(old.select(*keys), list(keys), "left_anti").select(*old.columns))
        self.append(name, fresh)
        return fresh.select(*keys)

    def upsert(self, name: str, rows: DataFrame, keys: Sequence[str], order: Sequence) -> None:
        self.replace(name, upsert(self.read(name), rows, keys, order))

    def delete(self, name: str, gone: DataFrame, keys: Sequence[str]) -> None:
        self.replace(name, delete(self.read(name), gone, keys))

    def drop(self, name: str) -> None:
        fs, path = self._fs()
        fs.delete(path(self.path(name)), True)

    def counts(self) -> DataFrame:
        """``name, n`` of every table."""
        rows = [self.read(n).agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n")) for n in self.names()]
        return reduce(DataFrame.unionByName, rows) if rows else self.spark.createDataFrame([], "name string, n long")


def domain_name(domains: Sequence[int]) -> str:
    """The partition name of a set of domains."""
    return "_".join(str(d) for d in domains)


def local_root(path: str) -> str:
    return path if "://" in path else "file://" + os.path.abspath(path)
