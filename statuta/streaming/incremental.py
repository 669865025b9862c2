"""Incremental jobs over arriving files: embedding of new rows, and the state of deliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from statuta.functions.embed import Embedder, embed_rows
from statuta.operators.store import Store, first_wins


def embed_arrivals(
    spark: SparkSession, source: str, schema: StructType, store: Store, name: str, keys: list[str], text: str, embedder: Embedder,
    checkpoint: str, files_per_batch: int = 100,
) -> StreamingQuery:
    """Embed the rows of arriving Parquet files into the table ``name``, each key once.

    A batch that is repeated after a failure adds nothing: keys already in the table are skipped.
    Runs until all files there are done.
    """
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema if f.name in keys)
    store.create(name, f"{columns}, embedding array<float>")

    def batch(rows: DataFrame, _: int) -> None:
        fresh = first_wins(rows, keys, [F.xxhash64(text)])
        todo = fresh.join(store.read(name).select(*keys), keys, "left_anti")
        store.append(name, embed_rows(todo, keys, text, embedder))

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrivals_per_window(events: DataFrame, time: str, kind: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """``start, kind, n``: arrivals per window; rows later than the watermark are left out of closed windows."""
    w = F.window(F.col(time), window)
    counted = events.withWatermark(time, late).groupBy(w, F.col(kind)).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("start"), F.col(kind).alias("kind"), "n")
