"""The row that counts among repeated extractions of one key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _hashable(field: T.StructField) -> Column:
    column = F.col(f"`{field.name}`")
    return F.map_entries(column) if isinstance(field.dataType, T.MapType) else column


def current_rows(df: DataFrame, keys: Sequence[str], at: str = "fetched_at") -> DataFrame:
    """Keep, for every key, the row with the latest ``at``.

    Equal rows count once; of different rows with the same time the one with the larger row hash
    counts, so that the choice is repeatable. A null time is the oldest. Rows with a null in the
    key cannot be identified and are left out. The plan is one shuffle on the key; the per-key
    limit is applied before it (WindowGroupLimit), so a hot key sends one row per task.
    """
    tie = F.xxhash64(*[_hashable(f) for f in df.schema.fields])
    order = Window.partitionBy(*[F.col(f"`{k}`") for k in keys]).orderBy(
        F.col(f"`{at}`").desc_nulls_last(), F.col("__tie").desc()
    )
    identified = df
    for key in keys:
        identified = identified.where(F.col(f"`{key}`").isNotNull())
    return (
        identified.withColumn("__tie", tie)
        .withColumn("__rank", F.row_number().over(order))
        .where(F.col("__rank") == 1)
        .drop("__rank", "__tie")
    )
