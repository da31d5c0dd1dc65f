"""Exact positions of rows in their groups, without a window over a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import keep

ROW_BITS = 33
"""``monotonically_increasing_id`` counts rows in its lower bits and partitions above."""


def positions(df: DataFrame, group: str, order: Sequence[Column], name: str) -> DataFrame:
    """``df`` with ``position`` (from 0, in its group, null being a group too) and ``total`` (rows of the group).

    Rows are dealt by ranges of (group, order), so a group that holds a third of all rows lies on as many
    partitions as its rows need. Rows equal in both are dealt at random. The sorted partitions are written; what lies before a
    partition is then a sum over one row per (partition, group).
    """
    by = [F.col(group).asc_nulls_first(), *order]
    dealt = df.repartitionByRange(*by, F.rand(7)).sortWithinPartitions(*by)
    placed = keep(dealt.withColumn("_row", F.monotonically_increasing_id()), name)
    placed = placed.withColumn("_part", F.shiftright("_row", ROW_BITS))
    runs = placed.groupBy("_part", group).agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    earlier = Window.partitionBy(group).orderBy("_part")
    runs = runs.select(
        F.col("_part").alias("_part_"),
        F.col(group).alias("_group_"),
        "_first",
        F.coalesce(F.sum("_n").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_n").over(earlier.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"),
    )
    joined = placed.join(runs, (F.col("_part") == F.col("_part_")) & F.col(group).eqNullSafe(F.col("_group_")))
    return joined.select(*df.columns, (F.col("_row") - F.col("_first") + F.col("_before")).alias("position"), "total")
