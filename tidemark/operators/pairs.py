"""Pairs of versions to compare and how group-level tables are attached to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import constants as K


def consecutive_pairs(runs: DataFrame) -> DataFrame:
    """Each version against the one before it, by first run time."""
    firsts = runs.groupBy(*K.GROUP).agg(F.min("started_at").alias("first_at"))
    w = Window.partitionBy(*K.AGENT).orderBy("first_at", "deployment_version")
    return (
        firsts.withColumn("baseline_version", F.lag("deployment_version").over(w))
        .where(F.col("baseline_version").isNotNull())
        .select(*K.AGENT, "baseline_version", F.col("deployment_version").alias("current_version"))
    )


def sides(pairs: DataFrame) -> DataFrame:
    """Two rows per pair: side ``b`` with the baseline version and ``c`` with the current one."""
    both = F.array(
        F.struct(F.lit("b").alias("side"), F.col("baseline_version").alias("deployment_version")),
        F.struct(F.lit("c").alias("side"), F.col("current_version").alias("deployment_version")),
    )
    return pairs.select(*K.PAIR, F.explode(both).alias("s")).select(*K.PAIR, "s.side", "s.deployment_version")


def attach(groups: DataFrame, pairs: DataFrame) -> DataFrame:
    """Group-level rows repeated for every pair and side they belong to.

    Only aggregated rows pass here. The join has no hint: the pair table grows with the number of
    agents, so its size decides between broadcast and sort-merge at run time.
    """
    return groups.join(sides(pairs), K.GROUP).drop("deployment_version")


def both_sides(groups: DataFrame, pairs: DataFrame, columns: list[str]) -> DataFrame:
    """One row per pair with ``b_<col>`` and ``c_<col>``; pairs with one side only are dropped."""
    attached = attach(groups.select(*K.GROUP, *columns), pairs)
    return pivot_sides(attached, columns)


def pivot_sides(attached: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    by = by or K.PAIR
    record = F.struct(*columns)
    wide = attached.groupBy(*by).agg(
        F.max(F.when(F.col("side") == "b", record)).alias("b"), F.max(F.when(F.col("side") == "c", record)).alias("c")
    )
    return wide.where(F.col("b").isNotNull() & F.col("c").isNotNull()).select(
        *by, *[F.col(f"b.{c}").alias(f"b_{c}") for c in columns], *[F.col(f"c.{c}").alias(f"c_{c}") for c in columns]
    )
