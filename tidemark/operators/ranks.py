"""Ranks, running totals and row numbers that never sort one whole group in one task.

A group is cut into buckets of the order column (an hour, a range of values). The bucket table is
small; a window over it gives how much lies before each bucket. The big table is then only ordered
inside (group, bucket). Buckets depend on the values alone, so every recomputation gives the same
result whatever the partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _before(df: DataFrame, by: Sequence[str], bucket: str, columns: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return df.select("*", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"__before_{c}") for c in columns])


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Repartitions by columns into as many tasks as the session shuffles with (at least its cores).

    For steps that multiply few rows or call Python: adaptive execution would judge their input by its
    small size and run them in one task.
    """
    session = df.sparkSession
    n = max(int(session.conf.get("spark.sql.shuffle.partitions")), session.sparkContext.defaultParallelism)
    return df.repartition(n, *columns)


def numbered(
    df: DataFrame,
    by: Sequence[str],
    ts: str,
    ties: Sequence[str] = (),
    name: str = "rn",
    width: str = "hour",
    descending: bool = False,
) -> DataFrame:
    """``row_number`` per group in time order, starting at 1, plus the group size as ``<name>_n``."""
    bucketed = df.withColumn("__bucket", F.date_trunc(width, F.col(ts)))
    counts = bucketed.groupBy(*by, "__bucket").agg(F.count("*").alias("__n"))
    order = F.col("__bucket").desc() if descending else F.col("__bucket").asc()
    w = Window.partitionBy(*by).orderBy(order)
    offsets = counts.select(
        *by,
        "__bucket",
        F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__off"),
        F.sum("__n").over(Window.partitionBy(*by)).alias(f"{name}_n"),
    )
    inner = [F.col(c).desc() if descending else F.col(c).asc() for c in (ts, *ties)]
    local = F.row_number().over(Window.partitionBy(*by, "__bucket").orderBy(*inner))
    return (
        bucketed.join(offsets, [*by, "__bucket"])
        .withColumn(name, (F.col("__off") + local).cast("long"))
        .drop("__bucket", "__off")
    )


def running(
    counts: DataFrame,
    by: Sequence[str],
    value: str,
    columns: Sequence[str],
    width: float = 1024,
    successor: bool = False,
) -> DataFrame:
    """Running totals over value counts (one row per group and value).

    Adds ``cum_<c>`` (total up to and including the value) and ``all_<c>`` (total of the group) for
    every counted column, and ``next_value`` when ``successor`` is set.
    """
    bucketed = counts.withColumn("__bucket", F.floor(F.col(value) / F.lit(width)))
    per_bucket = bucketed.groupBy(*by, "__bucket").agg(
        *[F.sum(c).alias(c) for c in columns], F.min(value).alias("__first")
    )
    whole = Window.partitionBy(*by)
    offsets = _before(per_bucket, by, "__bucket", columns).select(
        *by,
        "__bucket",
        *[F.col(f"__before_{c}") for c in columns],
        *[F.sum(c).over(whole).alias(f"all_{c}") for c in columns],
        F.lead("__first").over(whole.orderBy("__bucket")).alias("__next_first"),
    )
    inside = Window.partitionBy(*by, "__bucket").orderBy(value)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = bucketed.join(offsets, [*by, "__bucket"])
    for c in columns:
        out = out.withColumn(f"cum_{c}", F.col(f"__before_{c}") + F.sum(c).over(upto))
    if successor:
        out = out.withColumn("next_value", F.coalesce(F.lead(value).over(inside), F.col("__next_first")))
    return out.drop("__bucket", "__next_first", *[f"__before_{c}" for c in columns])


def newest(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    n: int,
    spread: Column,
    salts: int = 32,
) -> DataFrame:
    """The first ``n`` rows of every group. A hot group is first cut to ``n`` per salt."""
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts)))
    first = Window.partitionBy(*by, "__salt").orderBy(*order)
    partial = salted.withColumn("__r", F.row_number().over(first)).where(F.col("__r") <= n)
    if by:
        final = Window.partitionBy(*by).orderBy(*order)
        return partial.withColumn("__r", F.row_number().over(final)).where(F.col("__r") <= n).drop("__salt", "__r")
    return partial.drop("__salt", "__r").orderBy(*order).limit(n)


def newest_in_time(
    df: DataFrame, by: Sequence[str], ts: str, ties: Sequence[str], n: int, width: str = "hour"
) -> DataFrame:
    """The newest ``n`` rows of every group.

    Counts per (group, hour) show which hours can hold them; only rows of those hours are ranked, so
    the wide rows of older hours are filtered in place and never shuffled.
    """
    bucketed = df.withColumn("__bucket", F.date_trunc(width, F.col(ts)))
    counts = bucketed.groupBy(*by, "__bucket").agg(F.count("*").alias("__n"))
    later = Window.partitionBy(*by).orderBy(F.col("__bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    hours = (
        counts.withColumn("__later", F.coalesce(F.sum("__n").over(later), F.lit(0)))
        .where(F.col("__later") < n)
        .select(*by, "__bucket")
    )
    few = bucketed.join(hours, [*by, "__bucket"], "left_semi").drop("__bucket")
    return newest(few, by, [F.col(ts).desc(), *[F.col(t).desc() for t in ties]], n, F.col(ties[0]))


def floor_percentile(df: DataFrame, by: Sequence[str], value: str, percents: dict[str, Column]) -> DataFrame:
    """Values at floor-index ranks of integer columns: sorted[min(n*p div 100, n-1)].

    ``percents`` maps an output name to a rank expression over the group size ``n`` (0-based).
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("k"))
    return percentile_of_counts(counts, by, value, percents)


def percentile_of_counts(
    counts: DataFrame, by: Sequence[str], value: str, percents: dict[str, Column], width: float = 1024
) -> DataFrame:
    """As ``floor_percentile`` for value counts in column ``k``."""
    ranked = running(counts, by, value, ["k"], width).withColumn("n", F.col("all_k"))
    start = F.col("cum_k") - F.col("k")
    picks = [
        F.max(F.when((start <= rank) & (rank < F.col("cum_k")), F.col(value))).alias(name)
        for name, rank in percents.items()
    ]
    return ranked.groupBy(*by).agg(*picks)


def percent_rank(p: int) -> Column:
    """Rank of the floor-index percentile p over the group size ``n``."""
    return F.least(F.expr(f"(n * {p}) div 100"), F.col("n") - 1)


def interpolated_of_counts(
    counts: DataFrame, by: Sequence[str], value: str, fraction: float, name: str, width: float = 1024
) -> DataFrame:
    """Linearly interpolated percentile of value counts in column ``k``."""
    position = (F.col("n") - 1) * F.lit(fraction)
    picked = percentile_of_counts(
        counts,
        by,
        value,
        {
            "__lo": F.floor(position),
            "__hi": F.least(F.floor(position) + 1, F.col("n") - 1),
        },
        width,
    )
    sizes = counts.groupBy(*by).agg(F.sum("k").alias("n"))
    weight = position - F.floor(position)
    return picked.join(sizes, list(by)).select(
        *by, (F.col("__lo") + (F.col("__hi") - F.col("__lo")) * weight).alias(name)
    )


def average_rank(df: DataFrame, by: Sequence[str], value: str, width: float = 1 / 256) -> DataFrame:
    """Rank with ties sharing their mean, one row per group and distinct value."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("k"))
    return average_rank_of_counts(counts, by, value, width)


def average_rank_of_counts(counts: DataFrame, by: Sequence[str], value: str, width: float = 1 / 256) -> DataFrame:
    """As ``average_rank`` for value counts in column ``k``."""
    ranked = running(counts, by, value, ["k"], width)
    return ranked.select(
        *by, value, (F.col("cum_k") - F.col("k") + (F.col("k") + 1) / 2).alias("avg_rank"), F.col("all_k").alias("n")
    )
