"""Rolling budgets: limits on the mean of the newest runs of each agent and version."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import constants as K
from tidemark.operators import ranks

BY = ("session_id", "deployment_version")


def _measures() -> dict[str, Column]:
    """What each budget key averages; both latency limits use the mean."""
    is_outcome = lambda name: (F.col("semantic_cluster") == name).cast("double")
    return {
        "max_p95_latency": F.col("latency_ms").cast("double"),
        "max_p50_latency": F.col("latency_ms").cast("double"),
        "max_error_rate": (F.col("error_count") > 0).cast("double"),
        "max_escalation_rate": is_outcome("escalated"),
        "min_resolution_rate": is_outcome("resolved"),
        "max_retry_rate": F.col("retry_count").cast("double"),
        "max_loop_depth": F.col("loop_count").cast("double"),
        "max_verbosity_ratio": F.col("verbosity_ratio"),
        "max_output_length": F.col("output_length").cast("double"),
        "max_time_to_first_tool": F.col("time_to_first_tool_ms").cast("double"),
    }


def budget_keys(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(K.BUDGET_KEYS.items()), "budget_key string, dimension string")


def validate_limits(limits: DataFrame) -> DataFrame:
    """Rows that are no valid limits: unknown key or not a number. ``limits``: budget_key, limit_text."""
    known = budget_keys(limits.sparkSession)
    unknown = limits.join(F.broadcast(known), "budget_key", "left_anti").withColumn("problem", F.lit("unknown key"))
    number = limits.join(F.broadcast(known), "budget_key", "left_semi").where(F.expr("try_cast(limit_text as double) is null"))
    return unknown.unionByName(number.withColumn("problem", F.lit("not a number")))


def rolling_budget(runs: DataFrame, window: int = 10, min_n: int = 5, by: Sequence[str] = BY) -> DataFrame:
    """Mean of the newest ``window`` runs per group and budget key."""
    recent = ranks.newest_in_time(runs, by, "started_at", ["id"], window)
    measures = _measures()
    return rolling_means(recent.groupBy(*by).agg(F.count("*").alias("run_count"), *[F.avg(m).alias(k) for k, m in measures.items()]), min_n, by)


def rolling_means(wide: DataFrame, min_n: int = 5, by: Sequence[str] = BY) -> DataFrame:
    """One row per group and budget key, from one row per group with ``run_count`` and a column per key."""
    rows = F.array(*[F.struct(F.lit(k).alias("budget_key"), F.col(k).alias("actual")) for k in _measures()])
    return (
        wide.where(F.col("run_count") >= min_n)
        .select(*by, "run_count", F.explode(rows).alias("r"))
        .select(*by, "run_count", "r.budget_key", "r.actual")
    )


def budget_breaches(rolling: DataFrame, limits: DataFrame) -> DataFrame:
    """Rows beyond their limit. ``limits``: session_id, deployment_version, budget_key, limit_value."""
    above = F.col("budget_key").startswith("max_") & (F.col("actual") > F.col("limit_value"))
    below = F.col("budget_key").startswith("min_") & (F.col("actual") < F.col("limit_value"))
    return (
        rolling.join(limits, [*BY, "budget_key"])
        .withColumn("direction", F.when(above, "above").when(below, "below"))
        .where(F.col("direction").isNotNull())
        .join(F.broadcast(budget_keys(rolling.sparkSession)), "budget_key")
        .select(*BY, "budget_key", "dimension", "limit_value", "actual", "direction", "run_count")
    )


def rolling_history(
    runs: DataFrame, column: str = "latency_ms", window: int = 10, by: Sequence[str] = BY, block: int = 100_000
) -> DataFrame:
    """The rolling mean at every run. Positions are cut into blocks; a block also gets the few rows
    before it that its first windows need, so no group has to be ordered in one task."""
    by = list(by)
    numbered = ranks.numbered(runs.select(*by, "id", "started_at", column), by, "started_at", ["id"], name="rn")
    own = F.floor((F.col("rn") - 1) / F.lit(block))
    tail = F.pmod(F.col("rn") - 1, F.lit(block)) >= block - (window - 1)
    blocks = F.when(tail, F.array(own, own + 1)).otherwise(F.array(own))
    spread = numbered.withColumn("__own", own).select("*", F.explode(blocks).alias("__block"))
    w = Window.partitionBy(*by, "__block").orderBy("rn").rowsBetween(-(window - 1), 0)
    return (
        spread.withColumn("rolling_mean", F.avg(column).over(w))
        .where(F.col("__own") == F.col("__block"))
        .select(*by, "id", F.col("rn").alias("position"), "rolling_mean")
    )
