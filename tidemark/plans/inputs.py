"""Runs, observations and labels derived from the star-schema and event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import columns as C


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def runs_from_events(spark: SparkSession, sf_dir: str, one_agent: bool = False) -> DataFrame:
    """One run per user and day; tools are the event types in time order.

    A tool list is as long as the user's day, which the source bounds and the engine does not cut.
    """
    events = table(spark, sf_dir, "events").select(
        "user_id",
        F.to_date("ts").alias("day"),
        "ts",
        "event_id",
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )
    grouped = events.groupBy("user_id", "day").agg(
        F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type", "value"))).alias("steps"),
        F.min("ts").alias("started_at"),
        F.max("ts").alias("completed_at"),
        F.count("*").alias("tool_call_count"),
        F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"),
        F.count_if(F.col("event_type") == "error").alias("error_count"),
        F.count_if(F.col("event_type").isin("click", "view")).alias("looks"),
        F.coalesce(F.sum("k"), F.lit(0)).alias("prompt_tokens"),
        (F.sum(F.length("event_type")) * 10).alias("completion_tokens"),
        F.sum(F.round("value").cast("long")).alias("output_length"),
    )
    tools = F.transform("steps", lambda s: s["event_type"])
    last = F.element_at("tools", -1)
    week = F.expr("datediff(day, DATE'2024-01-01') div 7 + 1")
    return grouped.withColumn("tools", tools).select(
        F.concat_ws("-", F.col("user_id"), F.col("day")).alias("id"),
        (F.lit("agent-0") if one_agent else F.concat(F.lit("agent-"), F.col("user_id") % 4)).alias("session_id"),
        F.concat(F.lit("v"), week).alias("deployment_version"),
        F.when(F.col("user_id") % 10 == 0, "unknown").otherwise("release").alias("version_source"),
        F.when(F.col("user_id") % 7 == 0, "staging").otherwise("production").alias("environment"),
        "started_at",
        "completed_at",
        "tools",
        "tool_call_count",
        F.expr("cents div 5").alias("latency_ms"),
        "error_count",
        C.retry_count(F.col("tools")).cast("long").alias("retry_count"),
        F.greatest(F.lit(1), F.col("looks")).cast("long").alias("loop_count"),
        F.round(F.element_at("steps", 1)["value"] * 10).cast("long").alias("time_to_first_tool_ms"),
        "prompt_tokens",
        "completion_tokens",
        C.verbosity_ratio(F.col("prompt_tokens"), F.col("completion_tokens")).alias("verbosity_ratio"),
        "output_length",
        F.when(last == "error", "escalated")
        .when(last == "purchase", "resolved")
        .when(last == "signup", "fallback")
        .otherwise("unknown")
        .alias("semantic_cluster"),
    )


def runs_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run per order; tools are the line flags, the agent is the priority, the version a year."""
    lines = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        "l_linenumber",
                        "l_partkey",
                        "l_suppkey",
                        "l_extendedprice",
                        F.concat("l_returnflag", "l_linestatus").alias("tool"),
                    )
                )
            ).alias("steps")
        )
    )
    orders = table(spark, sf_dir, "orders")
    none = F.array().cast("array<string>")
    return orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left").select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.col("o_orderpriority").alias("session_id"),
        F.year("o_orderdate").cast("string").alias("deployment_version"),
        F.lit("production").alias("environment"),
        F.col("o_orderdate").alias("started_at"),
        F.coalesce(F.transform("steps", lambda s: s["tool"]), none).alias("tools"),
        F.coalesce(F.size("steps"), F.lit(0)).cast("long").alias("tool_call_count"),
        (F.col("o_totalprice") / 100).cast("long").alias("latency_ms"),
        F.col("o_orderstatus").alias("semantic_cluster"),
    )


def conversation_traces(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Traces and observations made from conversations; times follow from the ids."""
    turns = table(spark, sf_dir, "conversations")
    start = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(conv_id as int), 0, 0)")
    at = F.expr(
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(conv_id as int), 0, cast(turn * 3 as decimal(18,6)))"
    )
    size = F.length("text")
    observations = turns.select(
        F.col("conv_id").cast("string").alias("trace_id"),
        F.concat_ws("-", "conv_id", "turn").alias("id"),
        F.when(F.col("turn") == 0, F.lit(None).cast("string"))
        .when(F.col("turn") % 2 == 1, F.concat_ws("-", F.col("conv_id"), F.col("turn") - 1))
        .otherwise(F.concat(F.col("conv_id").cast("string"), F.lit("-0")))
        .alias("parent_id"),
        F.col("turn").alias("position"),
        F.when(F.col("role") == "assistant", "generation").when(F.col("role") == "user", "span").otherwise("event").alias("type"),
        F.col("role").alias("name"),
        at.alias("start_time"),
        (at + F.expr("interval 1 second")).alias("end_time"),
        F.when(F.col("role") == "user", size).otherwise(F.lit(0)).cast("long").alias("usage_input"),
        F.when(F.col("role") == "assistant", size).otherwise(F.lit(0)).cast("long").alias("usage_output"),
        F.when(size < 20, "ERROR").otherwise("DEFAULT").alias("level"),
    )
    said = lambda role: F.when(F.col("role") == role, F.struct("turn", "text"))
    traces = turns.groupBy("conv_id").agg(
        F.max(said("assistant"))["text"].alias("output"), F.min(said("user"))["text"].alias("input")
    ).select(
        F.col("conv_id").cast("string").alias("trace_id"),
        F.when(F.col("conv_id") % 5 == 0, F.concat(F.lit("r"), F.col("conv_id") % 3)).alias("release"),
        F.when(F.col("conv_id") % 5 == 1, "t1").alias("version"),
        F.when(F.col("conv_id") % 5 == 2, "m1").alias("meta_deployment_version"),
        F.lit(None).cast("string").alias("meta_version"),
        F.lit(None).cast("string").alias("meta_release"),
        F.when(F.col("conv_id") % 4 == 0, "staging").alias("meta_environment"),
        F.when(F.col("conv_id") % 6 == 0, F.col("conv_id") * 10).cast("long").alias("meta_latency_ms"),
        F.when(F.col("conv_id") % 11 == 0, F.lit(True)).alias("meta_error"),
        F.lit(None).cast("string").alias("status"),
        F.lit(None).cast("string").alias("level"),
        start.alias("timestamp"),
        F.lit(None).cast("timestamp_ntz").alias("end_time"),
        F.when(F.col("conv_id") % 6 == 1, (F.col("conv_id") * 7).cast("double")).alias("latency"),
        F.concat(F.lit("session-"), F.col("conv_id") % 3).alias("session_id"),
        "input",
        "output",
    )
    return traces, observations
