"""Exported traces and observations to runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.functions import constants as K
from tidemark.session import kept


def version_columns(env_version: str | None = None) -> tuple[Column, Column]:
    """Version and where it came from: release, tag, metadata, environment, calendar week, unknown."""
    week = F.concat(F.lit("epoch-"), F.date_format(F.date_trunc("week", F.col("timestamp")), "yyyy-MM-dd"))
    blank = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c))
    steps = [
        (blank("release"), "release"),
        (blank("version"), "tag"),
        (blank("meta_deployment_version"), "tag"),
        (blank("meta_version"), "tag"),
        (blank("meta_release"), "release"),
        (F.lit(env_version), "env"),
        (week, "epoch"),
        (F.lit("unknown"), "none"),
    ]
    version = F.coalesce(*[v for v, _ in steps])
    source = F.coalesce(*[F.when(v.isNotNull(), F.lit(s)) for v, s in steps])
    return version, source


def _step(position: Column, id: Column) -> Column:
    """A row's own part of its path: text that sorts as (position, id) does and is no beginning of a sibling's part."""
    digits = F.coalesce(position.cast("string"), F.lit(""))
    return F.concat(F.char(F.length(digits) + 48), digits, F.coalesce(id, F.lit("")), F.lit("\0"))


def tree_paths(observations: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Observations with their pre-order path as sortable text, however deep the tree; orphans are roots.

    Pointer doubling on two shrinking sets. After k rounds a row knows its 2**k-th ancestor and the path below it;
    only rows at least 2**k deep (``active``) join, and only rows with descendants that far down (``heads``) are
    joined with. Both are written each round, so plans stay flat and a lost executor costs one round. Rounds
    are the logarithm of the depth: a flat trace ends after the first, whatever its size. The joins are on
    (trace, id), and a parent is one row there, so the children of one parent can be split over tasks.

    Each round finishes the rows nearest to the roots, so the active rows grow fewer as long as one of them is not
    on or below a cycle. When none was finished only those are left; they keep the path walked so far.
    Of rows that repeat an id the first in order is the parent. Positions count from 0; null comes first.
    ``max_depth`` ends the rounds sooner.
    """
    keys = ["trace_id", "id"]
    parents = observations.select("trace_id", F.col("id").alias("parent_id")).distinct().withColumn("has_parent", F.lit(True))
    started = (
        observations.join(parents, ["trace_id", "parent_id"], "left")
        .withColumn("up", F.when(F.col("has_parent") & (F.col("parent_id") != F.col("id")), F.col("parent_id")))
        .select(*observations.columns, "up", _step(F.col("position"), F.col("id")).alias("path"))
    )
    rows = kept(started, "paths")
    known = rows.select(*keys, "up", "path")
    parts, depth, left = [], 1, None
    while True:
        active = rows.where(F.col("up").isNotNull())
        count = active.count()
        if not count or count == left or (max_depth and depth >= max_depth):
            break
        parts.append(rows.where(F.col("up").isNull()))
        wanted = active.select("trace_id", F.col("up").alias("id")).distinct()
        first = F.min(F.struct("path", "up"))
        heads = kept(known.join(wanted, keys, "left_semi").groupBy(*keys).agg(first.alias("s")).select(*keys, "s.up", "s.path"), "heads")
        above = heads.select("trace_id", F.col("id").alias("up"), F.col("up").alias("up2"), F.col("path").alias("head"))
        joined = active.join(above, ["trace_id", "up"], "left")
        rows = kept(
            joined.select(*observations.columns, F.col("up2").alias("up"), F.concat(F.coalesce("head", F.lit("")), "path").alias("path")),
            "paths",
        )
        # Who has descendants twice as far down was a head before; heads that were active have moved on.
        known = heads.where(F.col("up").isNull()).unionByName(rows.select(*keys, "up", "path"))
        depth, left = 2 * depth, count
    return reduce(DataFrame.unionByName, [*parts, rows]).drop("up")


def is_tool() -> Column:
    """Whether an observation is a tool call: by type, or a step whose name is no framework word."""
    name = F.lower(F.coalesce("name", F.lit("")))
    named = (name != "") & ~name.isin(K.NON_TOOL_NAMES) & ~name.startswith("llm")
    return ((F.col("type") == "tool") & (name != "")) | (F.col("type").isin("generation", "span") & named)


def tree_tools(observations: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Tool names per trace in pre-order of the observation tree."""
    needed = observations.select("trace_id", "id", "parent_id", "position", "type", "name")
    called = tree_paths(needed, max_depth).where(is_tool())
    return called.groupBy("trace_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("path", "name"))), lambda s: s["name"]).alias("tree_tools")
    )


def observation_summary(observations: DataFrame, call_types: tuple[str, ...] = ("generation",), loop_types: tuple[str, ...] = ("generation", "span")) -> DataFrame:
    """Per trace: direct tool calls in order, retries, loops, first tool, tokens, errors, last end."""
    call = F.col("type").isin(*call_types)
    ordered = F.array_sort(
        F.collect_list(F.when(call, F.struct("position", "id", F.coalesce("name", F.lit("unknown_tool")).alias("name"))))
    )
    return (
        observations.groupBy("trace_id")
        .agg(
            F.transform(ordered, lambda s: s["name"]).alias("direct_tools"),
            F.count_if(F.col("type").isin(*loop_types)).alias("steps"),
            F.min(F.when(call, F.col("start_time"))).alias("first_tool_at"),
            F.max("end_time").alias("last_end"),
            F.sum(F.coalesce("usage_input", F.lit(0))).alias("prompt_tokens"),
            F.sum(F.coalesce("usage_output", F.lit(0))).alias("completion_tokens"),
            F.bool_or(F.col("level") == "ERROR").alias("any_error"),
        )
        .withColumn("retry_count", C.retry_count(F.col("direct_tools")).cast("long"))
    )


def merge_tools(direct: Column, tree: Column) -> Column:
    """Direct calls first, then every tree tool not among them, each once."""
    none = F.array().cast("array<string>")
    direct, tree = F.coalesce(direct, none), F.coalesce(tree, none)
    return F.concat(direct, F.array_except(tree, direct))


def _finished(df: DataFrame) -> DataFrame:
    millis = lambda a, b: F.timestamp_diff("MILLISECOND", a, b)
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return (
        df.withColumn(
            "time_to_first_tool_ms",
            F.greatest(F.lit(0), F.coalesce(millis(F.col("started_at"), F.col("first_tool_at")), F.lit(0))).cast("long"),
        )
        .withColumn("tool_call_count", F.size("tools").cast("long"))
        .withColumn("error_count", F.col("is_error").cast("long"))
        .withColumn("semantic_cluster", C.outcome(F.col("output"), F.col("is_error")))
        .withColumn("verbosity_ratio", C.verbosity_ratio(F.col("prompt_tokens"), F.col("completion_tokens")))
        .withColumn("output_length", F.length(text("output")).cast("long"))
        .withColumn("task_input_hash", C.text_hash(F.col("input")))
        .withColumn("output_structure_hash", C.text_hash(F.col("output")))
        .select(
            "id", "external_id", "source", "session_id", "deployment_version", "version_source", "environment",
            "started_at", "completed_at", "latency_ms", "prompt_tokens", "completion_tokens", "error_count",
            "tools", "tool_call_count", "loop_count", "time_to_first_tool_ms", "retry_count", "output_length",
            "semantic_cluster", "verbosity_ratio", "task_input_hash", "output_structure_hash", "input", "output",
        )
    )


def runs_from_traces(
    traces: DataFrame,
    observations: DataFrame,
    fmt: str = "A",
    agent: str | None = None,
    env_version: str | None = None,
) -> DataFrame:
    """Runs from exported traces; ``fmt`` B is the nested-run format read by ``flatten_run_tree``."""
    if fmt == "B":
        roots, children = flatten_run_tree(traces)
        return _runs_b(roots, children, agent, env_version)
    if fmt != "A":
        raise ValueError(f"unknown format: {fmt}")
    version, source = version_columns(env_version)
    joined = (
        traces.join(observation_summary(observations), "trace_id", "left")
        .join(tree_tools(observations), "trace_id", "left")
        .withColumn("deployment_version", version)
        .withColumn("version_source", source)
    )
    stated = F.coalesce(F.col("meta_latency_ms"), F.col("latency").cast("long"), F.lit(0))
    end = F.coalesce("end_time", "last_end")
    measured = F.timestamp_diff("MILLISECOND", F.col("timestamp"), end)
    lag = F.expr("make_dt_interval(0, 0, 0, cast(latency_ms / 1000 as decimal(18,6)))")
    bad = F.upper(F.coalesce("status", F.lit(""))).isin("ERROR") | F.upper(F.coalesce("level", F.lit(""))).isin("ERROR")
    error = F.coalesce(
        F.col("meta_error"),
        bad | F.coalesce(F.col("output").contains("Error:"), F.lit(False)) | F.coalesce("any_error", F.lit(False)),
    )
    return _finished(
        joined.withColumn("latency_ms", F.when((stated == 0) & measured.isNotNull(), measured).otherwise(stated).cast("long"))
        .withColumn("completed_at", F.coalesce(end, F.col("timestamp") + lag))
        .withColumn("is_error", error)
        .withColumn("tools", merge_tools(F.col("direct_tools"), F.col("tree_tools")))
        .withColumn("loop_count", F.greatest(F.lit(1), F.coalesce("steps", F.lit(0))).cast("long"))
        .withColumn("retry_count", F.coalesce("retry_count", F.lit(0)))
        .withColumn("prompt_tokens", F.coalesce("prompt_tokens", F.lit(0)))
        .withColumn("completion_tokens", F.coalesce("completion_tokens", F.lit(0)))
        .withColumn("id", C.text_hash(F.concat(F.lit("A:"), F.col("trace_id"))))
        .withColumn("external_id", F.col("trace_id"))
        .withColumn("source", F.lit("trace-a"))
        .withColumn("session_id", F.lit(agent) if agent else F.coalesce("session_id", F.lit("default")))
        .withColumn("environment", F.coalesce("meta_environment", F.lit("production")))
        .withColumn("started_at", F.col("timestamp"))
    )


def flatten_run_tree(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Format B keeps roots and children in one table: roots have no parent; a child belongs to its root."""
    roots = rows.where(F.col("parent_run_id").isNull())
    children = rows.where(F.col("parent_run_id").isNotNull()).select(
        "trace_id",
        "id",
        F.col("parent_run_id").alias("parent_id"),
        "position",
        F.col("run_type").alias("type"),
        "name",
        "start_time",
        "end_time",
        F.lit(0).cast("long").alias("usage_input"),
        F.lit(0).cast("long").alias("usage_output"),
        F.when(F.coalesce("error", F.lit("")) != "", "ERROR").alias("level"),
    )
    return roots, children


def _runs_b(roots: DataFrame, children: DataFrame, agent: str | None, env_version: str | None) -> DataFrame:
    blank = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c))
    steps = [
        (blank("meta_version"), "tag"),
        (blank("meta_deployment_version"), "tag"),
        (F.lit(env_version), "env"),
        (blank("name"), "tag"),
        (F.lit("unknown"), "none"),
    ]
    summary = observation_summary(children, ("tool",), ("chain", "llm")).drop("prompt_tokens", "completion_tokens")
    joined = roots.join(summary, "trace_id", "left").join(tree_tools(children), "trace_id", "left")
    return _finished(
        joined.withColumn("deployment_version", F.coalesce(*[v for v, _ in steps]))
        .withColumn("version_source", F.coalesce(*[F.when(v.isNotNull(), F.lit(s)) for v, s in steps]))
        .withColumn("latency_ms", (F.coalesce("latency", F.lit(0.0)) * 1000).cast("long"))
        .withColumn("started_at", F.col("start_time"))
        .withColumn("completed_at", F.coalesce("end_time", "start_time"))
        .withColumn("is_error", F.coalesce("error", F.lit("")) != "")
        .withColumn("tools", merge_tools(F.col("direct_tools"), F.col("tree_tools")))
        .withColumn("loop_count", F.greatest(F.lit(1), F.coalesce("steps", F.lit(0))).cast("long"))
        .withColumn("retry_count", F.coalesce("retry_count", F.lit(0)))
        .withColumn("prompt_tokens", F.coalesce("prompt_tokens", F.lit(0)))
        .withColumn("completion_tokens", F.coalesce("completion_tokens", F.lit(0)))
        .withColumn("external_id", F.col("id"))
        .withColumn("id", C.text_hash(F.concat(F.lit("B:"), F.col("external_id"))))
        .withColumn("source", F.lit("trace-b"))
        .withColumn("session_id", F.lit(agent) if agent else F.substring(F.coalesce("session_id", "external_id"), 1, 16))
        .withColumn("environment", F.coalesce("meta_environment", F.lit("production")))
    )


# ---- raw facts to features ---------------------------------------------------------------------
def derive_features(raw: DataFrame, schema_version: int = 1) -> DataFrame:
    """Features that follow from the raw row alone; tools stay empty without observations."""
    status = F.when(
        (F.coalesce("raw_status", F.lit("")) == "error") | (F.coalesce("raw_error_message", F.lit("")) != ""), "trace_error"
    ).otherwise("ok")
    size = lambda c: F.length(F.coalesce(F.col(c), F.lit(""))).cast("long")
    prompt, completion = F.coalesce("tokens_prompt", F.lit(0)), F.coalesce("tokens_completion", F.lit(0))
    zero = F.lit(0).cast("long")
    derived = (
        raw.withColumn("error_classification", status)
        .withColumn("semantic_cluster", C.outcome(F.col("output"), F.col("error_classification") != "ok"))
        .withColumn("feature_schema_version", F.lit(schema_version))
        .withColumn("tools", F.array().cast("array<string>"))
        .withColumn("tool_call_count", zero)
        .withColumn("loop_count", zero)
        .withColumn("retry_count", zero)
        .withColumn("prompt_tokens", prompt)
        .withColumn("completion_tokens", completion)
    )
    return derived.select(
        F.col("id").alias("run_id"),
        "feature_schema_version",
        F.lit("derived").alias("feature_source"),
        "tools",
        "tool_call_count",
        "semantic_cluster",
        "loop_count",
        "retry_count",
        C.verbosity_ratio(F.col("prompt_tokens"), F.col("completion_tokens")).alias("verbosity_ratio"),
        "error_classification",
        C.text_hash(F.col("input")).alias("input_hash"),
        C.text_hash(F.col("output")).alias("output_hash"),
        size("input").alias("input_length"),
        size("output").alias("output_length"),
        C.run_quality().alias("run_quality"),
    )


def features_current(raw: DataFrame, features: DataFrame, schema_version: int = 1) -> DataFrame:
    """Features for every run: kept when current or marked failed (-1), derived when missing or stale."""
    keep = (F.col("feature_schema_version") == schema_version) | (F.col("feature_schema_version") == -1)
    kept = features.where(keep)
    todo = raw.join(kept.select(F.col("run_id").alias("id")), "id", "left_anti")
    fresh = derive_features(todo, schema_version)
    known = kept.join(raw.select(F.col("id").alias("run_id")), "run_id", "left_semi")
    return known.select(fresh.columns).unionByName(fresh)


def raw_with_features(raw: DataFrame, features: DataFrame) -> DataFrame:
    """Raw runs with their features where present."""
    return raw.join(features.withColumnRenamed("run_id", "id"), "id", "left")
