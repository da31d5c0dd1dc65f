"""Fingerprints: one row of numbers and one share distribution per group of runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.functions import constants as K
from tidemark.operators import ranks

KINDS = ("sequence", "outcome", "bigram", "tool")


def value_counts(runs: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """How often each value of each whole-number column occurs: (by, metric, value, k)."""
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("long").alias("value")) for c in columns])
    return (
        runs.select(*by, F.explode(pairs).alias("__p"))
        .select(*by, "__p.metric", "__p.value")
        .where(F.col("value").isNotNull())
        .groupBy(*by, "metric", "value")
        .agg(F.count("*").alias("k"))
    )


def _moments(runs: DataFrame, by: Sequence[str]) -> DataFrame:
    return runs.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg("tool_call_count").alias("avg_tool_count"),
        F.avg("output_length").alias("avg_output_length"),
        F.avg("loop_count").alias("avg_loop_count"),
        F.avg("verbosity_ratio").alias("avg_verbosity_ratio"),
        F.avg("retry_count").alias("avg_retry_count"),
        F.avg("time_to_first_tool_ms").alias("avg_time_to_first_tool_ms"),
        F.avg("error_count").alias("error_rate"),
        F.avg("retry_count").alias("retry_rate"),
        (F.count_if(F.col("semantic_cluster") == "fallback") / F.count("*")).alias("fallback_rate"),
        F.min("started_at").alias("window_start"),
        F.max("started_at").alias("window_end"),
    )


def _percentiles(runs: DataFrame, by: Sequence[str]) -> DataFrame:
    counts = value_counts(runs, by, ["latency_ms", "loop_count"])
    ranked = ranks.running(counts, [*by, "metric"], "value", ["k"]).withColumn("n", F.col("all_k"))

    def at(metric: str, p: int) -> Column:
        rank = ranks.percent_rank(p)
        hit = (F.col("metric") == metric) & (F.col("cum_k") - F.col("k") <= rank) & (rank < F.col("cum_k"))
        return F.max(F.when(hit, F.col("value")))

    return ranked.groupBy(*by).agg(
        at("latency_ms", 50).alias("p50_latency_ms"),
        at("latency_ms", 95).alias("p95_latency_ms"),
        at("latency_ms", 99).alias("p99_latency_ms"),
        at("loop_count", 95).alias("p95_loop_count"),
    )


def fp_scalar(runs: DataFrame, by: Sequence[str] = tuple(K.GROUP)) -> DataFrame:
    """Counts, means, rates and floor-index percentiles per group."""
    return _moments(runs, by).join(_percentiles(runs, by), list(by))


def dist_entries(kinds: Sequence[str] = KINDS) -> Column:
    """Array of (kind, key) a run contributes to the share distributions."""
    entry = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    parts = []
    if "sequence" in kinds:
        parts.append(F.array(entry("sequence", C.sequence_key(F.col("tools")))))
    if "outcome" in kinds:
        parts.append(F.array(entry("outcome", F.coalesce(F.col("semantic_cluster"), F.lit("cluster_none")))))
    if "bigram" in kinds:
        parts.append(
            F.transform(
                C.bigrams(F.col("tools")), lambda p: entry("bigram", F.concat(p["head"], F.lit(" -> "), p["tail"]))
            )
        )
    if "tool" in kinds:
        parts.append(F.transform("tools", lambda t: entry("tool", t)))
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def fp_counts(runs: DataFrame, by: Sequence[str] = tuple(K.GROUP), kinds: Sequence[str] = KINDS) -> DataFrame:
    """Counts per (group, kind, key): one scan, one explode, one pre-aggregated shuffle."""
    return (
        runs.select(*by, F.explode(dist_entries(kinds)).alias("__e"))
        .select(*by, "__e.kind", "__e.key")
        .groupBy(*by, "kind", "key")
        .agg(F.count("*").alias("n"))
    )


def with_share(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Adds the share of each key. Totals come from an aggregation, so no group lands in one task."""
    totals = counts.groupBy(*by, "kind").agg(F.sum("n").alias("total"))
    return counts.join(totals, [*by, "kind"]).withColumn("share", F.col("n") / F.col("total"))


def fp_dist(runs: DataFrame, by: Sequence[str] = tuple(K.GROUP), kinds: Sequence[str] = KINDS) -> DataFrame:
    """Share distributions of tool sequences, outcomes, tool pairs and tools."""
    return with_share(fp_counts(runs, by, kinds), by).drop("total")


def top_sequences(runs: DataFrame, by: Sequence[str] = tuple(K.GROUP), k: int = 10) -> DataFrame:
    """The k most frequent tool sequences of each group."""
    dist = fp_dist(runs, by, ("sequence",))
    order = [F.col("n").desc(), F.col("key").asc()]
    w = Window.partitionBy(*by).orderBy(*order)
    return ranks.newest(dist, by, order, k, F.col("key")).withColumn("position", F.row_number().over(w))


def dominant(dist: DataFrame, by: Sequence[str], kind: str = "sequence") -> DataFrame:
    """Key with the largest share; ties go to the smaller key."""
    best = F.min(F.struct((-F.col("n")).alias("minus_n"), F.col("key"), F.col("share")))
    return dist.where(F.col("kind") == kind).groupBy(*by).agg(best.alias("b")).select(*by, "b.key", "b.share")


def versions(runs: DataFrame) -> DataFrame:
    """Runs per version."""
    name = F.coalesce(F.col("deployment_version"), F.lit("unknown")).alias("deployment_version")
    return runs.groupBy(name).agg(F.count("*").alias("run_count"))


def store_stats(runs: DataFrame) -> DataFrame:
    """Totals of the whole table. Versions are counted from their groups, not with a distinct set."""
    per = runs.groupBy("deployment_version").agg(
        F.count("*").alias("n"), F.min("started_at").alias("lo"), F.max("started_at").alias("hi")
    )
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_runs"),
        F.count("deployment_version").alias("version_count"),
        F.min("lo").alias("oldest"),
        F.max("hi").alias("newest"),
    )


def version_source_mix(runs: DataFrame, by: Sequence[str] = tuple(K.GROUP)) -> DataFrame:
    """Shares of runs whose version came from the calendar, is unknown, or was stated."""
    source = F.coalesce(F.col("version_source"), F.lit("unknown"))
    share = lambda test: F.count_if(test) / F.count("*")
    return runs.groupBy(*by).agg(
        F.count("*").alias("n"),
        share(source == "epoch").alias("epoch_share"),
        share(source == "unknown").alias("unknown_share"),
        share(source.isin("release", "tag", "env")).alias("confident_share"),
    )


def feature_status(raw: DataFrame, features: DataFrame, current_version: int = 1) -> DataFrame:
    """Health of the feature table: per-source counts, staleness and the spread of quality."""
    joined = raw.select(F.col("id").alias("run_id"), "version_source").join(features, "run_id", "left")
    version = F.col("feature_schema_version")
    totals = joined.agg(
        F.count("*").alias("runs"),
        F.count_if(F.col("version_source") == "release").alias("from_release"),
        F.count_if(F.col("version_source") == "unknown").alias("from_unknown"),
        F.count_if(version.isNull()).alias("missing"),
        F.count_if((version >= 0) & (version < current_version)).alias("stale"),
        F.count_if(version == -1).alias("failed"),
        F.count("run_quality").alias("scored"),
        F.min("run_quality").alias("min_quality"),
        F.max("run_quality").alias("max_quality"),
    ).withColumn("__one", F.lit(1))
    scaled = joined.where(F.col("run_quality").isNotNull()).select(
        F.lit(1).alias("__one"), F.round(F.col("run_quality") * 10000).cast("long").alias("q")
    )
    middle = ranks.floor_percentile(scaled, ["__one"], "q", {"m": F.expr("n div 2")})
    return totals.join(middle, "__one", "left").withColumn("mid_quality", F.col("m") / 10000).drop("__one", "m")


def text_status(blobs: DataFrame) -> DataFrame:
    """Count, stored characters and truncated rows by field, with a grand total."""
    return blobs.rollup("field").agg(
        F.count("*").alias("blob_rows"),
        F.sum(F.length("content")).alias("stored_chars"),
        F.count_if(F.col("truncated")).alias("truncated_rows"),
    ).withColumn("field", F.coalesce("field", F.lit("ALL")))


def cost_per_10k(
    runs: DataFrame, by: Sequence[str] = tuple(K.GROUP), prompt_rate: float = 2.50, completion_rate: float = 10.00
) -> DataFrame:
    """Average price of a run, times ten thousand."""
    prompt = F.avg(F.coalesce(F.col("prompt_tokens"), F.lit(0)))
    completion = F.avg(F.coalesce(F.col("completion_tokens"), F.lit(0)))
    cost = (prompt / 1e6 * prompt_rate + completion / 1e6 * completion_rate) * 10000
    return runs.groupBy(*by).agg(F.count("*").alias("n"), cost.alias("cost_10k"))


def run_metrics(runs: DataFrame, by: Sequence[str] = tuple(K.GROUP)) -> DataFrame:
    """Averages and rates for diagnosis; the error rate counts runs, not errors."""
    share = lambda test: F.count_if(test) / F.count("*")
    means = runs.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg("latency_ms").alias("avg_latency"),
        F.avg("prompt_tokens").alias("avg_prompt_tokens"),
        F.avg("completion_tokens").alias("avg_completion_tokens"),
        F.avg("loop_count").alias("avg_loop_count"),
        F.avg("retry_count").alias("avg_retry_count"),
        share(F.col("error_count") > 0).alias("error_rate"),
        share(F.col("semantic_cluster") == "escalated").alias("escalation_rate"),
        F.avg("tool_call_count").alias("avg_tool_count"),
    )
    rank = F.when(F.col("n") > 1, F.floor(F.col("n") * F.lit(0.95))).otherwise(F.lit(-1))
    p95 = ranks.floor_percentile(runs, by, "latency_ms", {"p95_latency": rank})
    return means.join(p95, list(by)).withColumn("p95_latency", F.coalesce("p95_latency", F.lit(0)))


def behaviour_signals(runs: DataFrame, by: Sequence[str] = ("session_id",)) -> DataFrame:
    """Eleven signals of how an agent behaves, whatever its tools are called."""
    share = lambda test: F.count_if(test) / F.count("*")
    means = runs.groupBy(*by).agg(
        F.count("*").alias("n"),
        share(F.col("error_count") > 0).alias("escalation_rate"),
        share(F.col("error_count") == 0).alias("resolution_rate"),
        F.avg("error_count").alias("error_rate"),
        share(F.col("retry_count") > 2).alias("fallback_rate"),
        F.avg("loop_count").alias("avg_loop_depth"),
        F.avg("tool_call_count").alias("avg_tool_count"),
        F.avg("output_length").alias("avg_output_length"),
        F.avg("verbosity_ratio").alias("avg_verbosity_ratio"),
        F.avg("retry_count").alias("avg_retry_rate"),
        F.coalesce(
            F.avg(F.when(F.col("time_to_first_tool_ms") > 0, F.col("time_to_first_tool_ms"))), F.lit(0.0)
        ).alias("avg_time_to_first_tool"),
    )
    counts = runs.where(F.col("latency_ms") > 0).groupBy(*by, "latency_ms").agg(F.count("*").alias("k"))
    p95 = ranks.interpolated_of_counts(counts, by, "latency_ms", 0.95, "avg_latency_p95")
    return means.join(p95, list(by), "left").withColumn("avg_latency_p95", F.coalesce("avg_latency_p95", F.lit(0.0)))


def collection_rate(runs: DataFrame, by: Sequence[str] = ("session_id",), target: int = 50) -> DataFrame:
    """Runs per day and the days left to a target; blank unless 1 to 30 days."""
    span = F.timestamp_diff("MICROSECOND", F.col("oldest"), F.col("newest")) / F.lit(86400e6)
    days = F.expr("cast((target - n) / runs_per_day as long)")
    return (
        runs.groupBy(*by)
        .agg(F.count("*").alias("n"), F.min("started_at").alias("oldest"), F.max("started_at").alias("newest"))
        .withColumn("target", F.lit(target))
        .withColumn("span", span)
        .withColumn("runs_per_day", F.when(F.col("span") > 0, F.col("n") / F.col("span")))
        .withColumn("d", days)
        .withColumn("days_left", F.when(F.col("d").between(1, 30), F.col("d")))
        .select(*by, "n", "runs_per_day", "days_left")
    )


def distinct_tools(runs: DataFrame, by: Sequence[str] = ("session_id",)) -> DataFrame:
    """Every tool name of an agent, one row each."""
    return runs.select(*by, F.explode("tools").alias("tool")).distinct()


def distinct_sequence_ratio(runs: DataFrame, by: Sequence[str] = tuple(K.GROUP)) -> DataFrame:
    """Different tool sequences over runs; distinct keys are counted from their groups."""
    per = runs.groupBy(*by, C.sequence_key(F.col("tools")).alias("key")).agg(F.count("*").alias("k"))
    return per.groupBy(*by).agg(F.sum("k").alias("n"), (F.count("*") / F.sum("k")).alias("distinct_ratio"))
