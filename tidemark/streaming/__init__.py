"""Structured Streaming versions: imports, budgets, watching a version, windowed fingerprints."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions import constants as K
from tidemark.operators import budget as B
from tidemark.operators import compare as CM
from tidemark.operators import fingerprint as FP
from tidemark.operators import ranks
from tidemark.sources.runs import RUNS
from tidemark.streaming import state


def stream_runs(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """New Parquet files of runs as a stream. The checkpoint remembers which files were read, which is
    also the incremental import: nothing is fetched twice and nothing is dropped."""
    reader = spark.readStream.schema(RUNS)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def append_runs(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends the stream to a Parquet table exactly once (file sink with its own commit log)."""
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .partitionBy("deployment_version")
        .trigger(availableNow=True)
        .start()
    )


def stream_dedupe(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Each (source, external_id) once, with state kept only within the watermark."""
    timed = stream.withColumn("event_time", F.col("started_at").cast("timestamp"))
    return timed.withWatermark("event_time", late).dropDuplicatesWithinWatermark(["source", "external_id"])


def _micros(spark: SparkSession, interval: str) -> int:
    return spark.sql(f"select unix_micros(timestamp'1970-01-01 00:00:00Z' + interval {interval})").first()[0]


def stream_panes(stream: DataFrame, out: str, checkpoint: str, slide: str = "1 hour", every: str | None = None) -> StreamingQuery:
    """What windows are made of: after each batch, its runs counted by pane of length ``slide``, group and latency.

    A batch is added up before it is written and never reads earlier ones; a repeated batch replaces its folder. Runs
    without a start belong to no pane.
    """
    width = _micros(stream.sparkSession, slide)

    def handle(batch: DataFrame, batch_id: int) -> None:
        us = F.unix_micros(F.col("started_at").cast("timestamp"))
        counted = (
            batch.where(F.col("started_at").isNotNull())
            .groupBy((us - F.pmod(us, F.lit(width))).alias("pane"), *K.GROUP, "latency_ms")
            .agg(
                F.count("*").alias("k"), F.max(us).alias("newest"), F.sum("error_count").alias("errors"), F.count("error_count").alias("errors_k"),
                F.sum("output_length").alias("output"), F.count("output_length").alias("output_k"), F.count_if(F.col("semantic_cluster") == "escalated").alias("escalated"),
            )
        )
        counted.write.mode("overwrite").parquet(f"{out}/panes/batch={batch_id}")

    return _batches(stream, checkpoint, handle, every)


def windowed_fingerprints(spark: SparkSession, out: str, size: str = "24 hours", slide: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Fingerprint numbers per sliding window and group, exact, from the panes of ``stream_panes`` with the same ``slide``.

    A pane's counts are merged into the ``size`` / ``slide`` windows that cover it, so runs are counted once whatever the
    overlap, and the percentile is the one by rank over counts of values. A run that comes late is in its
    windows at the next reading. ``closed``: the window ends by the newest start minus ``late``, so later runs that are in time
    cannot change it; windows still open are told as well, so none is lost at the end of a stream.
    """
    length, width, grace = (_micros(spark, x) for x in (size, slide, late))
    if length % width:
        raise ValueError("size must be a multiple of slide")
    by = ["window_us", *K.GROUP]
    sums = ("k", "errors", "errors_k", "output", "output_k", "escalated")
    panes = spark.read.parquet(f"{out}/panes/batch=*")
    newest = panes.agg(F.max("newest")).first()[0]
    merged = panes.groupBy("pane", *K.GROUP, "latency_ms").agg(*(F.sum(c).alias(c) for c in sums))
    starts = F.explode(F.transform(F.sequence(F.lit(0), F.lit(length // width - 1)), lambda j: F.col("pane") - j * width))
    counts = merged.withColumn("window_us", starts).groupBy(*by, "latency_ms").agg(*(F.sum(c).alias(c) for c in sums))
    timed = counts.where(F.col("latency_ms").isNotNull())
    p95 = ranks.percentile_of_counts(timed.select(*by, "latency_ms", "k"), by, "latency_ms", {"p95_latency_ms": ranks.percent_rank(95)})
    numbers = counts.groupBy(*by).agg(
        F.sum("k").alias("n"),
        (F.sum(F.col("latency_ms") * F.col("k")) / F.sum(F.when(F.col("latency_ms").isNotNull(), F.col("k")))).alias("avg_latency_ms"),
        F.try_divide(F.sum("errors"), F.sum("errors_k")).alias("error_rate"),
        F.try_divide(F.sum("output"), F.sum("output_k")).alias("avg_output_length"),
        (F.sum("escalated") / F.sum("k")).alias("escalation_rate"),
    )
    end = F.col("window_us") + length
    return numbers.join(p95, by, "left").select(
        F.timestamp_micros("window_us").cast("timestamp_ntz").alias("window_start"), F.timestamp_micros(end).cast("timestamp_ntz").alias("window_end"), *K.GROUP,
        "n", "avg_latency_ms", "p95_latency_ms", "error_rate", "avg_output_length", "escalation_rate", (end <= F.lit(newest) - grace).alias("closed"),
    )


def _batches(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None], every: str | None = None) -> StreamingQuery:
    """Runs to the end of what there is and stops, or for good if ``every`` names an interval (which expiry of keys needs)."""
    return (
        stream.writeStream.foreachBatch(handle)
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(**({"processingTime": every} if every else {"availableNow": True}))
        .start()
    )


def stream_budgets(stream: DataFrame, limits: DataFrame, out: str, checkpoint: str, window: int = 10, min_n: int = 5, idle_ms: int | None = None, every: str | None = None) -> StreamingQuery:
    """After each batch, budgets of the touched (agent, version) keys from their newest ``window`` runs.

    The runs of a key are in the engine's state store, so a batch costs its own rows and the keys it touches, a restart
    goes on from the checkpoint, and keys that bring no run for ``idle_ms`` are forgotten. Results land in folders named by
    the batch id, which a repeated batch replaces: ``breaches`` and the ``touched`` keys.
    """
    measures = B._measures()
    slim = stream.select(*B.BY, "id", "started_at", *(m.cast("double").alias(k) for k, m in measures.items()))
    newest = state.newest_rows(slim, B.BY, list(measures), window, idle_ms)

    def handle(batch: DataFrame, batch_id: int) -> None:
        rolling = B.rolling_means(batch.groupBy(*B.BY).agg(F.count("*").alias("run_count"), *[F.avg(k).alias(k) for k in measures]), min_n)
        batch.select(*B.BY).distinct().withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/touched/batch={batch_id}")
        breaches = B.budget_breaches(rolling, limits)
        breaches.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/breaches/batch={batch_id}")

    return _batches(newest, checkpoint, handle, every)


def present_breaches(spark: SparkSession, out: str) -> DataFrame:
    """Breaches in force: those of the last batch that touched each key."""
    touched = spark.read.parquet(f"{out}/touched/batch=*").groupBy(*B.BY).agg(F.max("batch_id").alias("batch_id"))
    return spark.read.parquet(f"{out}/breaches/batch=*").join(touched, [*B.BY, "batch_id"], "left_semi").drop("batch_id")


LIVE = "__live__"
SCORES = T.StructType(
    [T.StructField(c, T.StringType()) for c in (*K.AGENT, "baseline_version")]
    + [T.StructField("score", T.DoubleType()), T.StructField("current_n", T.LongType()), T.StructField("batch_id", T.LongType())]
)


def watch(
    stream: DataFrame,
    baseline: DataFrame,
    out: str,
    checkpoint: str,
    last_n: int = 20,
    min_runs: int = 10,
    threshold: float = K.DRIFT_THRESHOLD,
    idle_ms: int | None = None,
    every: str | None = None,
) -> StreamingQuery:
    """After each batch, the newest runs of every touched agent against its baseline version.

    ``baseline``: runs of the versions watched against, one version per agent and environment. Its
    fingerprint is kept as a table, computed once. Scores that reach the threshold go to ``out``/scores; ``alerts``
    is the stream of those that differ from the agent's last one. The newest runs of each agent are in the engine's
    state store; nothing but the touched agents' is read or written.
    """
    fp = FP.fp_scalar(baseline)
    dist = FP.fp_dist(baseline)
    fp.write.mode("ignore").parquet(f"{out}/baseline_fp")
    dist.write.mode("ignore").parquet(f"{out}/baseline_dist")
    fp_schema, dist_schema = fp.schema, dist.schema
    measured = ["started_at", "tools", "tool_call_count", "latency_ms", "error_count", "retry_count", "loop_count", "time_to_first_tool_ms",
                "verbosity_ratio", "output_length", "semantic_cluster"]
    newest = state.newest_rows(stream, K.AGENT, measured, last_n, idle_ms)

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        recent = batch.withColumn("deployment_version", F.lit(LIVE))
        touched = batch.select(*K.AGENT).distinct()
        base_fp = spark.read.schema(fp_schema).parquet(f"{out}/baseline_fp")
        base_dist = spark.read.schema(dist_schema).parquet(f"{out}/baseline_dist")
        pairs = (
            base_fp.select(*K.AGENT, F.col("deployment_version").alias("baseline_version"))
            .join(touched, K.AGENT, "left_semi")
            .withColumn("current_version", F.lit(LIVE))
        )
        wide = CM.compared(base_fp.unionByName(FP.fp_scalar(recent)), base_dist.unionByName(FP.fp_dist(recent)), pairs)
        scored = CM.drift(wide).where((F.col("current_n") >= min_runs) & (F.col("drift_score") >= threshold))
        told = scored.select(*K.AGENT, "baseline_version", F.round("drift_score", 2).alias("score"), "current_n", F.lit(batch_id).cast("long").alias("batch_id"))
        told.write.mode("overwrite").parquet(f"{out}/scores/batch={batch_id}")
        batch.unpersist()

    return _batches(newest, checkpoint, handle, every)


def alerts(spark: SparkSession, out: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Of the scores that ``watch`` writes, those that differ (two digits) from the agent's last one, which the state store holds."""
    scores = spark.readStream.schema(SCORES).parquet(f"{out}/scores/batch=*")
    fresh = state.changed_scores(scores, K.AGENT)

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/alerts/told={batch_id}")

    return _batches(fresh, checkpoint, handle, every)


__all__ = ["alerts", "append_runs", "present_breaches", "stream_budgets", "stream_dedupe", "stream_panes", "stream_runs", "watch", "windowed_fingerprints"]
