"""Reading, writing and merging tables of runs."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import columns as C
from tidemark.functions import constants as K
from tidemark.operators import select as S

RUNS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("external_id", T.StringType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("deployment_version", T.StringType()),
        T.StructField("version_source", T.StringType()),
        T.StructField("environment", T.StringType()),
        T.StructField("started_at", T.TimestampNTZType()),
        T.StructField("completed_at", T.TimestampNTZType()),
        T.StructField("tools", T.ArrayType(T.StringType())),
        T.StructField("tool_call_count", T.LongType()),
        T.StructField("latency_ms", T.LongType()),
        T.StructField("error_count", T.LongType()),
        T.StructField("retry_count", T.LongType()),
        T.StructField("loop_count", T.LongType()),
        T.StructField("time_to_first_tool_ms", T.LongType()),
        T.StructField("prompt_tokens", T.LongType()),
        T.StructField("completion_tokens", T.LongType()),
        T.StructField("verbosity_ratio", T.DoubleType()),
        T.StructField("output_length", T.LongType()),
        T.StructField("semantic_cluster", T.StringType()),
        T.StructField("raw_prompt", T.StringType()),
        T.StructField("raw_output", T.StringType()),
    ]
)

# Exports hold the tool list as JSON text and times as ISO text.
_EXPORT = T.StructType(
    [
        f if f.name not in ("tools", "started_at", "completed_at") else T.StructField(f.name, T.StringType())
        for f in RUNS.fields
        if f.name != "tools"
    ]
    + [T.StructField("tool_sequence", T.StringType())]
)


def read_runs(spark: SparkSession, path: str, fmt: str = "json", multiline: bool = True) -> DataFrame:
    """Runs from an export (JSON array or JSON lines) or from Parquet, with the fixed schema.

    ``multiline=False`` reads JSON lines, which Spark can split; an array file is read by one task.
    """
    if fmt == "parquet":
        return spark.read.schema(RUNS).parquet(path)
    raw = spark.read.schema(_EXPORT).option("multiLine", multiline).json(path)

    def utc(name: str) -> Column:
        """The time in UTC: an offset is applied, a time without one is UTC already, an unreadable one is null."""
        text = F.regexp_replace(F.trim(F.col(name)), "([+-][0-9]{2})([0-9]{2})$", "$1:$2")
        zoned = F.when(text.rlike("(Z|[+-][0-9]{2}:[0-9]{2})$"), text).otherwise(F.concat(text, F.lit("Z")))
        return F.convert_timezone(F.current_timezone(), F.lit("UTC"), zoned.try_cast("timestamp").cast("timestamp_ntz"))

    zero = lambda n: F.coalesce(F.col(n), F.lit(0))
    built = {
        "tools": C.parse_tools(F.col("tool_sequence")),
        "started_at": utc("started_at"),
        "completed_at": utc("completed_at"),
        "deployment_version": F.coalesce("deployment_version", F.lit("unknown")),
        "environment": F.coalesce("environment", F.lit("production")),
        "semantic_cluster": F.coalesce("semantic_cluster", F.lit("cluster_none")),
    }
    for f in RUNS.fields:
        if isinstance(f.dataType, (T.LongType, T.DoubleType)):
            built[f.name] = zero(f.name).cast(f.dataType)
    return raw.select(*[built.get(f.name, F.col(f.name)).alias(f.name) for f in RUNS.fields])


def write_runs(runs: DataFrame, path: str, version: str | None = None, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """All runs, or one version's, as Parquet partitioned by version or as a JSON export."""
    if version is not None:
        runs = runs.where(F.col("deployment_version") == version)
    if fmt == "json":
        text = runs.withColumn("tool_sequence", F.to_json("tools")).drop("tools")
        iso = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
        for c in ("started_at", "completed_at"):
            if c in text.columns:
                text = text.withColumn(c, F.date_format(c, iso))
        text.write.mode(mode).json(path)
    else:
        # Rows of a version meet in a few tasks (spread by id), so a version becomes few files.
        runs.repartition("deployment_version", F.pmod(F.xxhash64("id"), F.lit(16))).write.mode(mode).partitionBy(
            "deployment_version"
        ).parquet(path)


def list_runs(runs: DataFrame, path: str, fmt: str = "csv", offset: int = 0, limit: int = 50, **filters) -> None:
    """A page of a listing with the total count, as CSV or JSON."""
    chosen = S.filter_runs(runs, **filters)
    total = chosen.agg(F.count("*").alias("total_count"))
    page = S.page(chosen, offset, limit).withColumn("total_count", total.scalar())
    if "tools" in page.columns:
        page = page.withColumn("tools", F.to_json("tools"))
    writer = page.coalesce(1).write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.json(path)


def upsert_runs(existing: DataFrame, incoming: DataFrame, mode: str = "merge") -> DataFrame:
    """The table after an import: ``merge`` skips known ids, ``replace`` drops the imported versions
    first, ``no-merge`` appends."""
    if mode == "merge":
        fresh = incoming.join(existing.select("id"), "id", "left_anti")
        return existing.unionByName(fresh.select(existing.columns))
    if mode == "replace":
        replaced = incoming.select("deployment_version").distinct()
        return existing.join(replaced, "deployment_version", "left_anti").select(existing.columns).unionByName(
            incoming.select(existing.columns)
        )
    if mode == "no-merge":
        return existing.unionByName(incoming.select(existing.columns))
    raise ValueError(f"unknown mode: {mode}")


def import_runs(spark: SparkSession, incoming: DataFrame, path: str, mode: str = "merge") -> None:
    """Imports into a table partitioned by version; ``replace`` overwrites only the versions present."""
    if mode == "replace":
        incoming.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("deployment_version").parquet(path)
        return
    if mode == "merge":
        incoming = incoming.join(spark.read.parquet(path).select("id"), "id", "left_anti")
    incoming.write.mode("append").partitionBy("deployment_version").parquet(path)


def dedupe_external(existing: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Traces not yet stored, and the counts fetched / written / skipped per source."""
    key = ["source", "external_id"]
    known = existing.select(*key).distinct().withColumn("known", F.lit(True))
    marked = incoming.join(known, key, "left").withColumn("known", F.coalesce("known", F.lit(False)))
    counts = marked.groupBy("source").agg(
        F.count("*").alias("fetched"),
        F.count_if(~F.col("known")).alias("written"),
        F.count_if(F.col("known")).alias("skipped"),
    )
    return marked.where(~F.col("known")).drop("known"), counts


def incremental_since(traces: DataFrame, sync: DataFrame, as_of: datetime, lookback_days: int = 30) -> DataFrame:
    """Traces at or after the last sync of their (source, project); new sources look back 30 days."""
    default = S.ntz(as_of - timedelta(days=lookback_days))
    joined = traces.join(sync.select("source", "project", "last_sync_at"), ["source", "project"], "left")
    return joined.where(F.col("timestamp") >= F.coalesce("last_sync_at", default)).drop("last_sync_at")


def split_schema(legacy: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The wide table as raw facts and derived features."""
    has_error = F.col("error_count") > 0
    raw = legacy.select(
        "id",
        "external_id",
        "source",
        F.coalesce("ingestion_source", F.lit("decorator")).alias("ingestion_source"),
        "session_id",
        "deployment_version",
        F.coalesce("version_source", F.lit("epoch")).alias("version_source"),
        "environment",
        F.col("started_at").alias("timestamp"),
        F.col("raw_prompt").alias("input"),
        F.col("raw_output").alias("output"),
        "latency_ms",
        F.col("prompt_tokens").alias("tokens_prompt"),
        F.col("completion_tokens").alias("tokens_completion"),
        (F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens_total"),
        F.when(has_error, "error").otherwise("success").alias("raw_status"),
        F.lit(1).alias("raw_schema_version"),
    )
    features = legacy.select(
        F.col("id").alias("run_id"),
        F.lit(1).alias("feature_schema_version"),
        F.lit("migrated").alias("feature_source"),
        "tool_sequence",
        "tool_call_count",
        "semantic_cluster",
        "loop_count",
        "verbosity_ratio",
        "time_to_first_tool_ms",
        F.lit(0.0).alias("fallback_rate"),
        "retry_count",
        F.when(has_error, "trace_error").otherwise("ok").alias("error_classification"),
        F.col("task_input_hash").alias("input_hash"),
        F.col("output_structure_hash").alias("output_hash"),
        F.coalesce(F.length("raw_prompt"), F.lit(0)).alias("input_length"),
        "output_length",
        F.lit(0.0).alias("run_quality"),
    )
    return raw, features


def store_text(runs: DataFrame, limit: int = K.TEXT_LIMIT) -> DataFrame:
    """One row per run and text field: kept text, original length, hash of the kept text."""
    fields = F.array(
        F.struct(F.lit("input").alias("field"), F.col("input").alias("text")),
        F.struct(F.lit("output").alias("field"), F.col("output").alias("text")),
    )
    rows = runs.select(F.col("id").alias("run_id"), F.explode(fields).alias("f")).select("run_id", "f.field", "f.text")
    kept = F.substring("text", 1, limit)
    return rows.where(F.coalesce(F.col("text"), F.lit("")) != "").select(
        "run_id",
        "field",
        kept.alias("content"),
        F.length("text").alias("content_length"),
        F.sha2(kept, 256).alias("content_hash"),
        (F.length("text") > limit).alias("truncated"),
    )


def runs_with_text(runs: DataFrame, blobs: DataFrame) -> DataFrame:
    """Runs with their stored texts, one row per run and field."""
    return runs.join(blobs.withColumnRenamed("run_id", "id"), "id", "left")


# ---- fixed values: metric names (dimension, gauge suffix) ---------------------------------------
METRIC_NAMES = {
    "decision_drift": "decision",
    "latency": "latency",
    "error_rate": "error",
    "semantic_drift": "semantic",
    "tool_distribution": "tool_distribution",
    "verbosity_ratio": "verbosity",
    "loop_depth": "loop_depth",
    "output_length": "output_length",
    "tool_sequence": "tool_sequence",
    "retry_rate": "retry",
    "time_to_first_tool": "time_to_first_tool",
    "tool_sequence_transitions": "tool_sequence_transitions",
}


def drift_metrics(decided: DataFrame, prefix: str = "drift") -> DataFrame:
    """One gauge per pair and metric: composite, each dimension, verdict 0-3 and tier 1-3."""
    level = F.array_position(F.array(*[F.lit(v) for v in ("SHIP", "MONITOR", "REVIEW", "BLOCK")]), F.col("verdict")) - 1
    tier = F.substring("tier", 5, 1).cast("double")
    gauge = lambda name, value: F.struct(F.lit(f"{prefix}.{name}").alias("name"), value.cast("double").alias("value"))
    rows = F.array(
        gauge("composite", F.col("drift_score")),
        *[gauge(name, F.col(dim)) for dim, name in METRIC_NAMES.items()],
        gauge("verdict", F.coalesce(level, F.lit(-1))),
        gauge("confidence_tier", tier),
    )
    labels = F.create_map(
        F.lit("agent"), F.col("session_id"),
        F.lit("baseline_version"), F.col("baseline_version"),
        F.lit("current_version"), F.col("current_version"),
        F.lit("environment"), F.col("environment"),
        F.lit("verdict"), F.coalesce("verdict", F.lit("UNKNOWN")),
    )
    return decided.select(labels.alias("attributes"), F.explode(rows).alias("m")).select(
        "m.name", F.lit("gauge").alias("type"), "m.value", "attributes"
    )


def verdict_records(decided: DataFrame, as_of: datetime) -> DataFrame:
    """Rows for the verdict history; the id follows from the pair and the time."""
    return decided.select(
        F.md5(F.concat_ws("|", *K.PAIR, F.lit(as_of.isoformat()))).alias("verdict_id"),
        *K.PAIR,
        "drift_score",
        "verdict",
        "severity",
        "tier",
        S.ntz(as_of).alias("recorded_at"),
    )


def append_verdicts(decided: DataFrame, path: str, as_of: datetime) -> None:
    verdict_records(decided, as_of).write.mode("append").parquet(path)


def list_verdicts(history: DataFrame, limit: int = 50) -> DataFrame:
    return history.orderBy(F.col("recorded_at").desc(), F.col("verdict_id").desc()).limit(limit)
