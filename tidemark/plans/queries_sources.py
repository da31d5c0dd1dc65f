"""Sources, sinks, trace mapping, stored text and streaming."""

from __future__ import annotations

import re
import uuid
from datetime import datetime

from pyspark.sql import functions as F

from tidemark import streaming
from tidemark.functions import columns as C
from tidemark.functions import constants as K
from tidemark.operators import budget, fingerprint, select
from tidemark.plans import oracle as O
from tidemark.plans.oracle import G, r
from tidemark.plans.queries_compare import memo
from tidemark.plans.queries_fingerprint import BREACHES, limits
from tidemark.plans.registry import query, ts
from tidemark.sources import runs as runs_io
from tidemark.sources import traces as traces_io


def fresh(w, name):
    return f"{w.folder}/{name}-{uuid.uuid4().hex[:8]}"


# ---- runs as files -----------------------------------------------------------------------------
def full_runs(w):
    """Runs with every column of the runs schema."""
    missing = {"source": F.lit("export"), "external_id": F.col("id"), "raw_prompt": F.lit(""), "raw_output": F.lit("")}
    return w.runs.select(*[missing.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in runs_io.RUNS.fields])


def written(w, fmt, version=None):
    path = fresh(w, f"runs_{fmt}")
    runs_io.write_runs(full_runs(w), path, version, fmt)
    return path


RUN_FACTS = f"SELECT id, {G}, {ts('started_at')} AS started_at, len(tools) AS n_tools, latency_ms, {r('verbosity_ratio')} AS verbosity_ratio FROM x_runs"


def facts(df):
    return df.select("id", *K.GROUP, "started_at", F.size("tools").alias("n_tools"), "latency_ms", "verbosity_ratio")


query("s1_read_runs_json", RUN_FACTS)(lambda w: facts(runs_io.read_runs(w.spark, written(w, "json"), multiline=False)))
query("s2_write_runs_parquet", RUN_FACTS)(lambda w: facts(runs_io.read_runs(w.spark, written(w, "parquet"), "parquet")))
query("s2_write_one_version", f"SELECT id, {G} FROM x_runs WHERE deployment_version='v2'")(
    lambda w: runs_io.read_runs(w.spark, written(w, "json", "v2"), multiline=False).select("id", *K.GROUP)
)


def listing(w):
    path = fresh(w, "listing")
    runs_io.list_runs(w.runs, path, "csv", 10, 40, env="production")
    return w.spark.read.option("header", True).csv(path).select("id", "session_id", F.col("total_count").cast("long").alias("total_count"))


query(
    "s3_list_runs_csv",
    "SELECT id, session_id, (SELECT count(*) FROM x_runs WHERE environment='production') AS total_count FROM x_runs WHERE environment='production' ORDER BY started_at DESC, id DESC LIMIT 40 OFFSET 10",
)(listing)

# The import used below: every run of v2 and v3; the table already holds v1 and the runs of v2 on even hours.
HELD = "deployment_version = 'v1' or (deployment_version = 'v2' and hour(started_at) % 2 = 0)"
HELD_SQL = "(deployment_version='v1' OR (deployment_version='v2' AND hour(started_at)%2=0))"
COMING = "deployment_version in ('v2', 'v3')"
COMING_SQL = "deployment_version IN ('v2','v3')"
UPSERTS = {
    "merge": f"SELECT id, deployment_version FROM x_runs WHERE {HELD_SQL} OR {COMING_SQL}",
    "replace": f"SELECT id, deployment_version FROM x_runs WHERE deployment_version='v1' OR {COMING_SQL}",
    "no-merge": f"SELECT id, deployment_version FROM x_runs WHERE {HELD_SQL} UNION ALL SELECT id, deployment_version FROM x_runs WHERE {COMING_SQL}",
}
for mode, text in UPSERTS.items():
    query(f"s6_upsert_{mode.replace('-', '_')}", text)(
        lambda w, mode=mode: runs_io.upsert_runs(w.runs.where(HELD), w.runs.where(COMING), mode).select("id", "deployment_version")
    )


def replaced(w):
    """A version-partitioned table after an import that replaces the versions it brings."""
    path = fresh(w, "imported")
    full_runs(w).where(HELD).write.partitionBy("deployment_version").parquet(path)
    runs_io.import_runs(w.spark, full_runs(w).where(COMING), path, "replace")
    return runs_io.read_runs(w.spark, path, "parquet").select("id", "deployment_version")


query("s6_import_replace", UPSERTS["replace"])(replaced)


def external(df):
    return df.withColumn("source", F.concat(F.lit("src-"), F.col("session_id"))).withColumn("external_id", F.col("id"))


query(
    "s7_dedupe_external",
    f"""SELECT 'src-'||session_id AS source, count(*) AS fetched, count(*) FILTER (NOT {HELD_SQL}) AS written, count(*) FILTER ({HELD_SQL}) AS skipped FROM x_runs WHERE {COMING_SQL} GROUP BY 1""",
)(lambda w: runs_io.dedupe_external(external(w.runs.where(HELD)), external(w.runs.where(COMING)))[1])
query("x2_new_rows_only", f"SELECT id FROM x_runs WHERE {COMING_SQL} AND NOT {HELD_SQL}")(
    lambda w: runs_io.dedupe_external(external(w.runs.where(HELD)), external(w.runs.where(COMING)))[0].select("id")
)
query(
    "s8_incremental_since",
    """SELECT id, session_id FROM x_runs r LEFT JOIN (SELECT session_id AS s, max(started_at)-INTERVAL 2 DAY AS last_sync_at FROM x_runs WHERE session_id<>'agent-3' GROUP BY 1) y ON y.s=r.session_id
    WHERE started_at >= coalesce(last_sync_at, TIMESTAMP '2024-02-10' - INTERVAL 30 DAY)""",
)(
    lambda w: runs_io.incremental_since(
        w.runs.select("id", "session_id", F.col("session_id").alias("project"), F.lit("a").alias("source"), F.col("started_at").alias("timestamp")),
        w.runs.where("session_id <> 'agent-3'").groupBy(F.col("session_id").alias("project")).agg(
            F.lit("a").alias("source"), (F.max("started_at") - F.expr("interval 2 days")).alias("last_sync_at")
        ),
        datetime(2024, 2, 10),
    ).select("id", "session_id")
)


def legacy(w):
    """The wide table: runs with texts from documents where the run number meets a document number."""
    return w.runs.select(
        "id",
        F.col("id").alias("external_id"),
        F.lit("old").alias("source"),
        F.when(F.col("tool_call_count") > 2, "connector").alias("ingestion_source"),
        "session_id",
        "deployment_version",
        F.when(F.col("version_source") == "release", "release").alias("version_source"),
        "environment",
        "started_at",
        F.when(F.col("latency_ms") % 2 == 0, F.concat(F.lit("ask "), F.col("id"))).alias("raw_prompt"),
        F.concat(F.lit("answer "), F.col("session_id")).alias("raw_output"),
        "latency_ms",
        F.when(F.col("prompt_tokens") % 3 > 0, F.col("prompt_tokens")).alias("prompt_tokens"),
        "completion_tokens",
        "error_count",
        F.to_json("tools").alias("tool_sequence"),
        "tool_call_count",
        "semantic_cluster",
        "loop_count",
        "verbosity_ratio",
        "time_to_first_tool_ms",
        "retry_count",
        "output_length",
        C.text_hash(F.col("id")).alias("task_input_hash"),
        C.text_hash(F.col("session_id")).alias("output_structure_hash"),
    )


query(
    "s9_split_schema_raw",
    f"""SELECT id, coalesce(CASE WHEN tool_call_count>2 THEN 'connector' END, 'decorator') AS ingestion_source, coalesce(CASE WHEN version_source='release' THEN 'release' END, 'epoch') AS version_source,
    {ts('started_at')} AS "timestamp", CASE WHEN latency_ms%2=0 THEN 'ask '||id END AS input, 'answer '||session_id AS output,
    CASE WHEN prompt_tokens%3>0 THEN prompt_tokens+completion_tokens END AS tokens_total, CASE WHEN error_count>0 THEN 'error' ELSE 'success' END AS raw_status, 1 AS raw_schema_version FROM x_runs""",
)(
    lambda w: runs_io.split_schema(legacy(w))[0].select(
        "id", "ingestion_source", "version_source", "timestamp", "input", "output", "tokens_total", "raw_status", "raw_schema_version"
    )
)
query(
    "s9_split_schema_features",
    """SELECT id AS run_id, 'migrated' AS feature_source, CAST(to_json(tools) AS VARCHAR) AS tool_sequence, CASE WHEN error_count>0 THEN 'trace_error' ELSE 'ok' END AS error_classification,
    substr(sha256(id), 1, 16) AS input_hash, substr(sha256(session_id), 1, 16) AS output_hash, CASE WHEN latency_ms%2=0 THEN length('ask '||id) ELSE 0 END AS input_length, output_length FROM x_runs""",
)(
    lambda w: runs_io.split_schema(legacy(w))[1].select(
        "run_id", "feature_source", "tool_sequence", "error_classification", "input_hash", "output_hash", "input_length", "output_length"
    )
)


# ---- texts -------------------------------------------------------------------------------------
def raw_documents(w):
    """Raw runs from documents: the text is the output, the source and language the input."""
    return w.table("documents").select(
        F.col("doc_id").cast("string").alias("id"),
        F.col("source").alias("session_id"),
        F.when(F.col("doc_id") % 4 == 0, "release").when(F.col("doc_id") % 4 == 1, "env").when(F.col("doc_id") % 4 == 2, "epoch").alias("version_source"),
        F.when(F.col("doc_id") % 3 > 0, F.concat_ws(" ", "source", "lang")).alias("input"),
        F.when(F.col("doc_id") % 7 > 0, F.col("text")).alias("output"),
        F.col("n_chars").alias("latency_ms"),
        F.length(F.concat_ws(" ", "source", "lang")).cast("long").alias("tokens_prompt"),
        F.col("n_chars").alias("tokens_completion"),
        F.when(F.col("doc_id") % 11 == 0, "error").otherwise("success").alias("raw_status"),
        F.when(F.col("doc_id") % 13 == 0, "timeout").alias("raw_error_message"),
    )


O.CTES["x_raw"] = """SELECT CAST(doc_id AS VARCHAR) AS id, doc_id, source AS session_id, CASE doc_id%4 WHEN 0 THEN 'release' WHEN 1 THEN 'env' WHEN 2 THEN 'epoch' END AS version_source,
    CASE WHEN doc_id%3>0 THEN source||' '||lang END AS input, CASE WHEN doc_id%7>0 THEN text END AS output, n_chars AS latency_ms, length(source||' '||lang) AS tokens_prompt, n_chars AS tokens_completion,
    doc_id%11=0 OR doc_id%13=0 AS is_error FROM documents"""
WORDS = " OR ".join("contains(lower(output), '" + x.replace("'", "''") + "')" for x in K.ESCALATION_WORDS)
O.CTES["x_outcome"] = f"SELECT *, CASE WHEN is_error THEN 'error' WHEN coalesce(output,'')='' THEN 'unknown' WHEN {WORDS} THEN 'escalated' ELSE 'resolved' END AS outcome FROM x_raw"
query("p10_outcome", "SELECT id, outcome FROM x_outcome")(
    lambda w: raw_documents(w).select(
        "id", C.outcome(F.col("output"), (F.col("raw_status") == "error") | F.col("raw_error_message").isNotNull()).alias("outcome")
    )
)
query("p11_text_hash", "SELECT doc_id, substr(sha256(coalesce(text,'')), 1, 16) AS hash FROM documents")(
    lambda w: w.table("documents").select("doc_id", C.text_hash(F.col("text")).alias("hash"))
)
LIMIT = 500
O.CTES["x_blobs"] = f"""SELECT id AS run_id, field, substr(text, 1, {LIMIT}) AS content, length(text) AS content_length, sha256(substr(text, 1, {LIMIT})) AS content_hash, length(text)>{LIMIT} AS truncated FROM (
    SELECT id, 'input' AS field, input AS text FROM x_raw UNION ALL SELECT id, 'output', output FROM x_raw) WHERE coalesce(text,'')<>''"""
query("s10_store_text", "SELECT run_id, field, content_length, content_hash, truncated, length(content) AS kept FROM x_blobs")(
    lambda w: runs_io.store_text(raw_documents(w), LIMIT).withColumn("kept", F.length("content")).drop("content")
)
query("s10_store_text_default", "SELECT id AS run_id, 'output' AS field, length(output) AS content_length, sha256(output) AS content_hash FROM x_raw WHERE coalesce(output,'')<>''")(
    lambda w: runs_io.store_text(raw_documents(w)).where("field = 'output'").select("run_id", "field", "content_length", "content_hash")
)
query(
    "a13_text_status",
    "SELECT coalesce(field,'ALL') AS field, count(*) AS blob_rows, CAST(sum(length(content)) AS BIGINT) AS stored_chars, count(*) FILTER (truncated) AS truncated_rows FROM x_blobs GROUP BY ROLLUP(field)",
)(lambda w: fingerprint.text_status(runs_io.store_text(raw_documents(w), LIMIT)))
query("f9_orphan_text", "SELECT run_id, field FROM x_blobs WHERE CAST(run_id AS BIGINT)%5=0")(
    lambda w: select.orphan_text(runs_io.store_text(raw_documents(w), LIMIT), raw_documents(w).where(F.col("id").cast("long") % 5 > 0)).select("run_id", "field")
)
query("j12_runs_with_text", "SELECT r.id, b.field, b.content_length FROM x_raw r LEFT JOIN x_blobs b ON b.run_id=r.id")(
    lambda w: runs_io.runs_with_text(raw_documents(w).select("id"), runs_io.store_text(raw_documents(w), LIMIT)).select("id", "field", "content_length")
)
CLARITY = "CASE version_source WHEN 'release' THEN 1.0 WHEN 'env' THEN 0.7 WHEN 'epoch' THEN 0.3 ELSE 0.0 END"
COMPLETE = """least(1.0, (CASE WHEN trim(coalesce(input,''))<>'' THEN 0.25 ELSE 0 END)+(CASE WHEN trim(coalesce(output,''))<>'' THEN 0.25 ELSE 0 END)+(CASE WHEN latency_ms>0 THEN 0.2 ELSE 0 END)
    +(CASE WHEN tokens_prompt>0 OR tokens_completion>0 THEN 0.15 ELSE 0 END)+(CASE WHEN trim(coalesce(session_id,''))<>'' THEN 0.15 ELSE 0 END))"""
RICH = "(CASE WHEN outcome<>'unknown' THEN 0.2 ELSE 0 END)"
O.CTES["x_derived"] = f"""SELECT id AS run_id, outcome AS semantic_cluster, CASE WHEN tokens_prompt>0 THEN tokens_completion/tokens_prompt ELSE 0.0 END AS verbosity_ratio, CASE WHEN is_error THEN 'trace_error' ELSE 'ok' END AS error_classification,
    substr(sha256(coalesce(input,'')),1,16) AS input_hash, substr(sha256(coalesce(output,'')),1,16) AS output_hash, length(coalesce(input,'')) AS input_length, length(coalesce(output,'')) AS output_length,
    round(CAST(0.25*({CLARITY}+{COMPLETE}+1.0+{RICH}) AS DOUBLE), 4) AS run_quality, doc_id FROM x_outcome"""
query(
    "p13_derive_features",
    f"SELECT run_id, semantic_cluster, {r('verbosity_ratio')} AS verbosity_ratio, error_classification, input_hash, output_hash, input_length, output_length FROM x_derived",
)(
    lambda w: traces_io.derive_features(raw_documents(w)).select(
        "run_id", "semantic_cluster", "verbosity_ratio", "error_classification", "input_hash", "output_hash", "input_length", "output_length"
    )
)
query("p14_run_quality", f"SELECT run_id, {r('run_quality', 3)} AS run_quality FROM x_derived")(
    lambda w: traces_io.derive_features(raw_documents(w)).select("run_id", (F.round(F.col("run_quality") + 1e-10, 3)).alias("run_quality"))
)


def stored_features(w):
    """Half of the features: current for even documents, stale for some, failed for others."""
    number = F.col("run_id").cast("long")
    return (
        traces_io.derive_features(raw_documents(w))
        .where(number % 2 == 0)
        .withColumn("feature_schema_version", F.when(number % 10 == 0, 0).when(number % 14 == 0, -1).otherwise(1))
        .withColumn("feature_source", F.lit("stored"))
    )


query(
    "p15_features_current",
    "SELECT run_id, CASE WHEN doc_id%2=0 AND doc_id%10<>0 THEN 'stored' ELSE 'derived' END AS feature_source, CASE WHEN doc_id%2=0 AND doc_id%10<>0 AND doc_id%14=0 THEN -1 ELSE 1 END AS feature_schema_version, semantic_cluster FROM x_derived",
)(
    lambda w: traces_io.features_current(raw_documents(w), stored_features(w)).select(
        "run_id", "feature_source", "feature_schema_version", "semantic_cluster"
    )
)
query("j1_raw_with_features", "SELECT r.id, CASE WHEN r.doc_id%2=0 THEN 'stored' END AS feature_source FROM x_raw r")(
    lambda w: traces_io.raw_with_features(raw_documents(w), stored_features(w)).select("id", "feature_source")
)
query(
    "a12_feature_status",
    f"""SELECT count(*) AS runs, count(*) FILTER (version_source='release') AS from_release, count(*) FILTER (version_source='unknown') AS from_unknown, count(*) FILTER (d.doc_id%2=1) AS missing,
    count(*) FILTER (d.doc_id%10=0) AS stale, count(*) FILTER (d.doc_id%2=0 AND d.doc_id%10<>0 AND d.doc_id%14=0) AS failed, count(*) FILTER (d.doc_id%2=0) AS scored,
    {r('min(run_quality) FILTER (d.doc_id%2=0)')} AS min_quality, {r('max(run_quality) FILTER (d.doc_id%2=0)')} AS max_quality,
    {r("(list_sort(list(run_quality) FILTER (d.doc_id%2=0)))[CAST((count(*) FILTER (d.doc_id%2=0))//2 AS BIGINT)+1]")} AS mid_quality FROM x_derived d JOIN x_raw r ON r.id=d.run_id""",
)(lambda w: fingerprint.feature_status(raw_documents(w), stored_features(w)))

# ---- traces ------------------------------------------------------------------------------------
O.CTES["x_obs"] = """SELECT CAST(conv_id AS VARCHAR) AS trace_id, conv_id||'-'||turn AS id, CASE WHEN turn=0 THEN NULL WHEN turn%2=1 THEN conv_id||'-'||(turn-1) ELSE conv_id||'-0' END AS parent_id, turn AS position,
    CASE role WHEN 'assistant' THEN 'generation' WHEN 'user' THEN 'span' ELSE 'event' END AS type, role AS name,
    TIMESTAMP '2024-01-01' + to_hours(CAST(conv_id AS INT)) + to_seconds(turn*3) AS start_time, TIMESTAMP '2024-01-01' + to_hours(CAST(conv_id AS INT)) + to_seconds(turn*3+1) AS end_time,
    CASE WHEN role='user' THEN length(text) ELSE 0 END AS usage_input, CASE WHEN role='assistant' THEN length(text) ELSE 0 END AS usage_output, CASE WHEN length(text)<20 THEN 'ERROR' ELSE 'DEFAULT' END AS level FROM conversations"""
O.CTES["x_traces"] = """SELECT CAST(conv_id AS VARCHAR) AS trace_id, conv_id, CASE WHEN conv_id%5=0 THEN 'r'||(conv_id%3) END AS release, CASE WHEN conv_id%5=1 THEN 't1' END AS version, CASE WHEN conv_id%5=2 THEN 'm1' END AS meta,
    CASE WHEN conv_id%4=0 THEN 'staging' END AS meta_environment, CASE WHEN conv_id%6=0 THEN conv_id*10 END AS meta_latency_ms, CASE WHEN conv_id%11=0 THEN true END AS meta_error,
    TIMESTAMP '2024-01-01' + to_hours(CAST(conv_id AS INT)) AS ts0, CASE WHEN conv_id%6=1 THEN conv_id*7 END AS latency, 'session-'||(conv_id%3) AS session_id,
    arg_max(text, turn) FILTER (role='assistant') AS output, arg_min(text, turn) FILTER (role='user') AS input FROM conversations GROUP BY conv_id"""
# A node's place in pre-order: its even ancestor at depth one (by turn), then itself.
O.CTES["x_tree"] = """SELECT trace_id, list(name ORDER BY CASE WHEN o.position=0 OR p.id IS NULL AND o.position>0 AND q.id IS NULL AND o.parent_id IS NOT NULL THEN o.position WHEN o.position%2=1 THEN o.position-1 ELSE o.position END, o.position) AS tree_tools
    FROM x_obs o LEFT JOIN (SELECT id FROM x_obs) p ON p.id=o.parent_id LEFT JOIN (SELECT id FROM x_obs) q ON q.id=o.id||'?' WHERE type IN ('generation','span') AND lower(name) NOT IN ('llm','chain','agent','root','trace','trace_root') AND NOT starts_with(lower(name), 'llm') GROUP BY trace_id"""
O.CTES["x_summary"] = """SELECT trace_id, coalesce(list(name ORDER BY position) FILTER (type='generation'), []) AS direct, count(*) FILTER (type IN ('generation','span')) AS steps, min(start_time) FILTER (type='generation') AS first_tool_at,
    max(end_time) AS last_end, CAST(sum(usage_input) AS BIGINT) AS prompt_tokens, CAST(sum(usage_output) AS BIGINT) AS completion_tokens, bool_or(level='ERROR') AS any_error FROM x_obs GROUP BY trace_id"""
OUT_WORDS = WORDS
O.CTES["x_mapped"] = f"""SELECT t.*, s.*, CASE WHEN release IS NOT NULL THEN release WHEN version IS NOT NULL THEN version WHEN meta IS NOT NULL THEN meta ELSE 'epoch-'||strftime(date_trunc('week', ts0), '%Y-%m-%d') END AS deployment_version,
    CASE WHEN release IS NOT NULL THEN 'release' WHEN version IS NOT NULL OR meta IS NOT NULL THEN 'tag' ELSE 'epoch' END AS version_source,
    list_concat(s.direct, list_filter(coalesce(tree_tools, []), lambda x, i: list_position(tree_tools, x)=i AND NOT list_contains(s.direct, x))) AS merged, coalesce(meta_error, contains(coalesce(output,''), 'Error:') OR any_error) AS is_error,
    CASE WHEN coalesce(meta_latency_ms, latency, 0)=0 THEN date_diff('millisecond', ts0, last_end) ELSE coalesce(meta_latency_ms, latency) END AS latency_ms
    FROM x_traces t JOIN x_summary s USING (trace_id) LEFT JOIN x_tree USING (trace_id)"""


@memo("trace_runs")
def trace_runs(w):
    traces, observations = w.traces
    return traces_io.runs_from_traces(traces, observations)


query(
    "s4_runs_from_traces",
    f"""SELECT trace_id AS external_id, session_id, deployment_version, version_source, coalesce(meta_environment,'production') AS environment, {ts('ts0')} AS started_at, latency_ms, prompt_tokens, completion_tokens,
    CASE WHEN is_error THEN 1 ELSE 0 END AS error_count, len(merged) AS tool_call_count, greatest(1, steps) AS loop_count,
    CASE WHEN is_error THEN 'error' WHEN coalesce(output,'')='' THEN 'unknown' WHEN {OUT_WORDS} THEN 'escalated' ELSE 'resolved' END AS semantic_cluster, length(coalesce(output,'')) AS output_length FROM x_mapped""",
)(
    lambda w: traces_io.runs_from_traces(*w.traces).select(
        "external_id", "session_id", "deployment_version", "version_source", "environment", "started_at", "latency_ms", "prompt_tokens", "completion_tokens",
        "error_count", "tool_call_count", "loop_count", "semantic_cluster", "output_length",
    )
)
query("p1_resolve_version", "SELECT trace_id, deployment_version, version_source FROM x_mapped")(
    lambda w: w.traces[0].select(
        "trace_id", *[c.alias(n) for c, n in zip(traces_io.version_columns(), ("deployment_version", "version_source"), strict=True)]
    )
)
query("p2_latency_ms", f"SELECT trace_id, latency_ms, {ts('last_end')} AS completed_at FROM x_mapped")(
    lambda w: trace_runs(w).select(F.col("external_id").alias("trace_id"), "latency_ms", "completed_at")
)
query("p3_tool_sequence", "SELECT trace_id, array_to_string(merged, '>') AS tools FROM x_mapped")(
    lambda w: trace_runs(w).select(F.col("external_id").alias("trace_id"), F.array_join("tools", ">").alias("tools"))
)
query("p4_tree_tools", "SELECT trace_id, array_to_string(tree_tools, '>') AS tools FROM x_tree")(
    lambda w: traces_io.tree_tools(w.traces[1]).select("trace_id", F.array_join("tree_tools", ">").alias("tools"))
)
query(
    "p5_trace_retries",
    "SELECT trace_id, CAST(len(list_filter(range(2, len(direct)+1), lambda i: direct[i]=direct[i-1])) AS BIGINT) AS retry_count FROM x_summary",
)(lambda w: traces_io.observation_summary(w.traces[1]).select("trace_id", "retry_count"))
query("p6_loop_count", "SELECT trace_id, greatest(1, steps) AS loop_count FROM x_summary")(
    lambda w: trace_runs(w).select(F.col("external_id").alias("trace_id"), "loop_count")
)
query("p7_time_to_first_tool", "SELECT trace_id, greatest(0, coalesce(date_diff('millisecond', ts0, first_tool_at), 0)) AS ms FROM x_mapped")(
    lambda w: trace_runs(w).select(F.col("external_id").alias("trace_id"), F.col("time_to_first_tool_ms").alias("ms"))
)
query("p8_token_sums", "SELECT trace_id, prompt_tokens, completion_tokens FROM x_summary")(
    lambda w: traces_io.observation_summary(w.traces[1]).select("trace_id", "prompt_tokens", "completion_tokens")
)
query("p9_is_error", "SELECT trace_id, CASE WHEN is_error THEN 1 ELSE 0 END AS error_count FROM x_mapped")(
    lambda w: trace_runs(w).select(F.col("external_id").alias("trace_id"), "error_count")
)


def nested_runs(w):
    """The second trace format: one root row per conversation, its turns as child rows."""
    traces, observations = w.traces
    none = F.lit(None).cast("string")
    roots = traces.select(
        "trace_id",
        F.concat(F.lit("root-"), F.col("trace_id")).alias("id"),
        none.alias("parent_run_id"),
        F.lit(0).cast("long").alias("position"),
        F.lit("chain").alias("run_type"),
        F.concat(F.lit("run-"), F.col("session_id")).alias("name"),
        F.col("timestamp").alias("start_time"),
        none.cast("timestamp_ntz").alias("end_time"),
        (F.coalesce("latency", F.lit(1.0)) / 4).alias("latency"),
        F.col("version").alias("meta_version"),
        F.col("meta_deployment_version"),
        F.col("meta_environment"),
        F.when(F.col("meta_error"), "failed").alias("error"),
        F.length(F.coalesce("input", F.lit(""))).cast("long").alias("prompt_tokens"),
        F.length(F.coalesce("output", F.lit(""))).cast("long").alias("completion_tokens"),
        F.col("session_id"),
        "input",
        "output",
    )
    kind = F.when(F.col("name") == "assistant", "tool").when(F.col("name") == "user", "chain").otherwise("llm")
    children = observations.select(
        "trace_id", "id", F.coalesce("parent_id", F.concat(F.lit("root-"), F.col("trace_id"))).alias("parent_run_id"), "position",
        kind.alias("run_type"), F.concat(F.lit("t-"), F.col("name")).alias("name"), "start_time", "end_time",
    )
    return roots.unionByName(children, allowMissingColumns=True)


query(
    "s5_runs_from_nested_traces",
    f"""SELECT 'root-'||t.trace_id AS external_id, t.session_id, coalesce(version, meta, 'run-'||t.session_id) AS deployment_version, coalesce(meta_environment,'production') AS environment, {ts('ts0')} AS started_at,
    CAST(trunc(coalesce(latency, 1.0)/4*1000) AS BIGINT) AS latency_ms, CASE WHEN meta_error THEN 1 ELSE 0 END AS error_count, tools AS tool_call_count, greatest(1, loops) AS loop_count, retries AS retry_count,
    CASE WHEN meta_error THEN 'error' WHEN coalesce(output,'')='' THEN 'unknown' WHEN {OUT_WORDS} THEN 'escalated' ELSE 'resolved' END AS semantic_cluster
    FROM x_traces t JOIN (SELECT trace_id, count(*) FILTER (name='assistant') AS tools, count(*) FILTER (name<>'assistant') AS loops, greatest(count(*) FILTER (name='assistant')-1, 0) AS retries FROM x_obs GROUP BY trace_id) USING (trace_id)""",
)(
    lambda w: traces_io.runs_from_traces(nested_runs(w), None, "B").select(
        "external_id", "session_id", "deployment_version", "environment", "started_at", "latency_ms", "error_count", "tool_call_count", "loop_count", "retry_count", "semantic_cluster"
    )
)


# ---- streams -----------------------------------------------------------------------------------
def stream_source(w):
    """The runs as a folder of files, with some rows twice."""
    if not hasattr(w, "_stream_source"):
        path = fresh(w, "stream_in")
        doubled = full_runs(w).unionByName(full_runs(w).where(F.col("latency_ms") % 3 == 0))
        # Four files by time, so that a stream of single files has four batches.
        doubled.repartitionByRange(4, "started_at").sortWithinPartitions("started_at").write.parquet(path)
        w._stream_source = path
    return w._stream_source


def drained(w, name, start):
    """Runs a stream to the end of its input; returns the folder it wrote to."""
    out = fresh(w, name)
    start(out, f"{out}-checkpoint").awaitTermination()
    return out


def stream_append(w):
    out = drained(w, "r1", lambda o, c: streaming.append_runs(streaming.stream_runs(w.spark, stream_source(w)), o, c))
    return w.spark.read.parquet(out).groupBy("deployment_version").agg(F.count("*").alias("n"))


query(
    "r1_stream_runs",
    "SELECT deployment_version, count(*)+count(*) FILTER (latency_ms%3=0) AS n FROM x_runs GROUP BY 1",
)(stream_append)


def stream_unique(w):
    unique = streaming.stream_dedupe(streaming.stream_runs(w.spark, stream_source(w), 1), "40 days").drop("event_time")
    out = drained(w, "r2", lambda o, c: streaming.append_runs(unique, o, c))
    return w.spark.read.parquet(out).groupBy("deployment_version").agg(F.count("*").alias("n"))


query("r2_stream_dedupe", "SELECT deployment_version, count(*) AS n FROM x_runs GROUP BY 1")(stream_unique)


DROP_DAYS = 12
"""Days of runs that arrive together in the drops of ``arriving``."""


def arriving(w, name, start):
    """Runs arrive in drops of some days, and after each the streams are started anew from their checkpoint, run to the end of
    what there is, and stop. Returns the folder they wrote to."""
    out, source = fresh(w, name), fresh(w, f"{name}-in")
    doubled = full_runs(w).unionByName(full_runs(w).where(F.col("latency_ms") % 3 == 0))
    dropped = w.keep(doubled.withColumn("drop", F.expr(f"datediff(started_at, date'2024-01-01') div {DROP_DAYS}")), "drops")
    last = dropped.agg(F.max("drop")).first()[0]
    for k in range(0 if last is None else last + 1):
        dropped.where(F.col("drop") == k).drop("drop").write.mode("append").parquet(source)
        for step in start(streaming.stream_runs(w.spark, source), out):
            step().awaitTermination()
    return out


def budget_stream(w):
    kept = w.keep(limits(w), "limits")
    out = arriving(w, "r3", lambda stream, o: [lambda: streaming.stream_budgets(stream, kept, o, f"{o}-checkpoint")])
    return streaming.present_breaches(w.spark, out)


O.CTES["x_twice"] = "SELECT * FROM x_runs UNION ALL SELECT * FROM x_runs WHERE latency_ms%3=0"
query("r3_stream_budgets", BREACHES.replace("FROM x_runs)", "FROM x_twice)"))(budget_stream)


def watching(w):
    baseline = w.runs.where("deployment_version = 'v1'")
    start = lambda stream, o: [lambda: streaming.watch(stream, baseline, o, f"{o}-watch"), lambda: streaming.alerts(w.spark, o, f"{o}-alerts")]
    out = arriving(w, "r4", start)
    return w.spark.read.schema(streaming.SCORES).parquet(f"{out}/alerts/told=*").select(*K.AGENT, "batch_id", "score", "current_n")


# The same comparison, of the newest runs at the end of each drop with the baseline version.
WATCHED = ("runs", "pairs", "sides", "fp", "entries", "dist", "shares", "jsd", "emd", "wide", "drift")
O.CTES["x_dropped"] = f"SELECT *, date_diff('day', DATE '2024-01-01', CAST(started_at AS DATE)) // {DROP_DAYS} AS d FROM x_twice"
O.CTES["x_recent"] = """SELECT * FROM (SELECT t.*, b.d AS upto, row_number() OVER (PARTITION BY t.session_id, t.environment, b.d ORDER BY started_at DESC, id DESC) AS newest
    FROM x_dropped t JOIN (SELECT DISTINCT session_id, environment, d FROM x_dropped) b
      ON b.session_id=t.session_id AND b.environment=t.environment AND t.d<=b.d) WHERE newest<=20"""
for _name in WATCHED:
    O.CTES[f"x_w_{_name}"] = re.sub(rf"\bx_({'|'.join(WATCHED)})\b", r"x_w_\1", O.CTES[f"x_{_name}"])
O.CTES["x_w_runs"] = """SELECT * FROM x_runs WHERE deployment_version='v1'
    UNION ALL BY NAME SELECT * EXCLUDE (d, upto, newest) REPLACE ('live-'||upto AS deployment_version) FROM x_recent"""
O.CTES["x_w_pairs"] = """SELECT DISTINCT r.session_id, r.environment, 'v1' AS baseline_version, 'live-'||upto AS current_version FROM x_recent r
    JOIN (SELECT DISTINCT session_id, environment FROM x_runs WHERE deployment_version='v1') USING (session_id, environment)"""
# Watching goes by fingerprints; there are no latency distances of single runs.
O.CTES["x_w_emd"] = "SELECT *, CAST(NULL AS DOUBLE) AS emd FROM x_w_pairs WHERE false"
query(
    "r4_watch",
    f"""SELECT session_id, environment, batch_id, score, current_n FROM (
      SELECT *, lag(score) OVER (PARTITION BY session_id, environment ORDER BY batch_id) AS earlier FROM (
        SELECT session_id, environment, CAST(substr(current_version, 6) AS BIGINT) AS batch_id, {O.r('round(drift_score, 2)')} AS score, current_n
        FROM x_w_drift WHERE current_n>=10 AND drift_score>={K.DRIFT_THRESHOLD!r}::DOUBLE)) WHERE score IS DISTINCT FROM earlier""",
)(watching)


def windowed(w):
    out = arriving(w, "r5", lambda stream, o: [lambda: streaming.stream_panes(stream, o, f"{o}-checkpoint", "12 hours")])
    return streaming.windowed_fingerprints(w.spark, out, "24 hours", "12 hours", "1 hour")


HALF_DAY = 12 * 3600 * 1_000_000
query(
    "r5_windowed_fingerprints",
    f"""SELECT {ts('make_timestamp(start_us)')} AS window_start, {ts(f'make_timestamp(start_us+{2 * HALF_DAY})')} AS window_end, {G}, n,
      {r('avg_latency_ms')} AS avg_latency_ms, p95_latency_ms, {r('error_rate')} AS error_rate, {r('avg_output_length')} AS avg_output_length,
      {r('escalation_rate')} AS escalation_rate, start_us+{2 * HALF_DAY} <= (SELECT max(epoch_us(started_at)) FROM x_twice)-3600000000 AS closed
    FROM (SELECT epoch_us(started_at)//{HALF_DAY}*{HALF_DAY}-j*{HALF_DAY} AS start_us, {G}, count(*) AS n, avg(latency_ms) AS avg_latency_ms,
        {O.percentile('latency_ms', 95)} AS p95_latency_ms, avg(error_count) AS error_rate, avg(output_length) AS avg_output_length,
        count(*) FILTER (semantic_cluster='escalated')/count(*) AS escalation_rate FROM x_twice, (VALUES (0), (1)) v(j) GROUP BY start_us, {G})""",
)(windowed)


def twice(w):
    """An import that runs twice from one checkpoint reads every file once."""
    out = fresh(w, "r6")
    for _ in range(2):
        streaming.append_runs(streaming.stream_runs(w.spark, stream_source(w)), out, f"{out}-c").awaitTermination()
    return w.spark.read.parquet(out).agg(F.count("*").alias("n"))


query("r6_incremental_import", "SELECT count(*)+count(*) FILTER (latency_ms%3=0) AS n FROM x_runs")(twice)
