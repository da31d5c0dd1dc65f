"""Fingerprints, selections, windows and set operations over runs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.functions import constants as K
from tidemark.operators import budget, calibrate, epochs, fingerprint, ranks, select
from tidemark.operators import pairs as pairs_ops
from tidemark.plans import oracle as O
from tidemark.plans.oracle import G, P, VECTOR, percentile, r
from tidemark.plans.registry import query, ts

AS_OF = datetime(2024, 1, 31)
FP_COLUMNS = [
    "avg_tool_count", "avg_output_length", "avg_loop_count", "avg_verbosity_ratio", "avg_retry_count",
    "avg_time_to_first_tool_ms", "error_rate", "retry_rate", "fallback_rate",
]
RUN = f"id, {G}"


# ---- aggregations ------------------------------------------------------------------------------
query(
    "a1_fp_scalar",
    f"""SELECT {G}, n, {', '.join(f'{r(c)} AS {c}' for c in FP_COLUMNS)}, {ts('window_start')} AS window_start, {ts('window_end')} AS window_end,
    p50_latency_ms, p95_latency_ms, p99_latency_ms, p95_loop_count FROM x_fp""",
)(lambda w: fingerprint.fp_scalar(w.runs))
query(
    "a2_floor_percentile",
    f"""SELECT session_id, {percentile('latency_ms', 50)} AS p50, {percentile('latency_ms', 95)} AS p95, {percentile('latency_ms', 99)} AS p99
    FROM x_runs GROUP BY session_id""",
)(lambda w: ranks.floor_percentile(w.runs, ["session_id"], "latency_ms", {f"p{p}": ranks.percent_rank(p) for p in (50, 95, 99)}))
query(
    "a3_interpolated_percentile",
    f"SELECT session_id, {r('quantile_cont(latency_ms, 0.9)')} AS p90 FROM x_runs GROUP BY session_id",
)(
    lambda w: ranks.interpolated_of_counts(
        w.runs.groupBy("session_id", "latency_ms").agg(F.count("*").alias("k")), ["session_id"], "latency_ms", 0.9, "p90"
    )
)
for number, kind in (("a4", "sequence"), ("a5", "outcome"), ("a6", "bigram"), ("a7", "tool")):
    query(f"{number}_fp_dist_{kind}", f"SELECT {G}, kind, key, n, {r('share')} AS share FROM x_dist WHERE kind='{kind}'")(
        lambda w, kind=kind: fingerprint.fp_dist(w.runs, K.GROUP, (kind,))
    )
query(
    "a4_fp_dist_orders",
    f"""SELECT session_id, deployment_version, key, n, {r('n/sum(n) OVER (PARTITION BY session_id, deployment_version)')} AS share FROM (
    SELECT o_orderpriority AS session_id, CAST(year(o_orderdate) AS VARCHAR) AS deployment_version, coalesce(CAST(to_json(tools) AS VARCHAR), '[]') AS key, count(*) AS n
    FROM orders LEFT JOIN (SELECT l_orderkey, list(l_returnflag||l_linestatus ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS tools
    FROM lineitem GROUP BY l_orderkey) ON o_orderkey=l_orderkey GROUP BY 1, 2, 3)""",
)(lambda w: fingerprint.fp_dist(w.order_runs, ["session_id", "deployment_version"], ("sequence",)).drop("kind"))
query(
    "a8_top_sequences",
    f"""SELECT {G}, position, key, n, {r('share')} AS share FROM (SELECT *, row_number() OVER (PARTITION BY {G} ORDER BY n DESC, key) AS position
    FROM x_dist WHERE kind='sequence') WHERE position<=10""",
)(lambda w: fingerprint.top_sequences(w.runs).drop("kind"))
query("a9_versions", "SELECT coalesce(deployment_version,'unknown') AS deployment_version, count(*) AS run_count FROM x_runs GROUP BY 1")(
    lambda w: fingerprint.versions(w.runs)
)
query(
    "a10_store_stats",
    f"SELECT count(*) AS total_runs, count(DISTINCT deployment_version) AS version_count, {ts('min(started_at)')} AS oldest, {ts('max(started_at)')} AS newest FROM x_runs",
)(lambda w: fingerprint.store_stats(w.runs))
query(
    "a11_version_source_mix",
    f"""SELECT {G}, count(*) AS n, {r("(count(*) FILTER (version_source='epoch'))/count(*)")} AS epoch_share,
    {r("(count(*) FILTER (version_source='unknown'))/count(*)")} AS unknown_share,
    {r("(count(*) FILTER (version_source IN ('release','tag','env')))/count(*)")} AS confident_share FROM x_runs GROUP BY {G}""",
)(lambda w: fingerprint.version_source_mix(w.runs))
query(
    "a14_cost_per_10k",
    f"SELECT {G}, count(*) AS n, {r('(avg(prompt_tokens)/1000000*2.5+avg(completion_tokens)/1000000*10)*10000')} AS cost_10k FROM x_runs GROUP BY {G}",
)(lambda w: fingerprint.cost_per_10k(w.runs))
METRICS = [
    "avg_latency", "avg_prompt_tokens", "avg_completion_tokens", "avg_loop_count", "avg_retry_count", "error_rate",
    "escalation_rate", "avg_tool_count",
]
query("a16_run_metrics", f"SELECT {G}, n, {', '.join(f'{r(c)} AS {c}' for c in METRICS)}, p95_latency FROM x_metrics")(
    lambda w: fingerprint.run_metrics(w.runs)
)
SIGNALS = [
    "escalation_rate", "resolution_rate", "error_rate", "fallback_rate", "avg_loop_depth", "avg_tool_count", "avg_output_length",
    "avg_verbosity_ratio", "avg_retry_rate", "avg_time_to_first_tool", "avg_latency_p95",
]
query("a17_behaviour_signals", f"SELECT session_id, n, {', '.join(f'{r(c)} AS {c}' for c in SIGNALS)} FROM x_signals")(
    lambda w: fingerprint.behaviour_signals(w.runs)
)
query(
    "a18_collection_rate",
    f"""SELECT {G}, n, CASE WHEN rate IS NULL THEN NULL ELSE {r('rate')} END AS runs_per_day, CASE WHEN d BETWEEN 1 AND 30 THEN d END AS days_left
    FROM (SELECT *, CAST(trunc((500-n)/rate) AS BIGINT) AS d FROM (SELECT *, CASE WHEN span>0 THEN n/span END AS rate FROM (
    SELECT {G}, count(*) AS n, date_diff('microsecond', min(started_at), max(started_at))/86400000000.0::DOUBLE AS span FROM x_runs GROUP BY {G})))""",
)(lambda w: fingerprint.collection_rate(w.runs, K.GROUP, 500))
query("a21_distinct_tools", "SELECT DISTINCT session_id, unnest(tools) AS tool FROM x_runs")(lambda w: fingerprint.distinct_tools(w.runs))
query(
    "a22_distinct_sequence_ratio",
    f"SELECT {G}, count(*) AS n, {r('count(DISTINCT CAST(to_json(tools) AS VARCHAR))/count(*)')} AS distinct_ratio FROM x_runs GROUP BY {G}",
)(lambda w: fingerprint.distinct_sequence_ratio(w.runs))

# ---- per-run projections -----------------------------------------------------------------------
query("p12_verbosity_ratio", f"SELECT {RUN}, {r('verbosity_ratio')} AS ratio FROM x_runs")(
    lambda w: w.runs.select("id", *K.GROUP, C.verbosity_ratio(F.col("prompt_tokens"), F.col("completion_tokens")).alias("ratio"))
)
query("p16_behaviour_vector", f"SELECT id, {', '.join(f'{r(v)} AS {d}' for d, v in VECTOR.items())} FROM x_runs")(
    lambda w: w.runs.select("id", *[v.cast("double").alias(d) for d, v in C.behaviour_vector().items()])
)
query("p17_dimension_scores", f"SELECT {G}, id, dim, {r('score')} AS score FROM x_scores")(lambda w: calibrate.dimension_scores(w.runs))
BUCKET = "CASE WHEN prompt_tokens<100 THEN '0-100' WHEN prompt_tokens<500 THEN '100-500' WHEN prompt_tokens<2000 THEN '500-2000' ELSE '2000+' END"


def with_prompt(runs):
    """A stand-in prompt as long as the prompt's token count."""
    return runs.withColumn("raw_prompt", F.repeat(F.lit("x"), F.col("prompt_tokens").cast("int")))


query("p18_task_cluster", f"SELECT id, coalesce(tools[1],'unknown')||':'||{BUCKET} AS cluster FROM x_runs")(
    lambda w: with_prompt(w.runs).select("id", C.task_cluster(F.col("tools"), F.col("raw_prompt")).alias("cluster"))
)
query("p19_run_cost", f"SELECT id, {r('(prompt_tokens/1000000*2.5+completion_tokens/1000000*10)*1000')} AS cost_per_thousand FROM x_runs")(
    lambda w: w.runs.select("id", (C.run_cost() * 1000).alias("cost_per_thousand"))
)
query(
    "p5_retry_count",
    "SELECT id, retry_count FROM x_runs",
)(lambda w: w.runs.select("id", C.retry_count(F.col("tools")).alias("retry_count")))
query(
    "p21_bigrams",
    "SELECT id, tools[i] AS head, tools[i+1] AS tail, count(*) AS n FROM (SELECT *, unnest(range(1, len(tools))) AS i FROM x_runs) GROUP BY ALL",
)(
    lambda w: w.runs.select("id", F.explode(C.bigrams(F.col("tools"))).alias("p"))
    .groupBy("id", F.col("p.head").alias("head"), F.col("p.tail").alias("tail"))
    .agg(F.count("*").alias("n"))
)
query(
    "p22_parse_tools",
    "SELECT id, CAST(CASE WHEN tool_call_count%3=0 THEN 0 ELSE len(tools) END AS BIGINT) AS n_tools, CASE WHEN tool_call_count%3=0 THEN NULL ELSE tools[1] END AS first_tool FROM x_runs",
)(
    lambda w: w.runs.select("id", F.when(F.col("tool_call_count") % 3 == 0, "not json").otherwise(F.to_json("tools")).alias("text"))
    .withColumn("parsed", C.parse_tools(F.col("text")))
    .select("id", F.size("parsed").alias("n_tools"), F.try_element_at("parsed", F.lit(1)).alias("first_tool"))
)

# ---- filters -----------------------------------------------------------------------------------
NEWEST = lambda by, n: f"SELECT * FROM (SELECT *, row_number() OVER ({f'PARTITION BY {by}' if by else ''} ORDER BY started_at DESC, id DESC) AS rn FROM x_runs) WHERE rn<={n}"
query("f1_runs_for", f"SELECT {RUN} FROM ({NEWEST(G, 50)}) WHERE environment='production'")(
    lambda w: select.runs_for(w.runs, env="production", limit=50).select("id", *K.GROUP)
)
query("f1_runs_for_version", f"SELECT {RUN} FROM x_runs WHERE deployment_version='v2' AND environment='production'")(
    lambda w: select.runs_for(w.runs, "v2", "production", None).select("id", *K.GROUP)
)
query(
    "f2_filter_runs",
    """SELECT id, latency_ms FROM x_runs WHERE deployment_version='v3' AND environment='production' AND semantic_cluster IN ('escalated','resolved')
    AND latency_ms BETWEEN 500 AND 4000 AND started_at >= TIMESTAMP '2024-01-16 12:00:00'""",
)(
    lambda w: select.filter_runs(
        w.runs, "v3", "production", ["escalated", "resolved"], 500, 4000, since=datetime(2024, 1, 16, 12)
    ).select("id", "latency_ms")
)
query("f3_count_runs", "SELECT count(*) AS run_count FROM x_runs WHERE environment='staging' AND started_at >= TIMESTAMP '2024-01-31' - INTERVAL 240 HOUR")(
    lambda w: select.count_runs(w.runs, env="staging", hours=240, as_of=AS_OF)
)
query("f4_last_n", f"SELECT {RUN} FROM ({NEWEST('session_id, environment', 20)})")(lambda w: select.last_n(w.runs, 20).select("id", *K.GROUP))
query(
    "f5_time_filter",
    """SELECT 'this-week' AS period, count(*) AS n FROM x_runs WHERE started_at >= TIMESTAMP '2024-01-31' - INTERVAL 168 HOUR
    UNION ALL SELECT '2w', count(*) FROM x_runs WHERE started_at >= TIMESTAMP '2024-01-31' - INTERVAL 336 HOUR
    UNION ALL SELECT 'range', count(*) FROM x_runs WHERE started_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'""",
)(
    lambda w: w.runs.agg(
        *[
            F.count_if(select.time_filter(t, AS_OF)).alias(name)
            for name, t in (("a", "this-week"), ("b", "2w"), ("c", "2024-01-05..2024-01-20"))
        ]
    ).selectExpr("stack(3, 'this-week', a, '2w', b, 'range', c) as (period, n)")
)
query(
    "f6_quality_filter",
    """SELECT 'errors-only' AS name, count(*) FILTER (error_count>0) AS n FROM x_runs UNION ALL SELECT 'slow', count(*) FILTER (latency_ms>=1000) FROM x_runs
    UNION ALL SELECT 'fast', count(*) FILTER (latency_ms<=100) FROM x_runs UNION ALL SELECT 'high-cost', count(*) FILTER (prompt_tokens>=10000) FROM x_runs
    UNION ALL SELECT 'production', count(*) FILTER (environment='production') FROM x_runs UNION ALL SELECT 'staging', count(*) FILTER (environment='staging') FROM x_runs""",
)(
    lambda w: w.runs.agg(
        *[F.count_if(select.quality_filter(n)).alias(n) for n in ("errors-only", "slow", "fast", "high-cost", "production", "staging")]
    ).selectExpr(
        "stack(6, 'errors-only', `errors-only`, 'slow', slow, 'fast', fast, 'high-cost', `high-cost`, 'production', production, 'staging', staging) as (name, n)"
    )
)
query("f7_keep_last", f"SELECT {RUN} FROM ({NEWEST('', 1000)})")(lambda w: select.keep_last(w.runs, 1000).select("id", *K.GROUP))
query("f8_older_than", f"SELECT {RUN} FROM x_runs WHERE NOT (deployment_version='v1' AND started_at < TIMESTAMP '2024-01-31' - INTERVAL 27 DAY)")(
    lambda w: select.prune_older(w.runs, 27, AS_OF, version="v1").select("id", *K.GROUP)
)
query("f10_low_sample", f"SELECT {G}, count(*) AS run_count FROM x_runs GROUP BY {G} HAVING count(*)<30")(lambda w: select.low_sample(w.runs, 30))
query("f11_drop_version", "SELECT id FROM x_runs WHERE deployment_version<>'v1'")(
    lambda w: select.without(w.runs, deployment_version="v1").select("id")
)

# ---- windows -----------------------------------------------------------------------------------
BUDGET_SQL = {
    "max_p95_latency": "avg(latency_ms)",
    "max_p50_latency": "avg(latency_ms)",
    "max_error_rate": "avg(CASE WHEN error_count>0 THEN 1.0 ELSE 0.0 END)",
    "max_escalation_rate": "avg(CASE WHEN semantic_cluster='escalated' THEN 1.0 ELSE 0.0 END)",
    "min_resolution_rate": "avg(CASE WHEN semantic_cluster='resolved' THEN 1.0 ELSE 0.0 END)",
    "max_retry_rate": "avg(retry_count)",
    "max_loop_depth": "avg(loop_count)",
    "max_verbosity_ratio": "avg(verbosity_ratio)",
    "max_output_length": "avg(output_length)",
    "max_time_to_first_tool": "avg(time_to_first_tool_ms)",
}
ROLLING = " UNION ALL ".join(
    f"SELECT session_id, deployment_version, count(*) AS run_count, '{k}' AS budget_key, {e} AS actual FROM ({NEWEST('session_id, deployment_version', 10)}) GROUP BY 1, 2 HAVING count(*)>=5"
    for k, e in BUDGET_SQL.items()
)
query("w1_rolling_budget", f"SELECT session_id, deployment_version, run_count, budget_key, {r('actual')} AS actual FROM ({ROLLING})")(
    lambda w: budget.rolling_budget(w.runs)
)
query(
    "w1_rolling_history",
    f"""SELECT session_id, deployment_version, id, row_number() OVER w AS position,
    {r('avg(latency_ms) OVER (PARTITION BY session_id, deployment_version ORDER BY started_at, id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)')} AS rolling_mean
    FROM x_runs WINDOW w AS (PARTITION BY session_id, deployment_version ORDER BY started_at, id)""",
)(lambda w: budget.rolling_history(w.runs))
LIMITS = {"max_p95_latency": 2000.0, "max_error_rate": 0.3, "min_resolution_rate": 0.25, "max_output_length": 100.0}


def limits(w):
    """Limits for every agent and version, from the runs' own keys."""
    rows = F.array(*[F.struct(F.lit(k).alias("budget_key"), F.lit(v).alias("limit_value")) for k, v in LIMITS.items()])
    keys = w.runs.select("session_id", "deployment_version").distinct()
    return keys.select("*", F.explode(rows).alias("l")).select("session_id", "deployment_version", "l.budget_key", "l.limit_value")


LIMIT_SQL = "(VALUES " + ", ".join(f"('{k}', '{K.BUDGET_KEYS[k]}', {v}::DOUBLE)" for k, v in LIMITS.items()) + ") l(budget_key, dimension, limit_value)"
BREACHES = f"""SELECT * FROM (SELECT session_id, deployment_version, budget_key, dimension, limit_value, {r('actual')} AS actual,
    CASE WHEN budget_key LIKE 'max%' AND actual>limit_value THEN 'above' WHEN budget_key LIKE 'min%' AND actual<limit_value THEN 'below' END AS direction, run_count
    FROM ({ROLLING}) JOIN {LIMIT_SQL} USING (budget_key)) WHERE direction IS NOT NULL"""
query("v10_budget_breaches", BREACHES)(lambda w: budget.budget_breaches(budget.rolling_budget(w.runs), limits(w)))
query(
    "j9_budgets_with_runs",
    f"SELECT id, budget_key, limit_value FROM x_runs, {LIMIT_SQL}",
)(lambda w: w.runs.join(limits(w), ["session_id", "deployment_version"]).select("id", "budget_key", "limit_value"))
query("w9_consecutive_pairs", f"SELECT {P} FROM x_pairs")(lambda w: pairs_ops.consecutive_pairs(w.runs))
query(
    "w10_average_rank",
    f"""SELECT {G}, latency_ms, {r('avg_rank')} AS avg_rank, n FROM (SELECT {G}, latency_ms, (sum(count(*)) OVER (PARTITION BY {G} ORDER BY latency_ms) - count(*)) + (count(*)+1)/2 AS avg_rank,
    CAST(sum(count(*)) OVER (PARTITION BY {G}) AS BIGINT) AS n FROM x_runs GROUP BY {G}, latency_ms)""",
)(lambda w: ranks.average_rank(w.runs, K.GROUP, "latency_ms", 1024))
query(
    "w11_cumulative_share",
    f"""SELECT {G}, latency_ms, {r('sum(count(*)) OVER (PARTITION BY ' + G + ' ORDER BY latency_ms)/sum(count(*)) OVER (PARTITION BY ' + G + ')')} AS cum_share,
    lead(latency_ms) OVER (PARTITION BY {G} ORDER BY latency_ms) AS next_value FROM x_runs GROUP BY {G}, latency_ms""",
)(
    lambda w: ranks.running(
        w.runs.groupBy(*K.GROUP, "latency_ms").agg(F.count("*").alias("k")), K.GROUP, "latency_ms", ["k"], successor=True
    ).select(*K.GROUP, "latency_ms", (F.col("cum_k") / F.col("all_k")).alias("cum_share"), "next_value")
)
WEEK = "started_at BETWEEN TIMESTAMP '2024-01-28' - INTERVAL 7 DAY AND TIMESTAMP '2024-01-28'"
query(
    "w8_temporal_pair",
    f"""SELECT {G}, side, n, {r('error_rate')} AS error_rate, p95_latency_ms FROM (SELECT *, count(*) OVER (PARTITION BY {G}) AS k FROM (
    SELECT {G}, side, count(*) AS n, avg(error_count) AS error_rate, {percentile('latency_ms', 95)} AS p95_latency_ms FROM (
      SELECT *, 'b' AS side FROM x_runs WHERE {WEEK} UNION ALL SELECT *, 'c' FROM x_runs WHERE {WEEK} AND started_at >= TIMESTAMP '2024-01-28' - INTERVAL 72 HOUR)
    GROUP BY {G}, side) WHERE n>=10) WHERE k=2""",
)(
    lambda w: epochs.temporal_pair(w.runs, datetime(2024, 1, 28), 7, 72).select(*K.GROUP, "side", "n", "error_rate", "p95_latency_ms")
)

# ---- sorts and top-k ---------------------------------------------------------------------------
query(
    "t1_page",
    f"SELECT {RUN}, {ts('started_at')} AS started_at FROM x_runs ORDER BY x_runs.started_at DESC, id DESC LIMIT 25 OFFSET 50",
)(lambda w: select.page(w.runs, 50, 25).select("id", *K.GROUP, "started_at"))
query("t2_newest_run", f"SELECT session_id, id, {ts('started_at')} AS started_at FROM ({NEWEST('session_id', 1)})")(
    lambda w: select.newest_run(w.runs, ["session_id"]).select("session_id", "id", "started_at")
)
query("t2_run_by_id", "SELECT id, latency_ms FROM x_runs WHERE id='1-2024-01-02'")(
    lambda w: select.run_by_id(w.runs, "1-2024-01-02").select("id", "latency_ms")
)
query(
    "t6_top_clusters",
    f"""SELECT {G}, cluster, n FROM (SELECT *, row_number() OVER (PARTITION BY {G} ORDER BY n DESC, cluster) AS rn FROM (
    SELECT {G}, coalesce(tools[1],'unknown')||':'||{BUCKET} AS cluster, count(*) AS n FROM x_runs GROUP BY ALL)) WHERE rn<=5""",
)(
    lambda w: ranks.newest(
        with_prompt(w.runs).groupBy(*K.GROUP, C.task_cluster(F.col("tools"), F.col("raw_prompt")).alias("cluster")).agg(F.count("*").alias("n")),
        K.GROUP,
        [F.col("n").desc(), F.col("cluster")],
        5,
        F.col("cluster"),
    )
)
query(
    "t8_dominant_sequence",
    f"""SELECT {G}, key, {r('share')} AS share FROM (SELECT *, row_number() OVER (PARTITION BY {G} ORDER BY n DESC, key) AS rn
    FROM x_dist WHERE kind='sequence') WHERE rn=1""",
)(lambda w: fingerprint.dominant(w.dist, K.GROUP))

# ---- set operations ----------------------------------------------------------------------------
query("x1_union_of_sides", f"SELECT {P}, side, count(*) AS n FROM x_runs JOIN x_sides USING ({G}) GROUP BY {P}, side")(
    lambda w: w.runs.select(*K.GROUP).join(pairs_ops.sides(w.pairs), K.GROUP).groupBy(*K.PAIR, "side").agg(F.count("*").alias("n"))
)
query("x2_difference", f"SELECT {P}, key FROM x_shares WHERE kind='sequence' AND b_n=0 AND c_n>0")(
    lambda w: pairs_ops.attach(w.dist.where("kind = 'sequence'").select(*K.GROUP, "key"), w.pairs)
    .where("side = 'c'")
    .select(*K.PAIR, "key")
    .join(
        pairs_ops.attach(w.dist.where("kind = 'sequence'").select(*K.GROUP, "key"), w.pairs).where("side = 'b'").select(*K.PAIR, "key"),
        [*K.PAIR, "key"],
        "left_anti",
    )
)
query("x3_intersection", f"SELECT {P}, key FROM x_shares WHERE kind='sequence' AND b_n>0 AND c_n>0")(
    lambda w: pairs_ops.attach(w.dist.where("kind = 'sequence'").select(*K.GROUP, "key"), w.pairs)
    .groupBy(*K.PAIR, "key")
    .agg(F.count_distinct("side").alias("sides"))
    .where("sides = 2")
    .drop("sides")
)
query("x4_union_of_keys", f"SELECT {P}, key FROM x_shares WHERE kind='bigram'")(
    lambda w: pairs_ops.attach(w.dist.where("kind = 'bigram'").select(*K.GROUP, "key"), w.pairs).select(*K.PAIR, "key").distinct()
)


# ---- epochs ------------------------------------------------------------------------------------
# The event tables are random, so a low cut is what finds breaks in them.
CUT = 0.05


def _breaks(w):
    if not hasattr(w, "_breaks"):
        w._breaks = w.keep(epochs.epoch_breaks(epochs.epoch_windows(_positions(w)), cut=CUT), "breaks")
    return w._breaks


def _positions(w):
    if not hasattr(w, "_positions"):
        w._positions = w.keep(epochs.ordered(w.runs), "positions")
    return w._positions


def _jsd_of(table: str, keys: str) -> str:
    """Mean of outcome and tool divergence from a table keys, kind, key, p, q; an empty kind counts 0."""
    return f"""SELECT {keys}, sum(CASE WHEN mp=0 OR mq=0 THEN 1.0 ELSE greatest(0.0, least(1.0, t/0.6931471805599453)) END)/2 AS change, max(hb) AS hb, max(hc) AS hc FROM (
      SELECT {keys}, kind, max(p) AS mp, max(q) AS mq, max(b_n) AS hb, max(c_n) AS hc,
        sum(0.5*((CASE WHEN p>0 THEN p*ln(p/((p+q)/2)) ELSE 0.0 END)+(CASE WHEN q>0 THEN q*ln(q/((p+q)/2)) ELSE 0.0 END))) AS t FROM {table} GROUP BY {keys}, kind) GROUP BY {keys}"""


O.CTES["x_pos"] = """SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY started_at, id)-1 AS r,
    count(*) OVER (PARTITION BY session_id) AS n FROM x_runs"""
O.CTES["x_win"] = """SELECT session_id, window_start, kind, key, count(*) AS n FROM (
    SELECT session_id, window_start, 'outcome' AS kind, semantic_cluster AS key FROM x_placed
    UNION ALL SELECT session_id, window_start, 'tool', unnest(tools) FROM x_placed) GROUP BY ALL"""
O.CTES["x_placed"] = """SELECT p.*, s.window_start FROM x_pos p JOIN (SELECT DISTINCT session_id, unnest(range(0, n-20, 10)) AS window_start FROM (SELECT DISTINCT session_id, n FROM x_pos WHERE n>=40)) s
    ON p.session_id=s.session_id AND p.r>=s.window_start AND p.r<s.window_start+20"""
O.CTES["x_winshare"] = """SELECT session_id, brk, kind, key, coalesce(sum(share) FILTER (side='b'),0.0) AS p, coalesce(sum(share) FILTER (side='c'),0.0) AS q,
    coalesce(sum(n) FILTER (side='b'),0) AS b_n, coalesce(sum(n) FILTER (side='c'),0) AS c_n FROM (
    SELECT *, 'c' AS side, window_start AS brk FROM x_winn UNION ALL SELECT *, 'b', window_start+10 FROM x_winn) GROUP BY session_id, brk, kind, key"""
O.CTES["x_winn"] = "SELECT *, n/sum(n) OVER (PARTITION BY session_id, window_start, kind) AS share FROM x_win"
O.CTES["x_change"] = _jsd_of("x_winshare", "session_id, brk")
O.CTES["x_breaks"] = "SELECT session_id, brk AS position, change FROM x_change WHERE hb>0 AND hc>0 AND change>0.05"
O.CTES["x_tagged"] = """SELECT p.*, (SELECT count(*) FROM x_breaks b WHERE b.session_id=p.session_id AND b.position<=p.r) AS epoch FROM x_pos p WHERE n>=40"""
O.CTES["x_epochbounds"] = """SELECT session_id, epoch, min(r) AS start_r, count(*) AS run_count, arg_min(id, r) AS start_run_id, arg_max(id, r) AS end_run_id,
    arg_min(started_at, r) AS start_time, arg_max(completed_at, r) AS end_time FROM x_tagged GROUP BY session_id, epoch"""
O.CTES["x_halves"] = """SELECT session_id, epoch, kind, key, coalesce(sum(share) FILTER (side='b'),0.0) AS p, coalesce(sum(share) FILTER (side='c'),0.0) AS q, 1 AS b_n, 1 AS c_n FROM (
    SELECT session_id, epoch, side, kind, key, count(*)/sum(count(*)) OVER (PARTITION BY session_id, epoch, side, kind) AS share FROM (
      SELECT session_id, epoch, side, 'outcome' AS kind, semantic_cluster AS key FROM x_sidetag UNION ALL SELECT session_id, epoch, side, 'tool', unnest(tools) FROM x_sidetag)
    GROUP BY session_id, epoch, side, kind, key) GROUP BY session_id, epoch, kind, key"""
O.CTES["x_sidetag"] = """SELECT t.*, CASE WHEN t.r-e.start_r < e.run_count//2 THEN 'b' ELSE 'c' END AS side FROM x_tagged t JOIN x_epochbounds e USING (session_id, epoch) WHERE e.run_count>=10"""
O.CTES["x_stability"] = f"SELECT session_id, epoch, change AS inner_change, CASE WHEN change<0.1 THEN 'HIGH' WHEN change<0.2 THEN 'MODERATE' ELSE 'LOW' END AS stability FROM ({_jsd_of('x_halves', 'session_id, epoch')})"
O.CTES["x_epochs"] = """SELECT e.*, s.inner_change, coalesce(s.stability,'UNKNOWN') AS stability, 'epoch-'||CAST(CAST(start_time AS DATE) AS VARCHAR) AS label
    FROM x_epochbounds e LEFT JOIN x_stability s USING (session_id, epoch)"""

query("w2_epoch_windows", "SELECT session_id, window_start, kind, key, n FROM x_win")(lambda w: epochs.epoch_windows(_positions(w)))
query("w3_epoch_breaks", f"SELECT session_id, position, {r('change')} AS change FROM x_breaks")(
    lambda w: epochs.epoch_breaks(epochs.epoch_windows(_positions(w)), cut=CUT)
)
O.CTES["x_near"] = """SELECT session_id, position FROM (SELECT session_id, brk AS position FROM x_change WHERE hb>0 AND hc>0 AND change>0.05)"""
query(
    "w4_merge_breaks",
    """SELECT session_id, unnest(list_reduce(list_prepend(CAST([] AS BIGINT[]), list_transform(ps, lambda x: [x])), lambda acc, x: CASE WHEN len(acc)=0 OR x[1]-acc[-1]>=25 THEN list_concat(acc, x) ELSE acc END)) AS position
        FROM (SELECT session_id, list(position ORDER BY position) AS ps FROM x_near GROUP BY session_id)""",
)(lambda w: epochs.merge_breaks(_breaks(w), gap=25))
query(
    "w5_epochs",
    f"""SELECT session_id, epoch, start_r, run_count, start_run_id, end_run_id, {ts('start_time')} AS start_time, {ts('end_time')} AS end_time,
    CASE WHEN inner_change IS NULL THEN NULL ELSE {r('inner_change')} END AS inner_change, stability, label FROM x_epochs""",
)(lambda w: epochs.epochs(epochs.with_epoch(_positions(w), _breaks(w))))


def _found(w):
    if not hasattr(w, "_found"):
        w._found = w.keep(epochs.detect(w.runs, cut=CUT), "epochs")
    return w._found


query("w6_epoch_stability", f"SELECT session_id, epoch, {r('inner_change')} AS inner_change, stability FROM x_stability")(
    lambda w: _found(w).where("stability <> 'UNKNOWN'").select("session_id", "epoch", "inner_change", "stability")
)
query(
    "w7_epoch_trend",
    """SELECT session_id, count(*)-1 AS shifts, CASE arg_max(stability, epoch) WHEN 'HIGH' THEN 'STABLE' WHEN 'MODERATE' THEN 'STABLE' WHEN 'LOW' THEN 'DEGRADED' ELSE 'INSUFFICIENT_DATA' END AS state,
    (list(label ORDER BY run_count DESC, epoch) FILTER (stability='HIGH'))[1] AS longest_stable, max(run_count) FILTER (stability='HIGH') AS longest_runs, CAST(sum(run_count) AS BIGINT) AS runs
    FROM x_epochs GROUP BY session_id""",
)(lambda w: epochs.epoch_trend(_found(w)))


def changes(w):
    """A change of model at the first run of every version and of the prompt at every second one."""
    firsts = w.runs.groupBy("session_id", "deployment_version").agg(F.min("started_at").alias("recorded_at"))
    week = F.substring("deployment_version", 2, 9).cast("int")
    kinds = F.array(
        F.struct(F.lit("model_version").alias("change_type"), F.concat(F.lit("m"), (week / 2).cast("int")).alias("current_value")),
        F.struct(F.lit("prompt_hash").alias("change_type"), F.concat(F.lit("h"), week).alias("current_value")),
        F.struct(F.lit("rag_snapshot").alias("change_type"), F.lit("s1").alias("current_value")),
        F.struct(F.lit("custom_flag").alias("change_type"), F.when(week > 2, F.lit("on")).otherwise("off").alias("current_value")),
    )
    return firsts.select("session_id", "deployment_version", "recorded_at", F.explode(kinds).alias("k")).select(
        "session_id", "deployment_version", "recorded_at", "k.change_type", "k.current_value"
    )


O.CTES["x_firsts"] = "SELECT session_id, deployment_version, min(started_at) AS recorded_at, CAST(substr(deployment_version, 2) AS INT) AS week FROM x_runs GROUP BY ALL"
O.CTES["x_changes"] = """SELECT session_id, deployment_version, recorded_at, 'model_version' AS change_type, 'm'||(week//2) AS current_value FROM x_firsts
    UNION ALL SELECT session_id, deployment_version, recorded_at, 'prompt_hash', 'h'||week FROM x_firsts
    UNION ALL SELECT session_id, deployment_version, recorded_at, 'rag_snapshot', 's1' FROM x_firsts
    UNION ALL SELECT session_id, deployment_version, recorded_at, 'custom_flag', CASE WHEN week>2 THEN 'on' ELSE 'off' END FROM x_firsts"""
query(
    "j14_changes_near_epochs",
    """SELECT e.session_id, e.epoch, e.label, c.change_type, CAST(date_diff('microsecond', e.start_time, c.recorded_at)//1000000 AS BIGINT) AS gap_seconds FROM x_epochs e JOIN x_changes c
    ON e.session_id=c.session_id AND abs(epoch_us(c.recorded_at)-epoch_us(e.start_time)) < 86401000000 AND abs(trunc((epoch_us(c.recorded_at)-epoch_us(e.start_time))/1000000))<=86400""",
)(lambda w: epochs.changes_near_epochs(_found(w), changes(w)).select("session_id", "epoch", "label", "change_type", "gap_seconds"))
