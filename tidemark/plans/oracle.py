"""The same quantities as plain SQL over the given tables, to check the DataFrame results against.

``sql(body)`` prefixes the common table expressions a body refers to.
"""

from __future__ import annotations

import math
import re

from tidemark.functions import constants as K

G = "session_id, deployment_version, environment"
P = "session_id, environment, baseline_version, current_version"


def r(x: str, digits: int = 6) -> str:
    """Rounded like the query side: exact ties go up on both sides, and there are no negative zeros."""
    return f"round(CAST({x} AS DOUBLE) + 1e-10, {digits}) + 0.0"


def clamp(x: str) -> str:
    return f"greatest(0.0, least(1.0, {x}))"


def sigmoid(x: str, k: float, c: float) -> str:
    zero = 1.0 / (1.0 + math.exp(k * c))
    raw = f"1.0/(1.0+exp(-{k}::DOUBLE*(({x})-{c}::DOUBLE)))"
    return f"(CASE WHEN ({x}) <= 0 THEN 0.0 ELSE {clamp(f'({raw}-{zero!r}::DOUBLE)/{1.0 - zero!r}::DOUBLE')} END)"


def values(rows: list[tuple], columns: str) -> str:
    lit = lambda v: "NULL" if v is None else (f"'{v.replace(chr(39), chr(39) * 2)}'" if isinstance(v, str) else f"{v!r}" + ("::DOUBLE" if isinstance(v, float) else ""))
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(lit(v) for v in row) + ')' for row in rows)}) v({columns}))"


def percentile(column: str, p: int) -> str:
    return f"list_sort(list({column}))[CAST(least((count(*) * {p}) // 100, count(*) - 1) AS BIGINT) + 1]"


REL = lambda x: f"abs(c_{x}-b_{x})/greatest(b_{x},1.0)"
SCORES = {
    "decision_drift": ("decision_jsd", "decision_jsd"),
    "semantic_drift": ("outcome_jsd", sigmoid("outcome_jsd", 4.0, 0.3)),
    "latency": (
        f"least(1.0,{REL('p95_latency_ms')})",
        f"(CASE WHEN emd IS NULL THEN {sigmoid(REL('p95_latency_ms'), 2.0, 1.0)} ELSE 0.5*{sigmoid(REL('p95_latency_ms'), 2.0, 1.0)}"
        f"+0.5*(CASE WHEN emd=0 THEN 0.0 ELSE {clamp('1.0/(1.0+pow(2.718281828::DOUBLE,-0.002::DOUBLE*(emd-500.0)))')} END) END)",
    ),
    "error_rate": ("least(1.0,2*abs(c_error_rate-b_error_rate))", sigmoid("least(1.0,2*abs(c_error_rate-b_error_rate))", 4.0, 0.3)),
    "tool_distribution": ("decision_jsd", "decision_jsd"),
    "verbosity_ratio": (sigmoid("abs(c_avg_verbosity_ratio-b_avg_verbosity_ratio)", 3.0, 0.3),) * 2,
    "loop_depth": (f"least(1.0,{REL('p95_loop_count')})", sigmoid(REL("p95_loop_count"), 2.5, 0.4)),
    "output_length": (f"least(1.0,{REL('avg_output_length')})", sigmoid(REL("avg_output_length"), 2.0, 0.4)),
    "tool_sequence": ("decision_jsd", "decision_jsd"),
    "retry_rate": ("least(1.0,2*abs(c_avg_retry_count-b_avg_retry_count))", sigmoid("abs(c_avg_retry_count-b_avg_retry_count)", 4.0, 0.2)),
    "time_to_first_tool": (f"least(1.0,{REL('avg_time_to_first_tool_ms')})", sigmoid(REL("avg_time_to_first_tool_ms"), 2.0, 0.5)),
    "tool_sequence_transitions": ("transition_distance", "transition_distance"),
}
SIDE = [
    "n", "avg_output_length", "avg_loop_count", "avg_verbosity_ratio", "avg_retry_count", "avg_time_to_first_tool_ms",
    "error_rate", "p50_latency_ms", "p95_latency_ms", "p95_loop_count",
]
DISTANCES = f"""SELECT {P}, kind,
    CASE WHEN max(p)=0 OR max(q)=0 THEN 1.0 ELSE {clamp(f"sum(t)/{math.log(2)!r}")} END AS jsd,
    CASE WHEN max(p)=0 OR max(q)=0 THEN 0.0 ELSE sqrt(greatest(0.0,sum(t))) END AS js_distance
  FROM (SELECT *, 0.5*((CASE WHEN p>0 THEN p*ln(p/((p+q)/2)) ELSE 0.0 END)+(CASE WHEN q>0 THEN q*ln(q/((p+q)/2)) ELSE 0.0 END)) AS t
        FROM x_shares) GROUP BY ALL"""


def total(weights: dict[str, float]) -> str:
    return "+".join(f"{w!r}::DOUBLE*{SCORES[d][1]}" for d, w in weights.items() if w)


CTES = {
    "x_ev": """SELECT user_id, CAST(ts AS DATE) AS day, ts, event_id, event_type, value,
        CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""",
    "x_steps": """SELECT user_id, day, list(event_type ORDER BY ts, event_id) AS tools, list(value ORDER BY ts, event_id)[1] AS first_value,
        min(ts) AS started_at, max(ts) AS completed_at, count(*) AS tool_call_count,
        CAST(sum(CAST(round(value*100) AS BIGINT)) AS BIGINT) AS cents,
        count(*) FILTER (event_type='error') AS error_count, count(*) FILTER (event_type IN ('click','view')) AS looks,
        CAST(coalesce(sum(k),0) AS BIGINT) AS prompt_tokens, CAST(sum(length(event_type))*10 AS BIGINT) AS completion_tokens,
        CAST(sum(CAST(round(value) AS BIGINT)) AS BIGINT) AS output_length FROM x_ev GROUP BY user_id, day""",
    "x_runs": """SELECT user_id||'-'||day AS id, 'agent-'||(user_id%4) AS session_id,
        'v'||(date_diff('day', DATE '2024-01-01', day)//7+1) AS deployment_version,
        CASE WHEN user_id%10=0 THEN 'unknown' ELSE 'release' END AS version_source,
        CASE WHEN user_id%7=0 THEN 'staging' ELSE 'production' END AS environment,
        started_at, completed_at, tools, tool_call_count, cents//5 AS latency_ms, error_count,
        CAST(len(list_filter(range(2, len(tools)+1), lambda i: tools[i]=tools[i-1])) AS BIGINT) AS retry_count,
        greatest(1, looks) AS loop_count, CAST(round(first_value*10) AS BIGINT) AS time_to_first_tool_ms,
        prompt_tokens, completion_tokens,
        CASE WHEN prompt_tokens>0 THEN completion_tokens/prompt_tokens ELSE 0.0 END AS verbosity_ratio, output_length,
        CASE tools[-1] WHEN 'error' THEN 'escalated' WHEN 'purchase' THEN 'resolved' WHEN 'signup' THEN 'fallback' ELSE 'unknown' END AS semantic_cluster
        FROM x_steps""",
    "x_pairs": f"""SELECT * FROM (SELECT session_id, environment,
        lag(deployment_version) OVER (PARTITION BY session_id, environment ORDER BY first_at, deployment_version) AS baseline_version,
        deployment_version AS current_version FROM (SELECT {G}, min(started_at) AS first_at FROM x_runs GROUP BY ALL))
        WHERE baseline_version IS NOT NULL""",
    "x_sides": f"""SELECT {P}, 'b' AS side, baseline_version AS deployment_version FROM x_pairs
        UNION ALL SELECT {P}, 'c', current_version FROM x_pairs""",
    "x_fp": f"""SELECT {G}, count(*) AS n, avg(tool_call_count) AS avg_tool_count, avg(output_length) AS avg_output_length,
        avg(loop_count) AS avg_loop_count, avg(verbosity_ratio) AS avg_verbosity_ratio, avg(retry_count) AS avg_retry_count,
        avg(time_to_first_tool_ms) AS avg_time_to_first_tool_ms, avg(error_count) AS error_rate, avg(retry_count) AS retry_rate,
        (count(*) FILTER (semantic_cluster='fallback'))/count(*) AS fallback_rate, min(started_at) AS window_start, max(started_at) AS window_end,
        {percentile('latency_ms', 50)} AS p50_latency_ms, {percentile('latency_ms', 95)} AS p95_latency_ms,
        {percentile('latency_ms', 99)} AS p99_latency_ms, {percentile('loop_count', 95)} AS p95_loop_count FROM x_runs GROUP BY {G}""",
    "x_entries": f"""SELECT {G}, 'sequence' AS kind, CAST(to_json(tools) AS VARCHAR) AS key FROM x_runs
        UNION ALL SELECT {G}, 'outcome', semantic_cluster FROM x_runs
        UNION ALL SELECT {G}, 'bigram', tools[i]||' -> '||tools[i+1] FROM (SELECT *, unnest(range(1, len(tools))) AS i FROM x_runs)
        UNION ALL SELECT {G}, 'tool', unnest(tools) FROM x_runs""",
    "x_dist": f"""SELECT {G}, kind, key, count(*) AS n, count(*)/sum(count(*)) OVER (PARTITION BY {G}, kind) AS share
        FROM x_entries GROUP BY {G}, kind, key""",
    "x_shares": f"""SELECT {P}, kind, key, coalesce(sum(share) FILTER (side='b'), 0.0) AS p, coalesce(sum(share) FILTER (side='c'), 0.0) AS q,
        CAST(coalesce(sum(n) FILTER (side='b'), 0) AS BIGINT) AS b_n, CAST(coalesce(sum(n) FILTER (side='c'), 0) AS BIGINT) AS c_n
        FROM x_dist JOIN x_sides USING (session_id, deployment_version, environment) GROUP BY {P}, kind, key""",
    "x_jsd": DISTANCES,
    "x_emd": f"""SELECT {P}, sum(coalesce(abs(fb-fc)*(nv-latency_ms), 0.0)) AS emd FROM (
        SELECT {P}, latency_ms, lead(latency_ms) OVER w AS nv, sum(kb) OVER w / sum(kb) OVER (PARTITION BY {P}) AS fb,
          sum(kc) OVER w / sum(kc) OVER (PARTITION BY {P}) AS fc FROM (
            SELECT {P}, latency_ms, count(*) FILTER (side='b') AS kb, count(*) FILTER (side='c') AS kc
            FROM x_runs JOIN x_sides USING (session_id, deployment_version, environment) GROUP BY {P}, latency_ms)
        WINDOW w AS (PARTITION BY {P} ORDER BY latency_ms)) GROUP BY {P}""",
    "x_wide": f"""SELECT {', '.join('q.' + c.strip() for c in P.split(','))},
        {', '.join(f'b.{c} AS b_{c}, c.{c} AS c_{c}' for c in SIDE)},
        coalesce(j.decision_jsd, 0.0) AS decision_jsd, coalesce(j.outcome_jsd, 0.0) AS outcome_jsd, coalesce(j.tool_jsd, 0.0) AS tool_jsd,
        coalesce(j.transition_distance, 0.0) AS transition_distance, e.emd AS emd
        FROM x_pairs q JOIN x_fp b ON b.session_id=q.session_id AND b.environment=q.environment AND b.deployment_version=q.baseline_version
        JOIN x_fp c ON c.session_id=q.session_id AND c.environment=q.environment AND c.deployment_version=q.current_version
        LEFT JOIN (SELECT {P}, max(jsd) FILTER (kind='sequence') AS decision_jsd, max(jsd) FILTER (kind='outcome') AS outcome_jsd,
            max(jsd) FILTER (kind='tool') AS tool_jsd, max(js_distance) FILTER (kind='bigram') AS transition_distance FROM x_jsd GROUP BY {P}) j
          ON j.session_id=q.session_id AND j.environment=q.environment AND j.baseline_version=q.baseline_version AND j.current_version=q.current_version
        LEFT JOIN x_emd e ON e.session_id=q.session_id AND e.environment=q.environment AND e.baseline_version=q.baseline_version AND e.current_version=q.current_version""",
    "x_dims": " UNION ALL ".join(
        f"SELECT {P}, '{d}' AS dim, CAST({s} AS DOUBLE) AS score, CAST({t} AS DOUBLE) AS term FROM x_wide" for d, (s, t) in SCORES.items()
    ),
    "x_drift": f"""SELECT *, least(baseline_n, current_n) AS n,
        CASE WHEN least(baseline_n, current_n)<15 THEN 'TIER1' WHEN least(baseline_n, current_n)<50 THEN 'TIER2' ELSE 'TIER3' END AS tier,
        CASE WHEN drift_score>=0.5*factor THEN 'critical' WHEN drift_score>=0.35*factor THEN 'significant'
             WHEN drift_score>=0.2*factor THEN 'moderate' WHEN drift_score>=0.1*factor THEN 'low' ELSE 'none' END AS severity
        FROM (SELECT *, CASE WHEN least(baseline_n, current_n)>=50 THEN 1.0 ELSE 1.0+(ln(50)-ln(least(baseline_n, current_n)))/ln(50) END AS factor FROM (
          SELECT {P}, b_n AS baseline_n, c_n AS current_n, {', '.join(f'CAST({s} AS DOUBLE) AS {d}' for d, (s, _) in SCORES.items())},
            CASE WHEN decision_jsd>0.3 THEN greatest({clamp(total(K.FALLBACK_WEIGHTS))}, 0.15) ELSE {clamp(total(K.FALLBACK_WEIGHTS))} END AS drift_score
          FROM x_wide))""",
    "x_decided": f"""SELECT *, CASE WHEN tier<>'TIER3' THEN NULL WHEN drift_score>0.42 OR decision_drift>0.40 THEN 'BLOCK'
          WHEN drift_score>0.28 OR decision_drift>0.25 THEN 'REVIEW' WHEN drift_score>0.15 THEN 'MONITOR' ELSE 'SHIP' END AS verdict,
        CASE severity WHEN 'critical' THEN 'BLOCK' WHEN 'significant' THEN 'REVIEW' WHEN 'moderate' THEN 'MONITOR' ELSE 'SHIP' END AS severity_verdict
        FROM x_drift""",
    "x_weights": f"SELECT * FROM {values([(d, float(w)) for d, w in K.FALLBACK_WEIGHTS.items()], 'dim, weight')}",
    "x_order": f"SELECT * FROM {values([(d, i + 1) for i, d in enumerate(K.DIMS)], 'dim, pos')}",
    "x_scores": "",
}


def _long(exprs: dict[str, str], source: str, keys: str) -> str:
    return " UNION ALL ".join(f"SELECT {keys}, '{d}' AS dim, CAST({e} AS DOUBLE) AS score FROM {source}" for d, e in exprs.items())


VECTOR = {
    "decision_drift": "CASE WHEN len(tools)>0 THEN len(list_distinct(tools))/len(tools) ELSE 0.0 END",
    "tool_sequence": "least(1.0, tool_call_count/20.0::DOUBLE)",
    "tool_distribution": "CASE WHEN len(tools)>0 THEN len(list_distinct(tools))/len(tools) ELSE 0.0 END",
    "latency": "least(1.0, latency_ms/5000.0::DOUBLE)",
    "error_rate": "least(1.0, error_count/10.0::DOUBLE)",
    "loop_depth": "least(1.0, loop_count/20.0::DOUBLE)",
    "verbosity_ratio": "greatest(0.0, least(1.0, verbosity_ratio))",
    "retry_rate": "least(1.0, retry_count/5.0::DOUBLE)",
    "output_length": "least(1.0, output_length/10000.0::DOUBLE)",
    "time_to_first_tool": "least(1.0, time_to_first_tool_ms/5000.0::DOUBLE)",
    "semantic_drift": "0.0",
    "tool_sequence_transitions": "0.0",
}
TOOLS_ZERO = "CASE WHEN len(tools)>0 THEN 0.0 END"
CALIBRATION = {
    **VECTOR,
    "decision_drift": TOOLS_ZERO,
    "tool_sequence": TOOLS_ZERO,
    "tool_distribution": TOOLS_ZERO,
    "latency": "CASE WHEN latency_ms>0 THEN least(1.0, latency_ms/5000.0::DOUBLE) END",
    "verbosity_ratio": "least(1.0, verbosity_ratio)",
}
CTES["x_scores"] = f"SELECT * FROM ({_long(CALIBRATION, 'x_runs', G + ', id')}) WHERE score IS NOT NULL"
CTES["x_stats"] = f"""SELECT *, 1/(1+cv) AS reliability FROM (SELECT *, CASE WHEN mean>0 THEN std/mean ELSE 0.0 END AS cv FROM (
    SELECT *, CASE WHEN sigma=0 THEN 0.01 ELSE sigma END AS std FROM (
      SELECT {G}, dim, count(*) AS n_values, avg(score) AS mean, stddev_pop(score) AS sigma FROM x_scores GROUP BY ALL)))"""
CTES["x_presets"] = f"SELECT * FROM {values([(u, d, float(w)) for u, ws in K.PRESETS.items() for d, w in zip(K.PRESET_DIMS, ws, strict=True)], 'use_case, dim, preset')}"
CTES["x_relw"] = f"""SELECT {G}, dim, preset*reliability/sum(preset*reliability) OVER (PARTITION BY {G}) AS weight
    FROM x_stats JOIN (SELECT dim, preset FROM x_presets WHERE use_case='GENERAL') USING (dim)"""
CTES["x_metrics"] = f"""SELECT {G}, count(*) AS n, avg(latency_ms) AS avg_latency, avg(prompt_tokens) AS avg_prompt_tokens,
    avg(completion_tokens) AS avg_completion_tokens, avg(loop_count) AS avg_loop_count, avg(retry_count) AS avg_retry_count,
    (count(*) FILTER (error_count>0))/count(*) AS error_rate, (count(*) FILTER (semantic_cluster='escalated'))/count(*) AS escalation_rate,
    avg(tool_call_count) AS avg_tool_count,
    CASE WHEN count(*)>1 THEN list_sort(list(latency_ms))[CAST(floor(count(*)*0.95::DOUBLE) AS BIGINT)+1] ELSE 0 END AS p95_latency
    FROM x_runs GROUP BY {G}"""
CTES["x_signals"] = """SELECT session_id, count(*) AS n, (count(*) FILTER (error_count>0))/count(*) AS escalation_rate,
    (count(*) FILTER (error_count=0))/count(*) AS resolution_rate, avg(error_count) AS error_rate,
    (count(*) FILTER (retry_count>2))/count(*) AS fallback_rate, avg(loop_count) AS avg_loop_depth, avg(tool_call_count) AS avg_tool_count,
    avg(output_length) AS avg_output_length, avg(verbosity_ratio) AS avg_verbosity_ratio, avg(retry_count) AS avg_retry_rate,
    coalesce(avg(time_to_first_tool_ms) FILTER (time_to_first_tool_ms>0), 0.0) AS avg_time_to_first_tool,
    coalesce(quantile_cont(latency_ms, 0.95) FILTER (latency_ms>0), 0.0) AS avg_latency_p95 FROM x_runs GROUP BY session_id"""


def sql(body: str) -> str:
    """The body with every table expression it needs, directly or through others."""
    needed: set[str] = set()
    todo = [body]
    while todo:
        for name in re.findall(r"\bx_[a-z_0-9]+\b", todo.pop()):
            if name in CTES and name not in needed:
                needed.add(name)
                todo.append(CTES[name])
    order: list[str] = []

    def place(name: str) -> None:
        if name in order:
            return
        for dep in re.findall(r"\bx_[a-z_0-9]+\b", CTES[name]):
            if dep in CTES and dep != name:
                place(dep)
        order.append(name)

    for name in needed:
        place(name)
    if not order:
        return body
    form = lambda n: f"{n} AS ({CTES[n]})" if n.startswith("x_rec_") else f"{n} AS MATERIALIZED ({CTES[n]})"
    return "WITH RECURSIVE " + ",\n".join(form(n) for n in order) + "\n" + body
