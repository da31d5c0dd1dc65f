"""Comparisons, tests, calibration and decisions over pairs of versions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.functions import constants as K
from tidemark.operators import anomaly, budget, calibrate, calibrated, compare, decide, distance, fingerprint, resample, significance, usecase
from tidemark.operators import pairs as pairs_ops
from tidemark.plans import oracle as O
from tidemark.plans.oracle import G, P, SCORES, VECTOR, clamp, r, sigmoid, values
from tidemark.plans.queries_fingerprint import BUCKET, changes, with_prompt
from tidemark.plans.registry import query, ts
from tidemark.sources import runs as runs_io

AS_OF = datetime(2024, 2, 1)


def memo(name):
    """Derived once per workspace and kept as a table."""

    def wrap(fn):
        def get(w):
            key = f"_kept_{name}"
            if not hasattr(w, key):
                setattr(w, key, w.keep(fn(w), name))
            return getattr(w, key)

        return get

    return wrap


@memo("dims")
def dims(w):
    return compare.drift_dim(w.wide)


@memo("scored")
def scored(w):
    return compare.drift(w.wide)


@memo("decided")
def decided(w):
    return decide.verdict(scored(w)).drop("failed_checks")


@memo("stats")
def stats(w):
    return calibrate.dim_stats(w.runs)


@memo("metrics")
def metrics(w):
    return fingerprint.run_metrics(w.runs)


@memo("signals")
def signals(w):
    return fingerprint.behaviour_signals(w.runs)


@memo("tool_diff")
def tool_diff(w):
    return compare.tool_frequency_diff(w.dist, w.pairs)


@memo("attributed")
def attributed(w):
    return significance.attribution(dims(w), scored(w), significance.fallback_weights(w.spark))


def sizes(w):
    return w.wide.select(*K.PAIR, "b_n", "c_n")


def general(w):
    return usecase.presets(w.spark).where("use_case = 'GENERAL'").drop("use_case")


# ---- joins -------------------------------------------------------------------------------------
query("j2_share_distributions", f"SELECT {P}, kind, key, {r('p')} AS p, {r('q')} AS q, b_n, c_n FROM x_shares")(
    lambda w: distance.share_table(w.dist, w.pairs)
)
query("j3_fingerprints_to_pairs", f"SELECT {P}, b_n, c_n, {r('b_error_rate')} AS b_error_rate, {r('c_error_rate')} AS c_error_rate FROM x_wide")(
    lambda w: pairs_ops.both_sides(w.fp, w.pairs, ["n", "error_rate"])
)

# ---- distances and scores ----------------------------------------------------------------------
query("d1_jsd", f"SELECT {P}, kind, {r('jsd')} AS jsd, {r('js_distance')} AS js_distance FROM x_jsd")(
    lambda w: distance.jsd_table(distance.share_table(w.dist, w.pairs))
)
query(
    "d1_jsd_orders",
    f"""SELECT baseline_version, current_version, session_id, {r(clamp('sum(0.5*((CASE WHEN p>0 THEN p*ln(p/((p+q)/2)) ELSE 0.0 END)+(CASE WHEN q>0 THEN q*ln(q/((p+q)/2)) ELSE 0.0 END)))/0.6931471805599453'))} AS jsd FROM (
    SELECT session_id, baseline_version, current_version, semantic_cluster, coalesce(sum(share) FILTER (v=baseline_version),0.0) AS p, coalesce(sum(share) FILTER (v=current_version),0.0) AS q FROM
      (SELECT o_orderpriority AS session_id, CAST(year(o_orderdate) AS VARCHAR) AS v, o_orderstatus AS semantic_cluster, count(*)/sum(count(*)) OVER (PARTITION BY o_orderpriority, year(o_orderdate)) AS share
       FROM orders GROUP BY o_orderpriority, year(o_orderdate), o_orderstatus)
      JOIN (SELECT o_orderpriority AS session_id, CAST(year(o_orderdate) AS VARCHAR) AS current_version,
              lag(CAST(year(o_orderdate) AS VARCHAR)) OVER (PARTITION BY o_orderpriority ORDER BY min(o_orderdate)) AS baseline_version FROM orders GROUP BY o_orderpriority, year(o_orderdate))
        USING (session_id) WHERE baseline_version IS NOT NULL AND v IN (baseline_version, current_version) GROUP BY ALL) GROUP BY ALL""",
)(
    lambda w: distance.jsd_table(
        distance.share_table(fingerprint.fp_dist(w.order_runs, K.GROUP, ("outcome",)), pairs_ops.consecutive_pairs(w.order_runs))
    ).select("session_id", "baseline_version", "current_version", "jsd")
)
query("d2_js_distance", f"SELECT {P}, {r('js_distance')} AS transition_distance FROM x_jsd WHERE kind='bigram'")(
    lambda w: distance.jsd_table(distance.share_table(w.dist.where("kind = 'bigram'"), w.pairs)).select(
        *K.PAIR, F.col("js_distance").alias("transition_distance")
    )
)
query("d3_emd", f"SELECT {P}, {r('emd')} AS emd FROM x_emd")(lambda w: distance.emd(w.runs, w.pairs))
query(
    "d4_emd_signal",
    f"SELECT {P}, {r('CASE WHEN emd=0 THEN 0.0 ELSE ' + clamp('1.0/(1.0+pow(2.718281828::DOUBLE,-0.002::DOUBLE*(emd-500.0)))') + ' END')} AS signal FROM x_emd",
)(lambda w: w.wide.select(*K.PAIR, C.emd_signal(F.col("emd")).alias("signal")))
query("d5_anchored_sigmoid", f"SELECT id, {r(sigmoid('latency_ms/1000.0::DOUBLE', 2.0, 1.0))} AS y FROM x_runs")(
    lambda w: w.runs.select("id", C.anchored_sigmoid(F.col("latency_ms") / 1000.0, 2.0, 1.0).alias("y"))
)
query("d6_drift_dim", f"SELECT {P}, dim, {r('score')} AS score, {r('term')} AS term FROM x_dims")(lambda w: compare.drift_dim(w.wide))
query("d7_composite", f"SELECT {P}, {r('drift_score')} AS drift_score, {r('decision_drift')} AS decision_drift FROM x_drift")(
    lambda w: compare.composite(dims(w))
)
query(
    "d7_drift_end_to_end",
    f"SELECT {P}, baseline_n, current_n, {', '.join(f'{r(d)} AS {d}' for d in K.DIMS)}, {r('drift_score')} AS drift_score, severity, tier FROM x_drift",
)(lambda w: compare.drift(compare.prepared(w.runs)[1]))
RESAMPLE = {
    "decision": "decision_jsd", "latency": sigmoid(O.REL("p95_latency_ms"), 2.0, 1.0),
    "errors": sigmoid("least(1.0,2*abs(c_error_rate-b_error_rate))", 4.0, 0.3), "semantic": sigmoid("outcome_jsd", 4.0, 0.3),
    "output": sigmoid(f"least(1.0,{O.REL('avg_output_length')})", 3.0, 0.3),
    "verbosity": sigmoid("abs(c_avg_verbosity_ratio-b_avg_verbosity_ratio)", 3.0, 0.3), "loop": sigmoid(O.REL("p95_loop_count"), 2.5, 0.4),
    "output_length": sigmoid(O.REL("avg_output_length"), 2.0, 0.4), "tool_sequence": "decision_jsd",
    "retry": sigmoid("abs(c_avg_retry_count-b_avg_retry_count)", 4.0, 0.2),
}
FIXED = clamp("+".join(f"{w!r}::DOUBLE*{RESAMPLE[n]}" for n, w in K.RESAMPLE_WEIGHTS.items()))
query("d8_fixed_composite", f"SELECT {P}, {r(FIXED)} AS composite FROM x_wide")(
    lambda w: w.wide.select(*K.PAIR, compare.resample_composite().alias("composite"))
)
query("d9_severity", f"SELECT {P}, severity, {r('factor')} AS factor FROM x_drift")(
    lambda w: scored(w).select(
        *K.PAIR,
        C.severity(F.col("drift_score"), F.least("baseline_n", "current_n")).alias("severity"),
        F.when(F.least("baseline_n", "current_n") >= 50, 1.0)
        .otherwise(2.0 - F.ln(F.least("baseline_n", "current_n").cast("double")) / F.ln(F.lit(50.0)))
        .alias("factor"),
    )
)
CLUSTER = f"""SELECT {P}, cluster, bn AS baseline_n, cn AS current_n, {r(clamp('0.4*least(1.0,lat)+0.4*least(1.0,2*err)+0.2*least(1.0,vr)'))} AS cluster_score,
    array_to_string(list_transform(list_sort([{{'m': -lat, 'p': 0, 'name': 'latency_p95'}}, {{'m': -err, 'p': 1, 'name': 'error_rate'}}, {{'m': -vr, 'p': 2, 'name': 'tool_variance'}}]), lambda x: x.name), ',') AS contributors
    FROM (SELECT {P}, cluster, bn, cn, abs(c95-b95)/greatest(b95, 1.0) AS lat, abs(ce-be) AS err, abs(cv-bv) AS vr FROM (
      SELECT {P}, cluster, max(n) FILTER (side='b') AS bn, max(n) FILTER (side='c') AS cn, max(p95) FILTER (side='b') AS b95, max(p95) FILTER (side='c') AS c95,
        max(error_rate) FILTER (side='b') AS be, max(error_rate) FILTER (side='c') AS ce, max(variance) FILTER (side='b') AS bv, max(variance) FILTER (side='c') AS cv
      FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {G} ORDER BY n DESC, cluster) AS rn FROM (
          SELECT {G}, coalesce(tools[1],'unknown')||':'||{BUCKET} AS cluster, count(*) AS n, sum(error_count)/count(*) AS error_rate,
            count(DISTINCT CAST(to_json(tools) AS VARCHAR))/count(*) AS variance, {O.percentile('latency_ms', 95)} AS p95 FROM x_runs GROUP BY {G}, cluster)) WHERE rn<=5)
      JOIN x_sides USING (session_id, deployment_version, environment) GROUP BY {P}, cluster) WHERE bn>=10 AND cn>=10)"""
query("d10_cluster_drift", CLUSTER)(lambda w: compare.cluster_drift(with_prompt(w.runs), w.pairs))
query("j4_common_clusters", f"SELECT {P}, cluster FROM ({CLUSTER})")(
    lambda w: compare.cluster_drift(with_prompt(w.runs), w.pairs).select(*K.PAIR, "cluster")
)
CHANGE = "CASE WHEN p=0 THEN CASE WHEN q>0 THEN 100.0 ELSE 0.0 END ELSE (q*100-p*100)/(p*100)*100 END"
O.CTES["x_tooldiff"] = f"""SELECT {P}, key AS tool, b_n AS baseline_count, c_n AS current_count, round_even(p*100, 2) AS baseline_pct, round_even(q*100, 2) AS current_pct,
    round_even({CHANGE}, 1) AS delta_pct, c_n-b_n AS delta_abs FROM x_shares WHERE kind='tool'"""
query("d11_tool_frequency_diff", f"SELECT {P}, tool, baseline_count, current_count, {r('baseline_pct')} AS baseline_pct, {r('current_pct')} AS current_pct, {r('delta_pct')} AS delta_pct, delta_abs FROM x_tooldiff")(
    lambda w: compare.tool_frequency_diff(w.dist, w.pairs)
)
query(
    "d12_transition_shifts",
    f"""SELECT {P}, position, key AS transition, {r('round_even(p*100, 2)')} AS baseline_pct, {r('round_even(q*100, 2)')} AS current_pct, {r('round_even((q-p)*100, 1)')} AS delta_pct FROM (
    SELECT *, row_number() OVER (PARTITION BY {P} ORDER BY abs(round_even((q-p)*100, 1)) DESC, key) AS position FROM x_shares WHERE kind='bigram') WHERE position<=3""",
)(lambda w: compare.transition_shifts(w.dist, w.pairs))
query(
    "t3_top_shifts",
    f"""SELECT {P}, position, key AS transition, {r('round_even((q-p)*100, 1)')} AS delta_pct FROM (
    SELECT *, row_number() OVER (PARTITION BY {P} ORDER BY abs(round_even((q-p)*100, 1)) DESC, key) AS position FROM x_shares WHERE kind='bigram') WHERE position<=10""",
)(lambda w: compare.transition_shifts(w.dist, w.pairs, 10).select(*K.PAIR, "position", "transition", "delta_pct"))
UPDOWN = lambda x, cut: f"CASE WHEN abs({x})>{cut} THEN CASE WHEN {x}>0 THEN 'up' ELSE 'down' END END"
STRENGTH = lambda x: f"CASE WHEN {x}>0.2 THEN 'up' WHEN {x}>0.1 THEN 'changed' END"
RELATIVE = lambda x: f"(CASE WHEN b_{x}>0 THEN (c_{x}-b_{x})/b_{x} END)"
SIGNAL_SQL = {
    "decision_patterns": STRENGTH("decision_jsd"),
    "latency": UPDOWN("((c_p95_latency_ms-greatest(b_p95_latency_ms,1))/greatest(b_p95_latency_ms,1))", 0.1),
    "error_rate": UPDOWN("(c_error_rate-b_error_rate)", 0.05),
    "verbosity": UPDOWN(RELATIVE("avg_verbosity_ratio"), 0.15),
    "reasoning_depth": UPDOWN(RELATIVE("p95_loop_count"), 0.2),
    "outcome_patterns": STRENGTH("outcome_jsd"),
}
query(
    "d13_indicative_signals",
    "SELECT * FROM (" + " UNION ALL ".join(f"SELECT {P}, '{k}' AS signal, {v} AS direction FROM x_wide" for k, v in SIGNAL_SQL.items()) + ") WHERE direction IS NOT NULL",
)(lambda w: compare.indicative_signals(w.wide))
SHIFT = lambda kind: f"""SELECT {P}, key, p*100 AS baseline_pct, q*100 AS current_pct,
    CASE WHEN p*100<0.1 THEN 'appeared' WHEN q*100<0.1 THEN 'vanished' WHEN q>p THEN 'increased' ELSE 'decreased' END AS change FROM (
    SELECT *, row_number() OVER (PARTITION BY {P} ORDER BY abs(q-p) DESC, key) AS rn FROM x_shares WHERE kind='{kind}') WHERE rn=1 AND abs(q-p)>0"""  # noqa: E731
O.CTES["x_seqshift"], O.CTES["x_outshift"] = SHIFT("sequence"), SHIFT("outcome")
for kind, cte in (("sequence", "x_seqshift"), ("outcome", "x_outshift")):
    query(f"d14_largest_share_shift_{kind}", f"SELECT {P}, key, {r('baseline_pct')} AS baseline_pct, {r('current_pct')} AS current_pct, change FROM {cte}")(
        lambda w, kind=kind: compare.largest_share_shift(w.dist, w.pairs, kind)
    )
WORD = lambda b, c: f"CASE WHEN {c}>{b} THEN 'increased' ELSE 'decreased' END"
PLUS = lambda b, c: f"CASE WHEN {c}>{b} THEN '+' ELSE '' END"


def rate_sql(label: str, col: str, tail: str) -> str:
    b, c = f"b_{col}*100", f"c_{col}*100"
    return f"printf('{label} %s from %.1f%% to %.1f%%{tail} (%s%.1fpp)', {WORD(b, c)}, {b}, {c}, {PLUS(b, c)}, {c}-{b})"


def moved_sql(label: str, col: str, spec: str, unit: str) -> str:
    b, c = f"b_{col}", f"c_{col}"
    return (
        f"CASE WHEN {b}=0 THEN format('{label} changed to {spec}{unit}', {c}) ELSE format('{label} {{}} from {spec} to {spec}{unit} ({{}}{{:+.0f}}%)', "
        f"{WORD(b, c)}, {b}, {c}, {PLUS(b, c)}, ({c}-{b})/{b}*100) END"
    )


PATH = "'['||array_to_string(CAST(json(s.key) AS VARCHAR[]), ', ')||']'"
DECISION = f"""CASE WHEN s.key IS NULL THEN 'Tool sequence distribution changed' WHEN s.change='appeared' THEN printf('New tool path %s appeared in %.1f%% of runs', {PATH}, s.current_pct)
    WHEN s.change='vanished' THEN printf('Tool path %s dropped from %.1f%% to near 0%%', {PATH}, s.baseline_pct)
    ELSE printf('Tool path %s %s from %.1f%% to %.1f%% of runs', {PATH}, s.change, s.baseline_pct, s.current_pct) END"""
L = "w.b_p95_latency_ms", "w.c_p95_latency_ms"
LATENCY = f"""CASE WHEN {L[0]}=0 THEN format('P95 latency changed to {{:,}}ms', {L[1]})
    WHEN w.b_p50_latency_ms>0 AND abs((w.c_p50_latency_ms-w.b_p50_latency_ms)/w.b_p50_latency_ms)*100>10 THEN
      format('Median latency {{}} from {{:,}}ms to {{:,}}ms; P95 from {{:,}}ms to {{:,}}ms', {WORD(*L)}, w.b_p50_latency_ms, w.c_p50_latency_ms, {L[0]}, {L[1]})
    ELSE format('P95 latency {{}} from {{:,}}ms to {{:,}}ms ({{}}{{:+.0f}}%)', {WORD(*L)}, {L[0]}, {L[1]}, {PLUS(*L)}, ({L[1]}-{L[0]})/{L[0]}*100) END"""
OUTCOMES = """CASE WHEN o.key IS NULL THEN 'Semantic cluster distribution changed' ELSE printf('Semantic cluster ''%s'' %s from %.1f%% to %.1f%% of outcomes', o.key,
    CASE WHEN o.current_pct>o.baseline_pct THEN 'grew' ELSE 'shrank' END, o.baseline_pct, o.current_pct) END"""
SENTENCES = {
    "decision_drift": DECISION,
    "semantic_drift": OUTCOMES,
    "latency": LATENCY,
    "error_rate": rate_sql("Error rate", "error_rate", ""),
    "tool_distribution": DECISION,
    "verbosity_ratio": moved_sql("Verbosity ratio", "avg_verbosity_ratio", "{:.2f}", ""),
    "loop_depth": moved_sql("Average loop depth", "avg_loop_count", "{:.1f}", " iterations"),
    "output_length": moved_sql("Average output length", "avg_output_length", "{:,.0f}", " chars"),
    "tool_sequence": DECISION,
    "retry_rate": rate_sql("Retry rate", "avg_retry_count", " of runs"),
    "time_to_first_tool": moved_sql("Time to first tool", "avg_time_to_first_tool_ms", "{:,.0f}", "ms"),
    "tool_sequence_transitions": DECISION,
}
PW = ", ".join("w." + c.strip() for c in P.split(","))
ON = lambda a, b: " AND ".join(f"{a}.{c.strip()}={b}.{c.strip()}" for c in P.split(","))
query(
    "d15_evidence",
    " UNION ALL ".join(
        f"SELECT {PW}, '{d}' AS dim, {e} AS evidence FROM x_wide w LEFT JOIN x_seqshift s ON {ON('w', 's')} LEFT JOIN x_outshift o ON {ON('w', 'o')}"
        for d, e in SENTENCES.items()
    ),
)(
    lambda w: compare.evidence(
        w.wide, compare.largest_share_shift(w.dist, w.pairs), compare.largest_share_shift(w.dist, w.pairs, "outcome")
    )
)
GROW = lambda x: f"(c.{x}-b.{x})/nullif(b.{x},0)"
PATTERNS = f"""SELECT {P.replace('session_id', 'q.session_id').replace('environment', 'q.environment')}, {GROW('avg_completion_tokens')} AS comp, {GROW('avg_prompt_tokens')} AS prom, {GROW('avg_loop_count')} AS loops,
    {GROW('avg_retry_count')} AS retries, -({GROW('avg_tool_count')}) AS fewer, {GROW('avg_latency')} AS lat
    FROM x_pairs q JOIN x_metrics b ON b.session_id=q.session_id AND b.environment=q.environment AND b.deployment_version=q.baseline_version
    JOIN x_metrics c ON c.session_id=q.session_id AND c.environment=q.environment AND c.deployment_version=q.current_version"""
query(
    "d16_regression_pattern",
    f"""SELECT {P}, pattern, {r('confidence')} AS confidence FROM (
    SELECT {P}, 'token-bloat' AS pattern, CASE WHEN comp>1.5 THEN least(comp/3.0,1.0) END AS confidence FROM x_patterns
    UNION ALL SELECT {P}, 'loop-detection', CASE WHEN loops>2 OR retries>3 THEN least((loops+retries)/8.0,1.0) END FROM x_patterns
    UNION ALL SELECT {P}, 'tool-dropout', CASE WHEN fewer>0.2 THEN least(fewer/0.4,1.0) END FROM x_patterns
    UNION ALL SELECT {P}, 'cost-explosion', CASE WHEN comp+prom>2 THEN least((comp+prom)/4.0,1.0) END FROM x_patterns
    UNION ALL SELECT {P}, 'latency-creep', CASE WHEN lat>2 THEN least(lat/4.0,1.0) END FROM x_patterns) WHERE confidence IS NOT NULL"""
    if O.CTES.setdefault("x_patterns", PATTERNS)
    else "",
)(lambda w: compare.regression_pattern(metrics(w), w.pairs))
query(
    "d17_explanation",
    f"""SELECT {P}, CASE WHEN parts='' THEN printf('Drift score %.2f exceeds threshold %.2f. Review dimension breakdown and tool changes.', drift_score, 0.2::DOUBLE)
      ELSE 'Drift driven by '||parts||'.' END AS explanation FROM (SELECT {PW}, d.drift_score, concat_ws(' and ',
      CASE WHEN m.drop_tool IS NOT NULL THEN printf('Tool ''%s'' usage dropping by %.0f%%', m.drop_tool, abs(m.drop_pct)) END,
      CASE WHEN m.rise_tool IS NOT NULL THEN printf('Tool ''%s'' usage increasing by %.0f%%', m.rise_tool, m.rise_pct) END,
      CASE WHEN w.c_p95_latency_ms-w.b_p95_latency_ms>=100 THEN printf('Latency increasing by %dms', w.c_p95_latency_ms-w.b_p95_latency_ms)
           WHEN w.c_p95_latency_ms-w.b_p95_latency_ms<=-100 THEN printf('Latency decreasing by %dms', w.b_p95_latency_ms-w.c_p95_latency_ms) END,
      CASE WHEN d.error_rate>=0.2 THEN 'Error rate increased significantly' END) AS parts
    FROM x_wide w JOIN x_drift d ON {ON('w', 'd')} LEFT JOIN (SELECT {P}, (list(tool ORDER BY delta_pct, tool) FILTER (delta_pct<-5))[1] AS drop_tool, min(delta_pct) FILTER (delta_pct<-5) AS drop_pct,
      (list(tool ORDER BY delta_pct DESC, tool) FILTER (delta_pct>20))[1] AS rise_tool, max(delta_pct) FILTER (delta_pct>20) AS rise_pct FROM x_tooldiff GROUP BY {P}) m ON {ON('w', 'm')}
    WHERE d.drift_score>=0.2)""",
)(lambda w: compare.explanation(w.wide, scored(w), tool_diff(w)))
O.CTES["x_moves"] = f"""SELECT {P}, (list(key ORDER BY ch, key) FILTER (ch<-20))[1] AS fallen_tool, min(ch) FILTER (ch<-20) AS fall_pct,
    (list(key ORDER BY ch DESC, key) FILTER (ch>50))[1] AS risen_tool, max(ch) FILTER (ch>50) AS rise_pct
    FROM (SELECT *, CASE WHEN p=0 THEN 100.0 ELSE (q*100-p*100)/(p*100)*100 END AS ch FROM x_shares WHERE kind='tool') GROUP BY {P}"""
NR = lambda x: f"CASE WHEN {x} IS NULL THEN NULL ELSE {r(x)} END"
query("d18_biggest_tool_moves", f"SELECT {P}, fallen_tool, {NR('fall_pct')} AS fall_pct, risen_tool, {NR('rise_pct')} AS rise_pct FROM x_moves")(
    lambda w: compare.biggest_tool_moves(w.dist, w.pairs)
)

# ---- tests -------------------------------------------------------------------------------------
TAIL = lambda z: f"(CASE WHEN {z}>3 THEN 0.001 WHEN {z}>2.5 THEN 0.01 WHEN {z}>2.0 THEN 0.025 WHEN {z}>1.96 THEN 0.05 WHEN {z}>1.0 THEN 0.16 ELSE 0.5 END)"
CUT = "CASE df " + " ".join(f"WHEN {d} THEN {v}" for d, v in K.CHI2_CRITICAL.items()) + " ELSE 3.84 END"


def chi2_sql(source: str) -> str:
    """Textbook form: squared gaps to the expected counts, summed over labels and sides."""
    return f"""SELECT {P}, statistic, df, CASE WHEN df<=0 THEN 1.0 WHEN df>30 THEN {TAIL('(statistic-df)/sqrt(2*df)')} WHEN statistic>{CUT} THEN 0.01 ELSE 0.1 END AS p_value, sqrt(statistic/n) AS effect_size FROM (
      SELECT {P}, max(tb+tc) AS n, count(*)-1 AS df, sum((b_n-lab*tb/(tb+tc))*(b_n-lab*tb/(tb+tc))/(lab*tb/(tb+tc)) + (c_n-lab*tc/(tb+tc))*(c_n-lab*tc/(tb+tc))/(lab*tc/(tb+tc))) AS statistic FROM (
        SELECT *, b_n+c_n AS lab, sum(b_n) OVER (PARTITION BY {P}) AS tb, sum(c_n) OVER (PARTITION BY {P}) AS tc FROM {source}) GROUP BY {P})"""


O.CTES["x_chi_out"] = chi2_sql(f"(SELECT {P}, key, b_n, c_n FROM x_shares WHERE kind='outcome')")
O.CTES["x_chi_err"] = chi2_sql(
    f"(SELECT {P}, error_count>0 AS key, count(*) FILTER (side='b') AS b_n, count(*) FILTER (side='c') AS c_n FROM x_runs JOIN x_sides USING ({G}) GROUP BY {P}, error_count>0)"
)
O.CTES["x_welch"] = f"""SELECT {P}, statistic, CAST(trunc(df) AS BIGINT) AS df, CASE WHEN df<=0 THEN 1.0 WHEN df>30 THEN 2*{TAIL('abs(statistic)')} WHEN abs(statistic)>2.5 THEN 0.01 WHEN abs(statistic)>2 THEN 0.05
      WHEN abs(statistic)>1.5 THEN 0.1 ELSE 0.2 END AS p_value, CASE WHEN pooled>0 THEN abs(m1-m2)/pooled ELSE 0.0 END AS effect_size FROM (
    SELECT *, (m1-m2)/sqrt(v1/n1+v2/n2) AS statistic, (v1/n1+v2/n2)*(v1/n1+v2/n2)/((v1/n1)*(v1/n1)/(n1-1)+(v2/n2)*(v2/n2)/(n2-1)) AS df, sqrt(((n1-1)*v1+(n2-1)*v2)/(n1+n2-2)) AS pooled FROM (
      SELECT {P}, CAST(count(*) FILTER (side='b') AS DOUBLE) AS n1, CAST(count(*) FILTER (side='c') AS DOUBLE) AS n2, avg(latency_ms) FILTER (side='b') AS m1, avg(latency_ms) FILTER (side='c') AS m2,
        var_samp(latency_ms) FILTER (side='b') AS v1, var_samp(latency_ms) FILTER (side='c') AS v2 FROM x_runs JOIN x_sides USING ({G}) WHERE latency_ms>0 GROUP BY {P}))"""
TEST = f"{P}, {r('statistic')} AS statistic, df, {r('p_value')} AS p_value, {r('effect_size')} AS effect_size, p_value<0.05 AS significant"
query("q1_chi2_test", f"SELECT {TEST} FROM x_chi_out")(lambda w: significance.chi2_test(significance.outcome_counts(w.dist, w.pairs)))
query("q2_welch_t", f"SELECT {TEST} FROM x_welch")(lambda w: significance.welch_t(w.runs.where("latency_ms > 0"), w.pairs))
query(
    "q3_significance",
    f"SELECT {TEST}, 'outcomes' AS test FROM x_chi_out UNION ALL SELECT {TEST}, 'latency' FROM x_welch UNION ALL SELECT {TEST}, 'errors' FROM x_chi_err",
)(lambda w: significance.significance(w.runs, w.dist, w.pairs))
O.CTES["x_attr"] = f"""SELECT {P}, dim, drift_score-(sum(weight*score) OVER (PARTITION BY {P})-weight*score) AS attribution, score
    FROM x_dims JOIN x_weights USING (dim) JOIN (SELECT {P}, drift_score FROM x_drift) USING ({P})"""
query("q10_attribution", f"SELECT {P}, dim, {r('attribution')} AS attribution FROM x_attr")(
    lambda w: significance.attribution(dims(w), scored(w), significance.fallback_weights(w.spark))
)
query("q11_marginal", f"SELECT {P}, dim, {r('weight*score')} AS marginal, {r('weight*term')} AS term_share FROM x_dims JOIN x_weights USING (dim)")(
    lambda w: significance.marginal(dims(w), significance.fallback_weights(w.spark))
)
O.CTES["x_top"] = f"""SELECT * FROM (SELECT {P}, dim, attribution, score, row_number() OVER (PARTITION BY {P} ORDER BY abs(round(attribution, 9)) DESC, pos) AS position,
    abs(attribution)/sum(abs(attribution)) OVER (PARTITION BY {P})*100 AS percent FROM x_attr JOIN x_order USING (dim)) WHERE position<=3"""
query("t4_top_contributors", f"SELECT {P}, position, dim, {r('attribution')} AS attribution, {r('percent')} AS percent FROM x_top")(
    lambda w: significance.top_contributors(attributed(w))
)
query("v3_main_cause", f"SELECT {P}, printf('%s: %.3f (%.1f%% of drift)', dim, score, percent) AS cause FROM x_top WHERE position=1")(
    lambda w: decide.main_cause(significance.top_contributors(attributed(w)), dims(w))
)
Z = f"{K.Z_ALPHA + K.Z_BETA!r}::DOUBLE"
O.CTES["x_needed"] = f"""SELECT {G}, dim, CAST(CASE WHEN n_values<10 THEN 50 WHEN sigma<0.001 THEN 10 ELSE least(200, greatest(10, ceil(2*pow({Z}*sigma/0.10::DOUBLE, 2)))) END AS BIGINT) AS min_runs
    FROM (SELECT g.{G.replace(', ', ', g.')}, o.dim, coalesce(s.n_values, 0) AS n_values, coalesce(s.sigma, 0.0) AS sigma FROM (SELECT DISTINCT {G} FROM x_runs) g CROSS JOIN x_order o
    LEFT JOIN x_stats s ON s.session_id=g.session_id AND s.deployment_version=g.deployment_version AND s.environment=g.environment AND s.dim=o.dim)"""
O.CTES["x_need"] = f"""SELECT {G}, greatest(30, min_runs) AS needed, dim AS limiting_dim FROM (SELECT *, row_number() OVER (PARTITION BY {G} ORDER BY min_runs DESC, pos) AS rn FROM x_needed JOIN x_order USING (dim)) WHERE rn=1"""
query("q12_min_runs", f"SELECT {G}, needed, limiting_dim FROM x_need")(lambda w: significance.min_runs(significance.min_runs_dim(stats(w))))
query("q12_min_runs_dim", f"SELECT {G}, dim, min_runs FROM x_needed")(
    lambda w: significance.min_runs_dim(calibrate.dim_stats(w.runs)).select(*K.GROUP, "dim", "min_runs")
)
O.CTES["x_status"] = f"""SELECT {PW}, n.dim, least(w.b_n, w.c_n) AS smaller_n, n.min_runs, CASE WHEN least(w.b_n, w.c_n)<15 THEN 'insufficient' WHEN least(w.b_n, w.c_n)<n.min_runs THEN 'indicative' ELSE 'reliable' END AS status
    FROM x_wide w JOIN x_needed n ON n.session_id=w.session_id AND n.environment=w.environment AND n.deployment_version=w.baseline_version"""
query("q13_dim_status", f"SELECT {P}, dim, smaller_n, min_runs, status FROM x_status")(
    lambda w: significance.dim_status(significance.min_runs_dim(stats(w)), sizes(w))
)
O.CTES["x_tiers"] = f"""SELECT *, CASE WHEN partial OR smaller_n>=needed AND smaller_n>=15 THEN 'TIER3' WHEN smaller_n<15 THEN 'TIER1' ELSE 'TIER2' END AS tier FROM (
    SELECT *, reliable_dims>=8 AND smaller_n<needed AND smaller_n>=0.8*needed AS partial FROM (
    SELECT {P}, smaller_n, needed, limiting_dim, count(*) FILTER (status='reliable') AS reliable_dims FROM x_status
    JOIN (SELECT session_id, environment, deployment_version AS baseline_version, needed, limiting_dim FROM x_need) USING (session_id, environment, baseline_version) GROUP BY ALL))"""
query("q14_tier", f"SELECT {P}, smaller_n, needed, limiting_dim, reliable_dims, partial, tier FROM x_tiers")(
    lambda w: significance.tiers(sizes(w), significance.min_runs_dim(stats(w)))
)


def epoch_marked(w):
    """Runs whose version counts as calendar-made on odd days of even agents."""
    odd = (F.dayofmonth("started_at") % 2 == 1) & F.col("session_id").isin("agent-0", "agent-2")
    return w.runs.withColumn("version_source", F.when(odd, "epoch").otherwise(F.col("version_source")))


query(
    "q15_version_source_downgrade",
    f"""SELECT {P}, tier AS tier_before, CASE WHEN epoch>0.5 THEN CASE WHEN tier='TIER3' THEN 'TIER2' ELSE 'TIER1' END ELSE tier END AS tier,
    CASE WHEN epoch>0.5 THEN 'time-bucketed' WHEN unknown>0.5 THEN 'unknown-source' ELSE 'none' END AS warning FROM x_drift JOIN (
      SELECT {P}, max(e) AS epoch, max(u) AS unknown FROM (SELECT {G}, avg(CASE WHEN vs='epoch' THEN 1.0 ELSE 0.0 END) AS e, avg(CASE WHEN vs='unknown' THEN 1.0 ELSE 0.0 END) AS u FROM (
        SELECT *, CASE WHEN day(started_at)%2=1 AND session_id IN ('agent-0','agent-2') THEN 'epoch' ELSE version_source END AS vs FROM x_runs) GROUP BY {G})
      JOIN x_sides USING ({G}) GROUP BY {P}) USING ({P})""",
)(lambda w: significance.version_source_downgrade(scored(w).select(*K.PAIR, "tier"), fingerprint.version_source_mix(epoch_marked(w))))

# ---- calibration -------------------------------------------------------------------------------
query(
    "c1_dim_stats",
    f"""SELECT g.{G.replace(', ', ', g.')}, g.n, o.dim, coalesce(s.n_values, 0) AS n_values, {r('coalesce(s.mean, 0.0)')} AS mean, {r('coalesce(s.sigma, 0.0)')} AS sigma,
    {r('coalesce(s.std, 0.01)')} AS std, {r('coalesce(s.cv, 0.0)')} AS cv, {r('coalesce(s.reliability, 1.0)')} AS reliability
    FROM (SELECT {G}, count(*) AS n FROM x_runs GROUP BY {G}) g CROSS JOIN x_order o LEFT JOIN x_stats s ON s.session_id=g.session_id AND s.deployment_version=g.deployment_version AND s.environment=g.environment AND s.dim=o.dim""",
)(lambda w: calibrate.dim_stats(w.runs))
query("c2_reliability_weights", f"SELECT {G}, dim, {r('weight')} AS weight FROM x_relw")(
    lambda w: calibrate.reliability_weights(stats(w), general(w))
)
RANKED = ["latency", "error_rate", "verbosity_ratio", "loop_depth", "output_length", "retry_rate", "time_to_first_tool"]
O.CTES["x_ranked"] = f"""SELECT {G}, id, dim, rank() OVER (PARTITION BY {G}, dim ORDER BY score) + (count(*) OVER (PARTITION BY {G}, dim, score)-1)/2 AS rk
    FROM x_scores WHERE dim IN ({', '.join(f"'{d}'" for d in RANKED)})"""
O.CTES["x_rho"] = f"""SELECT {', '.join('a.' + c.strip() for c in G.split(','))}, a.dim AS dim_a, b.dim AS dim_b, count(*) AS n_pairs, corr(a.rk, b.rk) AS rho
    FROM x_ranked a JOIN x_ranked b ON a.session_id=b.session_id AND a.deployment_version=b.deployment_version AND a.environment=b.environment AND a.id=b.id
    JOIN x_order oa ON oa.dim=a.dim JOIN x_order ob ON ob.dim=b.dim WHERE oa.pos<ob.pos GROUP BY ALL HAVING count(*)>=30 AND stddev_pop(a.rk)>0 AND stddev_pop(b.rk)>0"""
query("c3_spearman", f"SELECT {G}, dim_a, dim_b, n_pairs, {r('rho')} AS rho FROM x_rho")(lambda w: calibrate.correlations(w.runs))


@memo("rho")
def rho(w):
    return calibrate.correlations(w.runs)


@memo("relw")
def relw(w):
    return calibrate.reliability_weights(stats(w), general(w))


O.CTES["x_factors"] = f"""SELECT w.*, coalesce(f.factor, 1.0) AS factor FROM x_relw w LEFT JOIN (SELECT {G}, dim, min(factor) AS factor FROM (
    SELECT r.{G.replace(', ', ', r.')}, CASE WHEN a.weight<=b.weight THEN dim_a ELSE dim_b END AS dim, 1-least(0.5, 0.5*rho) AS factor FROM x_rho r
    JOIN x_relw a ON a.session_id=r.session_id AND a.deployment_version=r.deployment_version AND a.environment=r.environment AND a.dim=dim_a
    JOIN x_relw b ON b.session_id=r.session_id AND b.deployment_version=r.deployment_version AND b.environment=r.environment AND b.dim=dim_b WHERE rho>=0.7) GROUP BY {G}, dim) f USING ({G}, dim)"""
O.CTES["x_corrw"] = f"SELECT {G}, dim, factor, weight*factor/sum(weight*factor) OVER (PARTITION BY {G}) AS weight FROM x_factors"
query("c3_correlation_factors", f"SELECT {G}, dim, {r('factor')} AS factor, {r('weight')} AS weight FROM x_corrw")(
    lambda w: calibrate.correlation_factors(rho(w), relw(w))
)
GONE = "('semantic_drift','tool_sequence_transitions')"
O.CTES["x_redist"] = f"""SELECT {G}, dim, CASE WHEN gone THEN 0.0 WHEN freed<=0 THEN weight ELSE weight+freed*weight/kept END AS weight FROM (
    SELECT *, sum(CASE WHEN gone THEN weight ELSE 0 END) OVER (PARTITION BY {G}) AS freed, sum(CASE WHEN gone THEN 0 ELSE weight END) OVER (PARTITION BY {G}) AS kept
    FROM (SELECT *, dim IN {GONE} AS gone FROM x_corrw))"""


def gone(w):
    return w.spark.createDataFrame([("semantic_drift",), ("tool_sequence_transitions",)], "dim string")


@memo("redist")
def redist(w):
    return calibrate.redistribute(calibrate.correlation_factors(rho(w), relw(w)).drop("factor"), gone(w))


query("c4_redistribute", f"SELECT {G}, dim, {r('weight')} AS weight FROM x_redist")(
    lambda w: calibrate.redistribute(calibrate.correlation_factors(rho(w), relw(w)).drop("factor"), gone(w))
)


def learned_for(w):
    """Learned weights for two agents: twelve equal shares, known from enough and too few labels."""
    agents = w.runs.select("session_id").distinct()
    dims12 = F.explode(F.array(*[F.lit(d) for d in K.DIMS])).alias("dim")
    n = F.when(F.col("session_id") == "agent-0", 20).when(F.col("session_id") == "agent-1", 5)
    return (
        agents.where(n.isNotNull())
        .select("session_id", n.alias("n_total"), dims12)
        .select("session_id", "dim", F.lit(1.0 / 12).alias("learned_weight"), calibrate.blending_factor(F.col("n_total")).alias("learned_factor"), "n_total")
    )


FL = "(0.30+10/90.0::DOUBLE*0.40)"
query(
    "c5_learned_blend",
    f"SELECT {G}, dim, {r('raw/sum(raw) OVER (PARTITION BY ' + G + ')')} AS weight FROM (SELECT {G}, dim, CASE WHEN session_id='agent-0' THEN {FL}*(1/12.0::DOUBLE)+(1-{FL})*weight ELSE weight END AS raw FROM x_relw)",
)(lambda w: calibrate.learned_blend(relw(w), learned_for(w)))
query("c12_stale_keys", f"SELECT {G}, n, cached_n FROM (SELECT {G}, count(*) AS n, CASE WHEN deployment_version='v1' THEN NULL ELSE count(*) FILTER (day(started_at)%7<>0) END AS cached_n FROM x_runs GROUP BY {G}) WHERE cached_n IS NULL OR n>=cached_n*1.2::DOUBLE")(
    lambda w: calibrate.stale_keys(
        w.runs.where("deployment_version <> 'v1'").groupBy(*K.GROUP).agg(F.count_if(F.dayofmonth("started_at") % 7 != 0).alias("n")),
        w.runs.groupBy(*K.GROUP).agg(F.count("*").alias("n")),
        K.GROUP,
    )
)


@memo("quantiles")
def quantiles(w):
    need = stats(w).select(F.greatest(F.lit(1), F.col("n") - 1).cast("long").alias("df")).distinct()
    return calibrate.t_quantiles(w.spark, need)


@memo("cuts")
def cuts(w):
    return calibrate.dim_thresholds(stats(w), quantiles(w))


# Student's t for whole degrees of freedom has a closed form (a finite sum of powers of the cosine);
# the quantile is found by bisection in a recursive expression.
EVEN = "sin(th)*list_sum(list_transform(range(0, df//2), lambda k: exp(lgamma(k+0.5::DOUBLE)-lgamma(0.5::DOUBLE)-lgamma(k+1.0::DOUBLE))*pow(cos(th), 2*k)))"
ODD = "2/pi()*(th+CASE WHEN df=1 THEN 0.0 ELSE sin(th)*cos(th)*list_sum(list_transform(range(0, (df-1)//2), lambda k: exp(lgamma(k+1.0::DOUBLE)+lgamma(1.5::DOUBLE)-lgamma(k+1.5::DOUBLE))*pow(cos(th), 2*k))) END)"
STEP = f"""SELECT df, level, prob, CASE WHEN cdf<prob THEN mid ELSE lo END, CASE WHEN cdf<prob THEN hi ELSE mid END, i+1 FROM (
    SELECT *, 0.5+0.5*(CASE WHEN df%2=0 THEN {EVEN} ELSE {ODD} END) AS cdf FROM (SELECT *, (lo+hi)/2 AS mid, atan((lo+hi)/2/sqrt(df)) AS th FROM x_rec_t WHERE i<64))"""
LEVELS = values(list(K.THRESHOLD_PROBS.items()), "level, prob")
O.CTES["x_sized"] = f"SELECT g.*, greatest(1, g.n-1) AS df FROM (SELECT {G}, count(*) AS n FROM x_runs GROUP BY {G}) g"
O.CTES["x_rec_t"] = f"SELECT DISTINCT df, level, prob, 0.0::DOUBLE AS lo, 20000.0::DOUBLE AS hi, 0 AS i FROM x_sized, {LEVELS} UNION ALL {STEP}"
O.CTES["x_t"] = "SELECT df, level, (lo+hi)/2 AS t FROM x_rec_t WHERE i=64"
O.CTES["x_thr"] = f"""SELECT {G}, o.dim, level, coalesce(s.mean, 0.0)+t*greatest(coalesce(s.std, 0.01), 0.01) AS threshold FROM x_sized g CROSS JOIN x_order o JOIN x_t USING (df) LEFT JOIN x_stats s USING ({G}, dim)"""
query("c6_t_quantiles", f"SELECT df, level, {r('t')} AS t FROM x_t")(
    lambda w: calibrate.t_quantiles(w.spark, stats(w).select(F.greatest(F.lit(1), F.col("n") - 1).cast("long").alias("df")))
)
query("c6_dim_thresholds", f"SELECT {G}, dim, level, {r('threshold')} AS threshold FROM x_thr")(
    lambda w: calibrate.dim_thresholds(stats(w), quantiles(w))
)
VOLUME = "(CASE WHEN c_n<500 THEN 1.0 WHEN c_n<2000 THEN 0.9 WHEN c_n<10000 THEN 0.8 ELSE 0.7 END)*0.75::DOUBLE"
query(
    "c7_composite_thresholds",
    f"""SELECT {P}, CASE WHEN b_n<30 THEN 'preset' ELSE 'statistical' END AS method, {', '.join(f"{r(f'CASE WHEN b_n<30 THEN {cut}::DOUBLE ELSE {level.lower()}*{VOLUME} END')} AS {level.lower()}" for level, cut in K.COMPOSITE_CUTS.items())}
    FROM x_wide LEFT JOIN (SELECT session_id, environment, deployment_version AS baseline_version, {', '.join(f"sum(threshold*weight) FILTER (level='{level}') AS {level.lower()}" for level in K.COMPOSITE_CUTS)}
      FROM x_thr JOIN x_redist USING ({G}, dim) GROUP BY ALL) USING (session_id, environment, baseline_version)""",
)(lambda w: calibrate.composite_thresholds(cuts(w), redist(w), sizes(w), "strict"))
query(
    "c7_volume_factor",
    f"SELECT {G}, count(*) AS n, {r('CASE WHEN count(*)<500 THEN 1.0 WHEN count(*)<2000 THEN 0.9 WHEN count(*)<10000 THEN 0.8 ELSE 0.7 END')} AS factor FROM x_runs GROUP BY {G}",
)(lambda w: w.runs.groupBy(*K.GROUP).agg(F.count("*").alias("n")).withColumn("factor", calibrate.volume_factor(F.col("n"))))
query("c8_preset_fallback", f"SELECT {P}, 'preset' AS method, 0.15::DOUBLE AS monitor, 0.28::DOUBLE AS review, 0.42::DOUBLE AS block FROM x_wide WHERE b_n<30")(
    lambda w: calibrate.composite_thresholds(cuts(w), redist(w), sizes(w)).where("method = 'preset'")
)


def feedback(w):
    """A dismissal for every REVIEW or BLOCK with a decision drift, an acknowledgement otherwise."""
    bad = F.col("verdict").isin("REVIEW", "BLOCK")
    return decided(w).where("tier = 'TIER3'").select(
        "session_id",
        F.when(bad, "dismiss").otherwise("ack").alias("action"),
        F.when(F.col("latency") > 0.05, F.array(F.lit("decision_drift"), F.lit("latency"))).otherwise(F.array(F.lit("decision_drift"))).alias("dismissed_dimensions"),
    )


O.CTES["x_dismiss"] = """SELECT session_id, dim, count(*) AS dismissals FROM (SELECT session_id, unnest(CASE WHEN latency>0.05 THEN ['decision_drift','latency'] ELSE ['decision_drift'] END) AS dim
    FROM x_decided WHERE tier='TIER3' AND verdict IN ('REVIEW','BLOCK')) GROUP BY ALL"""
query("a20_dismiss_counts", "SELECT session_id, dim, dismissals FROM x_dismiss")(lambda w: calibrate.dismiss_counts(feedback(w)))
O.CTES["x_decay"] = f"""SELECT {G}, dim, weight, coalesce(dismissals, 0) AS dismissals, weight*greatest(pow(0.7::DOUBLE, coalesce(dismissals,0)), 0.1) AS adjusted
    FROM x_relw LEFT JOIN x_dismiss USING (session_id, dim)"""
query("c9_feedback_decay", f"SELECT {G}, dim, {r('weight')} AS weight, dismissals, {r('adjusted')} AS adjusted FROM x_decay")(
    lambda w: calibrate.feedback_decay(relw(w), feedback(w))
)
query("j8_feedback_with_weights", f"SELECT {G}, dim, dismissals FROM x_decay")(
    lambda w: calibrate.feedback_decay(relw(w), feedback(w)).select(*K.GROUP, "dim", "dismissals")
)
query(
    "c10_feedback_impact",
    f"SELECT {G}, dim, {r('weight')} AS weight, dismissals, {r('adjusted')} AS adjusted, {r('(weight-adjusted)/weight*100')} AS reduction_pct FROM x_decay WHERE abs(weight-adjusted)>0.001",
)(lambda w: calibrate.feedback_impact(calibrate.feedback_decay(relw(w), feedback(w))))


def day_versions(w):
    """Runs with one version per calendar day, to have enough labelled versions per agent."""
    return w.runs.withColumn("deployment_version", F.date_format("started_at", "yyyy-MM-dd")).withColumn("environment", F.lit("production"))


def outcome_labels(w):
    """Deploy outcomes: a day is bad when its agent had an error in more than half of its runs."""
    return (
        day_versions(w)
        .groupBy("session_id", "deployment_version")
        .agg(F.avg((F.col("error_count") > 0).cast("double")).alias("rate"))
        .select("session_id", "deployment_version", F.when(F.col("rate") > 0.5, "bad").otherwise("good").alias("outcome"))
    )


O.CTES["x_dayruns"] = "SELECT * REPLACE (strftime(started_at, '%Y-%m-%d') AS deployment_version, 'production' AS environment) FROM x_runs"
O.CTES["x_labels"] = """SELECT session_id, deployment_version, CASE WHEN avg(CASE WHEN error_count>0 THEN 1.0 ELSE 0.0 END)>0.5 THEN 'bad' ELSE 'good' END AS outcome FROM x_dayruns GROUP BY ALL"""
query(
    "a19_labelled_outcomes",
    "SELECT session_id, deployment_version, outcome, count(*) AS n FROM x_dayruns JOIN x_labels USING (session_id, deployment_version) GROUP BY ALL",
)(
    lambda w: day_versions(w)
    .groupBy("session_id", "deployment_version")
    .agg(F.count("*").alias("n"))
    .join(outcome_labels(w), ["session_id", "deployment_version"])
)
query("j7_outcomes_with_runs", "SELECT session_id, deployment_version, outcome FROM x_labels")(
    lambda w: outcome_labels(w).join(day_versions(w).select("session_id", "deployment_version"), ["session_id", "deployment_version"], "left_semi")
)


@memo("learned")
def learned(w):
    runs = day_versions(w)
    chosen = w.keep(calibrate.outcome_pairs(runs, outcome_labels(w)), "outcome_pairs")
    _, wide, _ = compare.prepared(runs, chosen.drop("outcome"))
    return calibrate.learn_weights(compare.drift(wide).join(chosen, K.PAIR), general(w))


query("c11_learn_weights")(learned)
query("t7_top_predictors")(lambda w: calibrate.top_predictors(learned(w)))

# ---- use cases ---------------------------------------------------------------------------------


def tool_names(w):
    """Tool names made from part names and types, per brand."""
    name = F.concat_ws("_", F.when(F.col("p_size") % 3 == 0, "search").when(F.col("p_size") % 3 == 1, "updProd"), F.regexp_replace("p_name", " ", "-"), F.lower("p_type"))
    return w.table("part").select(F.col("p_brand").alias("session_id"), name.alias("tool")).distinct()


def keywords(w):
    """A keyword table made from the part types: each type is a strong word of one use case and a weak one of another."""
    cases = F.array(*[F.lit(u) for u in usecase.ORDER])
    types = w.table("part").select(F.lower("p_type").alias("keyword")).distinct()
    place = F.length("keyword") % 13 + 1
    return types.select(F.element_at(cases, place.cast("int")).alias("use_case"), "keyword", F.lit(2).alias("points")).unionByName(
        types.select(F.element_at(cases, (place % 13 + 1).cast("int")).alias("use_case"), "keyword", F.lit(1).alias("points"))
    )


ORDERED = values([(u, i + 1) for i, u in enumerate(usecase.ORDER)], "use_case, place")
ABBR = "CASE w " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in K.ABBREVIATIONS.items()) + " ELSE w END"
O.CTES["x_tools"] = """SELECT DISTINCT p_brand AS session_id, concat_ws('_', CASE WHEN p_size%3=0 THEN 'search' WHEN p_size%3=1 THEN 'updProd' END, replace(p_name, ' ', '-'), lower(p_type)) AS tool FROM part"""
O.CTES["x_parts"] = f"""SELECT session_id, tool, list_transform(list_filter(string_split(lower(regexp_replace(replace(trim(tool), '-', '_'), '([a-z])([A-Z])', '\\1_\\2', 'g')), '_'), lambda w: length(w)>=3), lambda w: {ABBR}) AS words FROM x_tools"""
O.CTES["x_words"] = """SELECT session_id, tool, 0 AS position, array_to_string(words, ' ') AS word FROM x_parts WHERE len(words)>0
    UNION ALL SELECT session_id, tool, unnest(range(1, len(words)+1)), unnest(words) FROM x_parts"""
O.CTES["x_kw"] = f"""SELECT keyword, use_case, points FROM (SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY place, points DESC) AS rn FROM (
    SELECT o.use_case, o.place, keyword, 2 AS points FROM (SELECT DISTINCT lower(p_type) AS keyword FROM part) JOIN {ORDERED} o ON o.place=length(keyword)%13+1
    UNION ALL SELECT o.use_case, o.place, keyword, 1 FROM (SELECT DISTINCT lower(p_type) AS keyword FROM part) JOIN {ORDERED} o ON o.place=(length(keyword)%13+1)%13+1)) WHERE rn=1"""
O.CTES["x_match"] = "SELECT w.*, k.keyword, k.use_case, k.points FROM x_words w JOIN x_kw k ON contains(w.word, k.keyword)"
O.CTES["x_unmatched"] = """SELECT DISTINCT session_id, tool FROM x_words EXCEPT SELECT w.session_id, w.tool FROM x_words w JOIN (
    SELECT session_id, keyword, (list(word ORDER BY tool, position))[1] AS word FROM x_match GROUP BY session_id, keyword) f ON f.session_id=w.session_id AND f.word=w.word"""
O.CTES["x_affix"] = f"""SELECT u.session_id, a.use_case, count(*)*1.0 AS points FROM x_unmatched u JOIN x_parts p USING (session_id, tool) JOIN (
    SELECT affix, use_case, true AS pre FROM {values(K.PREFIX_POINTS, 'affix, use_case')} UNION ALL SELECT affix, use_case, false FROM {values(K.SUFFIX_POINTS, 'affix, use_case')}) a
    ON (a.pre AND starts_with(array_to_string(p.words, '_'), a.affix)) OR (NOT a.pre AND ends_with(array_to_string(p.words, '_'), a.affix)) GROUP BY ALL"""
O.CTES["x_kwscore"] = """SELECT session_id, use_case, sum(points) AS points FROM (SELECT session_id, use_case, sum(points) AS points FROM (SELECT DISTINCT session_id, use_case, keyword, points FROM x_match) GROUP BY ALL
    UNION ALL SELECT * FROM x_affix) GROUP BY ALL"""


def winner_sql(source: str, order: list[str], least: float) -> str:
    place = values([(u, i + 1) for i, u in enumerate(order)], "use_case, place")
    return f"""SELECT session_id, CASE WHEN first>={least} THEN best ELSE 'GENERAL' END AS use_case, CASE WHEN first>={least} THEN first/(first+coalesce(second,0)) ELSE 0.0 END AS confidence FROM (
      SELECT session_id, max(use_case) FILTER (rn=1) AS best, max(points) FILTER (rn=1) AS first, max(points) FILTER (rn=2) AS second FROM (
        SELECT s.*, row_number() OVER (PARTITION BY session_id ORDER BY points DESC, place) AS rn FROM {source} s JOIN {place} USING (use_case)) GROUP BY session_id)"""


O.CTES["x_kwcase"] = f"""SELECT t.session_id, CASE WHEN generic THEN 'GENERAL' ELSE coalesce(use_case,'GENERAL') END AS use_case, CASE WHEN generic THEN 0.0 ELSE coalesce(confidence, 0.0) END AS confidence
    FROM (SELECT session_id, bool_and(len(list_filter(words, lambda w: NOT list_contains({K.GENERIC_WORDS!r}, w)))=0) AS generic FROM x_parts GROUP BY session_id) t
    LEFT JOIN ({winner_sql('x_kwscore', usecase.ORDER, 3.0)}) USING (session_id)"""
query("p20_tool_words", "SELECT session_id, tool, position, word FROM x_words")(lambda w: usecase.tool_words(tool_names(w)))
query("j11_keyword_matches", "SELECT session_id, tool, position, word, keyword, use_case, points FROM x_match")(
    lambda w: usecase.keyword_matches(usecase.tool_words(tool_names(w)), usecase.first_owner(keywords(w)))
)
query("u1_keyword_use_case", f"SELECT session_id, use_case, {r('confidence')} AS confidence FROM x_kwcase")(
    lambda w: usecase.keyword_use_case(tool_names(w), keywords(w))
)
query("u1_keyword_scores", f"SELECT session_id, use_case, {r('points')} AS points FROM x_kwscore")(
    lambda w: usecase.keyword_scores(tool_names(w), keywords(w))
)
O.CTES["x_affix_all"] = O.CTES["x_affix"].replace("x_unmatched u JOIN x_parts p USING (session_id, tool)", "x_parts p").replace("u.session_id", "p.session_id")
query("u2_affix_points", f"SELECT session_id, use_case, {r('points')} AS points FROM x_affix_all")(lambda w: usecase.affix_points(tool_names(w)))
RULES = values(K.BEHAVIOUR_RULES, "use_case, signal, op, cut, points")
O.CTES["x_siglong"] = " UNION ALL ".join(f"SELECT session_id, n, '{s}' AS signal, CAST({s} AS DOUBLE) AS value FROM x_signals" for s in usecase.SIGNALS)
O.CTES["x_rulescore"] = f"SELECT session_id, use_case, sum(CASE WHEN (op='>' AND value>cut) OR (op='<' AND value<cut) THEN points ELSE 0 END)*1.0 AS points FROM x_siglong JOIN {RULES} USING (signal) WHERE n>=5 GROUP BY ALL"
QUIET = {
    "FINANCIAL": "error_rate<0.02 AND escalation_rate<0.10 AND avg_tool_count BETWEEN 3 AND 8",
    "CONTENT_GENERATION": "avg_output_length>400 AND avg_tool_count<4 AND error_rate<0.05",
    "DATA_ANALYSIS": "avg_tool_count>5 AND escalation_rate<0.05 AND avg_output_length>300",
    "DEVOPS_SRE": "avg_tool_count>5 AND avg_latency_p95>4000 AND escalation_rate<0.05",
    "HEALTHCARE": "error_rate<0.01 AND avg_tool_count BETWEEN 2 AND 6 AND avg_time_to_first_tool>800",
}
O.CTES["x_behscore"] = (
    "SELECT session_id, use_case, sum(points) AS points FROM (SELECT * FROM x_rulescore UNION ALL SELECT session_id, 'GENERAL', 1.0 FROM x_signals WHERE n>=5 "
    + " ".join(
        f"UNION ALL SELECT session_id, '{u}', 3.0 FROM x_signals WHERE {t} AND session_id IN (SELECT session_id FROM x_rulescore GROUP BY 1 HAVING max(points)<2)" for u, t in QUIET.items()
    )
    + ") GROUP BY ALL"
)
O.CTES["x_behcase"] = f"SELECT s.session_id, coalesce(use_case,'GENERAL') AS use_case, coalesce(confidence, 0.0) AS confidence FROM x_signals s LEFT JOIN ({winner_sql('x_behscore', usecase.RULE_ORDER, 2.0)}) USING (session_id)"
query("u3_behaviour_scores", f"SELECT session_id, use_case, {r('points')} AS points FROM x_behscore")(lambda w: usecase.behaviour_scores(signals(w)))
query("u3_behaviour_use_case", f"SELECT session_id, use_case, {r('confidence')} AS confidence FROM x_behcase")(
    lambda w: usecase.behaviour_use_case(signals(w))
)


def brand_agents(w):
    """Keyword guesses for the agents: brand k speaks for agent k mod 4; the smallest brand wins."""
    guess = usecase.keyword_use_case(tool_names(w), keywords(w))
    number = F.regexp_extract("session_id", "(\\d+)", 1).cast("int")
    return (
        guess.groupBy(F.concat(F.lit("agent-"), number % 4).alias("agent"))
        .agg(F.min(F.struct(number.alias("k"), F.col("use_case"), F.col("confidence"))).alias("g"))
        .select(F.col("agent").alias("session_id"), "g.use_case", "g.confidence")
    )


PAIRED = "[" + ", ".join(f"'{a}|{b}', '{b}|{a}'" for a, b in K.COMPATIBLE_USE_CASES) + "]"
O.CTES["x_brand"] = """SELECT 'agent-'||(k%4) AS session_id, arg_min(use_case, k) AS use_case, arg_min(confidence, k) AS confidence FROM (
    SELECT *, CAST(regexp_extract(session_id, '(\\d+)', 1) AS INT) AS k FROM x_kwcase) GROUP BY 1"""
O.CTES["x_blend0"] = f"""SELECT *, kw_case='GENERAL' AND beh_case='GENERAL' AND kw=0 AND beh=0 AS nothing,
    NOT (kw_case='GENERAL' OR beh_case='GENERAL' OR kw_case=beh_case OR list_contains({PAIRED}, kw_case||'|'||beh_case)) AS conflict FROM (
    SELECT session_id, kw_case, beh_case, beh, CASE WHEN kw_case<>'GENERAL' AND kw_case=beh_case AND kw0>0 AND beh>=0.3 THEN greatest(kw0, 0.5) ELSE kw0 END AS kw FROM (
      SELECT session_id, coalesce(k.use_case,'GENERAL') AS kw_case, coalesce(b.use_case,'GENERAL') AS beh_case, coalesce(k.confidence, 0.0) AS kw0, coalesce(b.confidence, 0.0) AS beh
      FROM x_brand k FULL JOIN x_behcase b USING (session_id)))"""
O.CTES["x_blend1"] = """SELECT *, CASE WHEN nothing THEN 'general_fallback' WHEN conflict THEN 'conflict_resolved' WHEN kw>beh*1.5 THEN 'keyword_dominant' WHEN beh>kw*1.5 THEN 'behavioral_dominant'
      WHEN kw>0.1 OR beh>0.1 THEN 'blended' ELSE 'general_fallback' END AS method,
    CASE WHEN nothing THEN 0.0 WHEN conflict THEN CASE WHEN kw>=beh THEN kw ELSE 0.0 END WHEN kw+beh>0 THEN kw/(kw+beh) ELSE 0.0 END AS kw_share,
    CASE WHEN nothing THEN 0.0 WHEN conflict THEN CASE WHEN kw>=beh THEN 0.0 ELSE beh END WHEN kw+beh>0 THEN beh/(kw+beh) ELSE 0.0 END AS beh_share FROM x_blend0"""
O.CTES["x_blend"] = """SELECT session_id, CASE method WHEN 'general_fallback' THEN 'GENERAL' WHEN 'keyword_dominant' THEN kw_case WHEN 'behavioral_dominant' THEN beh_case ELSE CASE WHEN kw>=beh THEN kw_case ELSE beh_case END END AS use_case,
    method, kw_case, beh_case, kw_share, beh_share, 1.0-kw_share-beh_share AS general_share FROM x_blend1"""
query(
    "u4_blend_use_case",
    f"SELECT session_id, use_case, method, kw_case, beh_case, {r('kw_share')} AS kw_share, {r('beh_share')} AS beh_share, {r('general_share')} AS general_share FROM x_blend",
)(lambda w: usecase.blend_use_case(brand_agents(w), usecase.behaviour_use_case(signals(w))))
CASES = "[" + ", ".join(f"'{u}'" for u in K.PRESETS) + "]"
query(
    "u5_blended_weights",
    f"""SELECT session_id, dim, {r('raw/sum(raw) OVER (PARTITION BY session_id)')} AS weight FROM (SELECT session_id, dim, sum(share*preset) AS raw FROM (
    SELECT session_id, CASE WHEN list_contains({CASES}, c) THEN c ELSE 'GENERAL' END AS use_case, share FROM (SELECT session_id, kw_case AS c, kw_share AS share FROM x_blend
      UNION ALL SELECT session_id, beh_case, beh_share FROM x_blend UNION ALL SELECT session_id, 'GENERAL', general_share FROM x_blend)) JOIN x_presets USING (use_case) GROUP BY ALL)""",
)(lambda w: usecase.blended_weights(usecase.blend_use_case(brand_agents(w), usecase.behaviour_use_case(signals(w)))))

# ---- the calibrated comparison: use cases, weights, tiers and cuts in one job --------------------
O.CTES["x_cal_presets"] = f"""SELECT session_id, dim, raw/sum(raw) OVER (PARTITION BY session_id) AS preset FROM (SELECT session_id, dim, sum(share*preset) AS raw FROM (
    SELECT session_id, CASE WHEN list_contains({CASES}, c) THEN c ELSE 'GENERAL' END AS use_case, share FROM (SELECT session_id, kw_case AS c, kw_share AS share FROM x_blend
      UNION ALL SELECT session_id, beh_case, beh_share FROM x_blend UNION ALL SELECT session_id, 'GENERAL', general_share FROM x_blend)) JOIN x_presets USING (use_case) GROUP BY ALL)"""
O.CTES["x_cal_relw"] = f"""SELECT {G}, dim, preset*reliability/sum(preset*reliability) OVER (PARTITION BY {G}) AS weight FROM x_stats JOIN x_cal_presets USING (session_id, dim)"""
for step in ("factors", "corrw", "redist"):
    body = O.CTES[f"x_{step}"]
    for part in ("relw", "factors", "corrw"):
        body = body.replace(f"x_{part}", f"x_cal_{part}")
    O.CTES[f"x_cal_{step}"] = body
O.CTES["x_cal_cuts"] = f"""SELECT session_id, environment, deployment_version AS baseline_version, {', '.join(f"sum(threshold*weight) FILTER (level='{level}') AS {level.lower()}" for level in K.COMPOSITE_CUTS)}
    FROM x_thr JOIN x_cal_redist USING ({G}, dim) GROUP BY ALL"""
O.CTES["x_cal_totals"] = f"""SELECT {P}, sum(weight*term) AS total, max(score) FILTER (dim='decision_drift') AS decision FROM x_dims
    JOIN (SELECT session_id, environment, deployment_version AS baseline_version, dim, weight FROM x_cal_redist) USING (session_id, environment, baseline_version, dim) GROUP BY {P}"""
O.CTES["x_cal_drift"] = f"""SELECT *, CASE WHEN tier<>'TIER3' THEN 'none' WHEN drift_score>=0.5*factor THEN 'critical' WHEN drift_score>=0.35*factor THEN 'significant'
      WHEN drift_score>=0.2*factor THEN 'moderate' WHEN drift_score>=0.1*factor THEN 'low' ELSE 'none' END AS severity
    FROM (SELECT {P}, b_n, c_n, tier, needed, CASE WHEN smaller_n>=50 THEN 1.0 ELSE 1.0+(ln(50)-ln(smaller_n))/ln(50) END AS factor,
        CASE WHEN tier<>'TIER3' THEN 0.0 ELSE decision END AS decision_drift,
        CASE WHEN tier<>'TIER3' THEN 0.0 WHEN decision>0.3 THEN greatest({clamp('total')}, 0.15) ELSE {clamp('total')} END AS drift_score
      FROM x_wide JOIN x_tiers USING ({P}) JOIN x_cal_totals USING ({P}))"""
O.CTES["x_cal_judged"] = f"""SELECT *, CASE WHEN tier<>'TIER3' THEN NULL WHEN drift_score>cut_block OR decision_drift>0.40 THEN 'BLOCK'
      WHEN drift_score>cut_review OR decision_drift>0.25 THEN 'REVIEW' WHEN drift_score>cut_monitor THEN 'MONITOR' ELSE 'SHIP' END AS verdict,
      CASE severity WHEN 'critical' THEN 'BLOCK' WHEN 'significant' THEN 'REVIEW' WHEN 'moderate' THEN 'MONITOR' ELSE 'SHIP' END AS severity_verdict
    FROM (SELECT d.*, CASE WHEN b_n<30 THEN 'preset' ELSE 'statistical' END AS method,
        {', '.join(f"coalesce(CASE WHEN b_n<30 THEN {cut}::DOUBLE ELSE {level.lower()}*{VOLUME.replace('*0.75::DOUBLE', '')} END, {cut}::DOUBLE) AS cut_{level.lower()}" for level, cut in K.COMPOSITE_CUTS.items())}
      FROM x_cal_drift d LEFT JOIN x_cal_cuts USING (session_id, environment, baseline_version))"""


@memo("calibrated_weights")
def calibrated_weights(w):
    presets = usecase.blended_weights(usecase.blend_use_case(brand_agents(w), usecase.behaviour_use_case(signals(w)))).withColumnRenamed("weight", "preset")
    return calibrated.baseline_weights(rho(w), stats(w), w.keep(presets, "inferred_presets"), gone(w))


@memo("judged")
def judged(w):
    return calibrated.judged(w.wide, stats(w), calibrated_weights(w), quantiles(w)).drop("failed_checks")


query(
    "d7_calibrated",
    f"SELECT {P}, b_n AS baseline_n, c_n AS current_n, tier, {r('decision_drift')} AS decision_drift, {r('drift_score')} AS drift_score, severity FROM x_cal_drift",
)(lambda w: judged(w).select(*K.PAIR, "baseline_n", "current_n", "tier", "decision_drift", "drift_score", "severity"))
query(
    "v1_calibrated",
    f"""SELECT {P}, tier, method, {', '.join(f"{r('cut_' + c)} AS {c}" for c in ("monitor", "review", "block"))}, verdict, severity_verdict,
    CASE WHEN verdict IN ('REVIEW','BLOCK') THEN 1 ELSE 0 END AS exit_code FROM x_cal_judged""",
)(lambda w: judged(w).select(*K.PAIR, "tier", "method", "monitor", "review", "block", "verdict", "severity_verdict", "exit_code"))

# ---- decisions ---------------------------------------------------------------------------------
query(
    "v1_verdict",
    f"SELECT {P}, {r('drift_score')} AS drift_score, tier, severity, verdict, severity_verdict, CASE WHEN verdict IN ('REVIEW','BLOCK') THEN 1 ELSE 0 END AS exit_code FROM x_decided",
)(lambda w: decide.verdict(scored(w)).select(*K.PAIR, "drift_score", "tier", "severity", "verdict", "severity_verdict", "exit_code"))
query("v2_severity_verdict", f"SELECT {P}, severity_verdict FROM x_decided")(
    lambda w: scored(w).select(*K.PAIR, C.severity_verdict(F.col("severity")).alias("severity_verdict"))
)
query("v8_gate", f"SELECT {P}, {r('drift_score')} AS drift_score FROM x_drift WHERE drift_score>0.2")(lambda w: decide.gate(scored(w), 0.2))
query(
    "v9_escalation_delta",
    f"SELECT {P}, {r('coalesce(d, 0.0)')} AS escalation_delta FROM x_pairs LEFT JOIN (SELECT {P}, q-p AS d FROM x_shares WHERE kind='outcome' AND key='escalated') USING ({P})",
)(lambda w: decide.escalation_delta(w.dist, w.pairs))
COST = "(avg(prompt_tokens)/1000000*2.5+avg(completion_tokens)/1000000*10)*10000"
O.CTES["x_costs"] = f"SELECT {P}, {COST} FILTER (side='b') AS b, 0 AS c FROM x_runs JOIN x_sides USING ({G}) GROUP BY {P}".replace(
    f"{COST} FILTER (side='b') AS b, 0 AS c",
    ", ".join(
        f"(avg(prompt_tokens) FILTER (side='{s}')/1000000*2.5+avg(completion_tokens) FILTER (side='{s}')/1000000*10)*10000 AS {s}, avg(prompt_tokens) FILTER (side='{s}') AS {s}p, avg(completion_tokens) FILTER (side='{s}') AS {s}c"
        for s in "bc"
    ),
)
query("v13_cost_delta", f"SELECT {P}, {r('b')} AS baseline_cost, {r('c')} AS current_cost, {r('c-b')} AS delta, {r('(c-b)/b*100')} AS delta_pct FROM x_costs")(
    lambda w: decide.cost_delta(fingerprint.cost_per_10k(w.runs), w.pairs)
)
CARDS = values([(k, p, c) for k, (p, c) in K.RATE_CARDS.items()], "rate_card, rp, rc")
MONTH = lambda s: f"({s}p/1000000*rp+{s}c/1000000*rc)*100000"
query(
    "a15_cost_projection",
    f"""SELECT {P}, rate_card, {r('mb')} AS baseline_monthly, {r('mc')} AS current_monthly, {r('mc-mb')} AS delta_monthly, {r('(mc-mb)*12')} AS delta_yearly, {r('(mc-mb)/mb*100')} AS delta_pct
    FROM (SELECT {P}, rate_card, {MONTH('b')} AS mb, {MONTH('c')} AS mc FROM x_costs, {CARDS})""",
)(lambda w: decide.cost_projection(w.runs, w.pairs))
query(
    "j13_benchmark_comparison",
    f"""SELECT {G}, benchmark, metric, {r('value')} AS value, {r('expected')} AS expected, {r('d')} AS diff_pct, CASE WHEN abs(d)<10 THEN 'GOOD' WHEN d<50 THEN 'WATCH' ELSE 'BAD' END AS status FROM (
    SELECT *, (value-expected)/expected*100 AS d FROM ({' UNION ALL '.join(f"SELECT {G}, '{m}' AS metric, '{m.replace('avg_', '')}' AS key, CAST({m} AS DOUBLE) AS value FROM x_metrics" for m in ['avg_latency', 'p95_latency', 'avg_prompt_tokens', 'avg_completion_tokens', 'avg_loop_count', 'avg_retry_count', 'error_rate', 'escalation_rate', 'avg_tool_count'])})
    JOIN {values(K.BENCHMARKS, 'benchmark, key, expected')} USING (key))""",
)(lambda w: decide.benchmark_comparison(metrics(w)))
PB = ", ".join("q." + c.strip() for c in P.split(","))
O.CTES["x_cdiff"] = f"""SELECT {P}, change_type, max(current_value) FILTER (side='b') AS previous, max(current_value) FILTER (side='c') AS current,
    max(current_value) FILTER (side='b') IS DISTINCT FROM max(current_value) FILTER (side='c') AS changed FROM x_sides JOIN x_changes USING (session_id, deployment_version) GROUP BY {P}, change_type"""
query("j5_change_diff", f"SELECT {P}, change_type, previous, current, changed FROM x_cdiff")(lambda w: decide.change_diff(changes(w), w.pairs))
BRIDGE = values([(c, d) for c, ds in K.CHANGE_DIMS.items() for d in ds], "change_type, dim")
O.CTES["x_affected"] = f"""SELECT {P}, c.change_type, d.dim FROM x_cdiff c JOIN x_dims d USING ({P}) WHERE changed AND d.score>0.15
    AND (c.change_type NOT IN ({', '.join(f"'{c}'" for c in K.CHANGE_DIMS)}) OR EXISTS (SELECT 1 FROM {BRIDGE} b WHERE b.change_type=c.change_type AND b.dim=d.dim))"""
query("j6_affected_dims", f"SELECT {P}, change_type, dim FROM x_affected")(lambda w: decide.affected_dims(decide.change_diff(changes(w), w.pairs), dims(w)))
ADVICE_SQL = values(list(K.ADVICE.items()), "advice_key, advice")
query(
    "v5_root_cause",
    f"""SELECT {P}, has_changes, winner, {NR('s')} AS winner_score, CASE WHEN s>=0.8 THEN 'HIGH' WHEN s>=0.5 THEN 'MEDIUM' WHEN s>=0.2 THEN 'LOW' WHEN s IS NOT NULL THEN 'UNLIKELY' END AS confidence, previous, current, affected, ruled_out,
    replace(replace(replace(coalesce(advice, (SELECT advice FROM {ADVICE_SQL} WHERE advice_key='other')), '{{type}}', coalesce(winner, 'None')), '{{previous}}', coalesce(previous, 'None')), '{{current}}', coalesce(current, 'None')) AS suggested_action
    FROM (SELECT {P}, o.ruled_out IS NOT NULL AS has_changes, w.change_type AS winner, CASE WHEN o.ruled_out IS NOT NULL THEN coalesce(w.s, 0.0) END AS s, previous, current, coalesce(affected, '') AS affected, coalesce(o.ruled_out, '') AS ruled_out,
      CASE WHEN o.ruled_out IS NULL THEN 'nothing recorded' WHEN w.change_type IS NULL THEN 'nothing changed' WHEN w.change_type='model_version' AND (previous IS NULL OR current IS NULL) THEN 'model_version, one side'
        WHEN w.change_type LIKE 'custom%' THEN 'custom' ELSE w.change_type END AS advice_key
    FROM (SELECT {P} FROM x_pairs) LEFT JOIN (
    SELECT {P}, coalesce(array_to_string(list(change_type ORDER BY change_type) FILTER (NOT changed), ','), '') AS ruled_out FROM x_cdiff GROUP BY {P}) o USING ({P}) LEFT JOIN (
    SELECT * FROM (SELECT {P}, change_type, previous, current, coalesce(affected, '') AS affected, coalesce(hits/drifted, 0.0) AS s, row_number() OVER (PARTITION BY {P} ORDER BY coalesce(hits/drifted, 0.0) DESC, change_type) AS rn
      FROM (SELECT * FROM x_cdiff WHERE changed) LEFT JOIN (SELECT {P}, change_type, count(*) AS hits, array_to_string(list(dim ORDER BY dim), ',') AS affected FROM x_affected GROUP BY {P}, change_type) USING ({P}, change_type)
      LEFT JOIN (SELECT {P}, count(*) AS drifted FROM x_dims WHERE score>0.15 GROUP BY {P}) USING ({P})) WHERE rn=1) w USING ({P})) LEFT JOIN {ADVICE_SQL} USING (advice_key)""",
)(lambda w: decide.root_cause(dims(w), changes(w), w.pairs))
query(
    "v6_rollback",
    f"SELECT {P}, baseline_version AS rollback_version, printf('%s was last stable (SHIP) with %d runs recorded', baseline_version, baseline_n) AS reason FROM x_decided WHERE verdict IN ('REVIEW','BLOCK') AND baseline_n>=30",
)(lambda w: decide.rollback(decided(w)))
RULE_ROWS = [(i, *[x.get(t) for t in ("rule_id", "observation", "likely_cause", "recommended_action")], *[x.get(c) for c in decide.RULE_COLUMNS]) for i, x in enumerate(K.HYPOTHESIS_RULES)]
RULE_SQL = values(RULE_ROWS, "rule_order, rule_id, observation, likely_cause, recommended_action, " + ", ".join(decide.RULE_COLUMNS))
LEFT = {
    "overall": "drift_score", "decision": "decision_drift", "latency": "latency", "error": "error_rate", "tool": "tool_jsd", "tool_decrease": "abs(fall_pct)",
    "tool_increase": "rise_pct", "escalation": "esc", "baseline_runs": "baseline_n", "current_runs": "current_n",
}
HOLDS = " AND ".join(f"({c} IS NULL OR coalesce({LEFT[k]}{op}{c}, false))" for c, (k, op) in decide.RULE_COLUMNS.items())
O.CTES["x_facts"] = f"""SELECT d.*, w.tool_jsd, coalesce(e.d, 0.0) AS esc, m.fallen_tool, m.fall_pct, m.risen_tool, m.rise_pct FROM x_drift d JOIN x_wide w USING ({P}) LEFT JOIN x_moves m USING ({P})
    LEFT JOIN (SELECT {P}, q-p AS d FROM x_shares WHERE kind='outcome' AND key='escalated') e USING ({P})"""
FILL = lambda t, tool, pct: f"replace(replace({t}, '{{{{tool_name}}}}', {tool}), '{{{{delta_pct}}}}', printf('%.0f', abs({pct})))"
DOWN = f"CASE WHEN abs(fall_pct)>=99 THEN 'Tool '''||fallen_tool||''' dropped from baseline — no longer being called' ELSE {FILL('observation', 'fallen_tool', 'fall_pct')} END"
UP = FILL("observation", "risen_tool", "rise_pct")
EITHER = f"""CASE WHEN risen_tool IS NOT NULL AND rise_pct>=99 THEN 'Tool '''||risen_tool||''' is new in current version — not present in baseline' WHEN fallen_tool IS NOT NULL THEN {DOWN}
    WHEN risen_tool IS NOT NULL THEN {UP} ELSE observation END"""
FALLING, RISING = "rule_id LIKE '%decrease%'", "(rule_id LIKE '%increase%' OR rule_id LIKE '%escalation%')"
HYPOTHESES = f"""SELECT {P}, rule_order, rule_id,
    CASE WHEN {FALLING} THEN coalesce({DOWN}, observation) WHEN {RISING} THEN coalesce({UP}, observation) ELSE {EITHER} END AS observation, likely_cause,
    coalesce(replace(recommended_action, '{{{{tool_name}}}}', CASE WHEN {FALLING} THEN fallen_tool WHEN {RISING} THEN risen_tool ELSE coalesce(fallen_tool, risen_tool) END), recommended_action) AS recommended_action FROM x_facts, {RULE_SQL} WHERE {HOLDS}"""


def found_hypotheses(w):
    return decide.hypotheses(
        scored(w), w.wide, decide.escalation_delta(w.dist, w.pairs), compare.biggest_tool_moves(w.dist, w.pairs)
    )


query("v7_hypotheses", HYPOTHESES)(found_hypotheses)
query("j10_rules_with_drift", f"SELECT {P}, rule_id FROM ({HYPOTHESES})")(lambda w: found_hypotheses(w).select(*K.PAIR, "rule_id"))
query("v11_validate_limits", "SELECT p_brand||'_limit' AS budget_key, CAST(count(*) AS VARCHAR) AS limit_text, 'unknown key' AS problem FROM part GROUP BY p_brand UNION ALL SELECT 'max_error_rate', 'high', 'not a number' FROM (SELECT 1 FROM part HAVING count(*)>0)")(
    lambda w: budget.validate_limits(
        w.table("part").groupBy(F.concat("p_brand", F.lit("_limit")).alias("budget_key")).agg(F.count("*").cast("string").alias("limit_text"))
        .unionByName(w.table("part").agg(F.count("*").alias("k")).where("k > 0").select(F.lit("max_error_rate").alias("budget_key"), F.lit("high").alias("limit_text")))
        .unionByName(w.table("part").agg(F.count("*").cast("string").alias("limit_text")).select(F.lit("max_loop_depth").alias("budget_key"), "limit_text"))
    )
)
query("v12_keep_first", "SELECT session_id, deployment_version, semantic_cluster, arg_min(id, (started_at, id)) AS id FROM x_runs GROUP BY ALL")(
    lambda w: decide.keep_first(w.runs.select("session_id", "deployment_version", "semantic_cluster", "started_at", "id"), ["session_id", "deployment_version", "semantic_cluster"], "started_at").drop("started_at")
)
query("v12_keep_last", "SELECT session_id, deployment_version, arg_max(id, (started_at, id)) AS id FROM x_runs GROUP BY ALL")(
    lambda w: decide.keep_last(w.runs.select("session_id", "deployment_version", "started_at", "id"), ["session_id", "deployment_version"], "started_at").drop("started_at")
)
query("s11_drift_metrics", f"SELECT name, session_id, {P.replace('session_id, ', '')}, {r('value')} AS value FROM (" + " UNION ALL ".join(
    [f"SELECT {P}, 'drift.composite' AS name, drift_score AS value FROM x_decided"]
    + [f"SELECT {P}, 'drift.{n}', {d} FROM x_decided" for d, n in runs_io.METRIC_NAMES.items()]
    + [f"SELECT {P}, 'drift.verdict', CASE verdict WHEN 'SHIP' THEN 0 WHEN 'MONITOR' THEN 1 WHEN 'REVIEW' THEN 2 WHEN 'BLOCK' THEN 3 ELSE -1 END FROM x_decided",
       f"SELECT {P}, 'drift.confidence_tier', CAST(substr(tier, 5) AS DOUBLE) FROM x_decided"]) + ")")(
    lambda w: runs_io.drift_metrics(decided(w)).select(
        "name", F.col("attributes")["agent"].alias("session_id"), *[F.col("attributes")[c].alias(c) for c in ("environment", "baseline_version", "current_version")], "value"
    )
)


@memo("history")
def history(w):
    """One verdict per pair, recorded when the current version first ran."""
    firsts = w.runs.groupBy(*K.GROUP).agg(F.min("started_at").alias("recorded_at")).withColumnRenamed("deployment_version", "current_version")
    return runs_io.verdict_records(decided(w), AS_OF).drop("recorded_at").join(firsts, [*K.AGENT, "current_version"])


O.CTES["x_history"] = f"""SELECT d.*, f.recorded_at, md5(concat_ws('|', d.session_id, d.environment, d.baseline_version, d.current_version, '2024-02-01T00:00:00')) AS verdict_id FROM x_decided d
    JOIN (SELECT {G}, min(started_at) AS recorded_at FROM x_runs GROUP BY {G}) f ON f.session_id=d.session_id AND f.environment=d.environment AND f.deployment_version=d.current_version"""
query("s12_verdict_history", f"SELECT {P}, verdict_id, {r('drift_score')} AS drift_score, verdict, severity, tier, {ts('x_history.recorded_at')} AS recorded_at FROM x_history ORDER BY x_history.recorded_at DESC, verdict_id DESC LIMIT 50")(
    lambda w: runs_io.list_verdicts(history(w), 50)
)
LAST_GOOD = "SELECT environment, arg_max(coalesce(nullif(current_version, ''), baseline_version), (recorded_at, verdict_id)) AS last_good_version FROM {} WHERE verdict IS NULL OR verdict='SHIP' GROUP BY environment"
query("t9_last_good_version", LAST_GOOD.format("x_history"))(lambda w: decide.last_good_version(history(w)))
query("t9_last_good_of_newest", LAST_GOOD.format("(SELECT * FROM x_history ORDER BY recorded_at DESC, verdict_id DESC LIMIT 50)"))(
    lambda w: decide.last_good_version(history(w), window=50)
)
query(
    "t10_newest_records",
    "SELECT session_id, verdict_id, current_version FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY recorded_at DESC, verdict_id DESC) AS rn FROM x_history) WHERE rn<=3",
)(lambda w: decide.newest_records(history(w), ["session_id"], "recorded_at", "verdict_id", 3).select("session_id", "verdict_id", "current_version"))

# ---- anomaly -----------------------------------------------------------------------------------
VEC = [d for d in VECTOR]
query(
    "t5_top_anomaly_dims",
    f"""SELECT {P}, position, dim, {r('shift')} AS shift FROM (SELECT *, row_number() OVER (PARTITION BY {P} ORDER BY round(shift, 9) DESC, vpos) AS position FROM (
    SELECT {P}, dim, vpos, CASE WHEN sb<1e-9 THEN 0.0 ELSE abs(mc-mb)/sb END AS shift FROM (
      SELECT {P}, dim, vpos, max(m) FILTER (side='b') AS mb, max(m) FILTER (side='c') AS mc, max(s) FILTER (side='b') AS sb FROM (
        SELECT {G}, dim, vpos, avg(v) AS m, stddev_pop(v) AS s FROM ({' UNION ALL '.join(f"SELECT {G}, '{d}' AS dim, {i} AS vpos, CAST({e} AS DOUBLE) AS v FROM x_runs" for i, (d, e) in enumerate(VECTOR.items()))}) GROUP BY ALL)
      JOIN x_sides USING ({G}) GROUP BY {P}, dim, vpos))) WHERE position<=3""",
)(lambda w: anomaly.top_dims(w.runs, w.pairs))


@memo("anomaly")
def anomalies(w):
    return anomaly.isolation_forest(w.runs, w.pairs)


query("q16_isolation_forest")(lambda w: anomaly.isolation_forest(w.runs, w.pairs))
query("q17_anomaly_override")(
    lambda w: decide.anomaly_override(scored(w), anomalies(w)).select(*K.PAIR, "severity", "anomaly_level", "severity_after", "overridden")
)

# ---- resampling --------------------------------------------------------------------------------
POISSON_SQL = "+".join(f"(u>={cut})::INT" for cut in K.POISSON_CUTS)
SAMPLE = f"""SELECT *, row_number() OVER (PARTITION BY {G} ORDER BY md5('42:'||id), id)-1 AS idx FROM x_runs"""
O.CTES["x_sample"] = f"SELECT *, count(*) OVER (PARTITION BY {G}) AS sample_n FROM ({SAMPLE}) WHERE idx<200"
O.CTES["x_sided"] = f"SELECT {P}, side, s.* EXCLUDE ({G}) FROM x_sample s JOIN x_sides USING ({G})"
O.CTES["x_draws"] = f"""SELECT {P}, side, replicate, CAST(('0x'||substr(md5('42:'||session_id||':'||environment||':'||baseline_version||':'||current_version||':'||side||':'||replicate||':'||slot), 1, 8)) AS BIGINT)%sample_n AS idx
    FROM (SELECT {P}, side, sample_n, replicate, unnest(range(0, sample_n)) AS slot FROM (SELECT DISTINCT {P}, side, sample_n, unnest(range(0, 500)) AS replicate FROM x_sided))"""
O.CTES["x_drawn"] = f"SELECT d.replicate, s.* FROM x_draws d JOIN x_sided s USING ({P}, side, idx)"
PR = P + ", replicate"
RC = [c for c in resample.REPLICATE_COLUMNS]
O.CTES["x_drawn_all"] = f"""SELECT {PR}, side, t.* EXCLUDE ({G}, replicate) FROM (SELECT *, unnest(range(0, draws)) AS copy FROM (SELECT *, {POISSON_SQL} AS draws FROM (
    SELECT *, CAST(('0x'||substr(md5('42:'||{" ||':'|| ".join(K.GROUP)}||':'||id||':'||(replicate//4)), 1+8*(replicate%4), 8)) AS BIGINT) AS u FROM x_runs, (SELECT unnest(range(0, 500)) AS replicate)))) t JOIN x_sides USING ({G})"""


def replicate_tables(tag: str) -> None:
    """Replicates from the drawn rows of one kind: of samples (no tag) or of all runs, where a round without a run of a side does not count."""
    counted = " WHERE b_n IS NOT NULL AND c_n IS NOT NULL" if tag else ""
    O.CTES[f"x_repnum{tag}"] = f"""SELECT {PR}, side, count(*) AS n, avg(output_length) AS avg_output_length, avg(verbosity_ratio) AS avg_verbosity_ratio, avg(retry_count) AS avg_retry_count,
        avg(time_to_first_tool_ms) AS avg_time_to_first_tool_ms, avg(error_count) AS error_rate, {O.percentile('latency_ms', 95)} AS p95_latency_ms, {O.percentile('loop_count', 95)} AS p95_loop_count FROM x_drawn{tag} GROUP BY {PR}, side"""
    O.CTES[f"x_repkeys{tag}"] = f"""SELECT {PR}, kind, key, count(*) FILTER (side='b') AS b_n, count(*) FILTER (side='c') AS c_n FROM (
        SELECT {PR}, side, 'sequence' AS kind, CAST(to_json(tools) AS VARCHAR) AS key FROM x_drawn{tag} UNION ALL SELECT {PR}, side, 'outcome', semantic_cluster FROM x_drawn{tag}
        UNION ALL SELECT {PR}, side, 'bigram', tools[i]||' -> '||tools[i+1] FROM (SELECT {PR}, side, tools, unnest(range(1, len(tools))) AS i FROM x_drawn{tag})) GROUP BY ALL"""
    O.CTES[f"x_repjsd{tag}"] = f"""SELECT {PR}, kind, CASE WHEN max(p)=0 OR max(q)=0 THEN 1.0 ELSE {clamp('sum(t)/0.6931471805599453')} END AS jsd, CASE WHEN max(p)=0 OR max(q)=0 THEN 0.0 ELSE sqrt(greatest(0.0, sum(t))) END AS dist FROM (
        SELECT *, 0.5*((CASE WHEN p>0 THEN p*ln(p/((p+q)/2)) ELSE 0.0 END)+(CASE WHEN q>0 THEN q*ln(q/((p+q)/2)) ELSE 0.0 END)) AS t FROM (
          SELECT {PR}, kind, key, coalesce(b_n/nullif(sum(b_n) OVER (PARTITION BY {PR}, kind), 0), 0.0) AS p, coalesce(c_n/nullif(sum(c_n) OVER (PARTITION BY {PR}, kind), 0), 0.0) AS q FROM x_repkeys{tag})) GROUP BY {PR}, kind"""
    O.CTES[f"x_repwide{tag}"] = f"""SELECT *, CAST(NULL AS DOUBLE) AS emd FROM (SELECT {PR}, {', '.join(f"max({c}) FILTER (side='{s}') AS {s}_{c}" for s in 'bc' for c in RC)} FROM x_repnum{tag} GROUP BY {PR})
        JOIN (SELECT {PR}, coalesce(max(jsd) FILTER (kind='sequence'), 0.0) AS decision_jsd, coalesce(max(jsd) FILTER (kind='outcome'), 0.0) AS outcome_jsd, coalesce(max(dist) FILTER (kind='bigram'), 0.0) AS transition_distance FROM x_repjsd{tag} GROUP BY {PR}) USING ({PR})"""
    O.CTES[f"x_rep{tag}"] = f"SELECT {PR}, {', '.join(f'CAST({s} AS DOUBLE) AS {d}' for d, (s, _) in SCORES.items())}, {FIXED} AS composite FROM x_repwide{tag}{counted}"
    O.CTES[f"x_replong{tag}"] = " UNION ALL ".join(f"SELECT {P}, '{d}' AS dim, {d} AS value FROM x_rep{tag}" for d in K.DIMS)


replicate_tables("")
replicate_tables("_all")


@memo("replicates")
def replicates(w):
    return resample.bootstrap(w.runs, w.pairs)


@memo("replicates_of_all")
def replicates_of_all(w):
    return resample.bootstrap(w.runs, w.pairs, cap=None)


query("q6_capped_sample", f"SELECT {G}, id, idx, sample_n FROM x_sample")(
    lambda w: resample.capped_sample(w.runs).select(*K.GROUP, "id", "idx", "sample_n")
)


def interval_queries(tag: str, rounds) -> None:
    """What is read from replicates of samples of at most 200 runs a group (no tag) or of all runs."""
    query(f"q5_bootstrap_ci{tag}", f"""SELECT {P}, {r('drift_score')} AS drift_score, {r('least(lo, drift_score)')} AS ci_lower, {r('greatest(hi, drift_score)')} AS ci_upper, n<30 AS small_sample FROM x_drift
        JOIN (SELECT {P}, quantile_cont(composite, 0.025) AS lo, quantile_cont(composite, 0.975) AS hi FROM x_rep{tag} GROUP BY {P}) USING ({P})""")(
        lambda w: resample.drift_ci(rounds(w), scored(w))
    )
    query(f"q7_dimension_ci{tag}", f"""SELECT {P}, dim, {r('score')} AS observed, {r('lo')} AS ci_lower, {r('hi')} AS ci_upper, lo>0 AS significant FROM x_dims
        JOIN (SELECT {P}, dim, quantile_cont(value, 0.025) AS lo, quantile_cont(value, 0.975) AS hi FROM x_replong{tag} GROUP BY ALL) USING ({P}, dim)""")(
        lambda w: resample.dimension_ci(rounds(w), dims(w))
    )
    O.CTES[f"x_sigma{tag}"] = f"SELECT {P}, dim, stddev_samp(value) AS sigma FROM x_replong{tag} GROUP BY ALL"
    query(f"q8_mde{tag}", f"SELECT {P}, dim, {r(f'{Z}*sigma*sqrt(1/b_n+1/c_n)')} AS mde FROM x_sigma{tag} JOIN x_wide USING ({P})")(
        lambda w: resample.mde(rounds(w), sizes(w))
    )
    query(f"q9_runs_forecast{tag}", f"SELECT {P}, dim, CAST(greatest(0, ceil(2*pow({Z}*sigma/0.1::DOUBLE, 2))-(b_n+c_n)) AS BIGINT) AS more_runs FROM x_sigma{tag} JOIN x_wide USING ({P})")(
        lambda w: resample.runs_forecast(rounds(w), sizes(w))
    )


interval_queries("", replicates)
interval_queries("_all", replicates_of_all)
O.CTES["x_rounds"] = f"""SELECT {G}, replicate, sum(draws*latency_ms)/nullif(sum(draws), 0) AS mean FROM (SELECT *, {POISSON_SQL} AS draws FROM (
    SELECT {G}, latency_ms, replicate, CAST(('0x'||substr(md5('42:'||{" ||':'|| ".join(K.GROUP)}||':'||id||':'||replicate), 1, 8)) AS BIGINT) AS u FROM x_runs, (SELECT unnest(range(0, 1000)) AS replicate) WHERE latency_ms IS NOT NULL)) GROUP BY {G}, replicate"""
query(
    "q4_bootstrap_mean_diff",
    f"""SELECT {P}, {r('mean_diff')} AS mean_diff, {r('ci_lower')} AS ci_lower, {r('ci_upper')} AS ci_upper FROM (
    SELECT {P}, list_sort(list(diff))[CAST(floor(count(*)*0.025::DOUBLE) AS INT)+1] AS ci_lower, list_sort(list(diff))[CAST(least(floor(count(*)*0.975::DOUBLE), count(*)-1) AS INT)+1] AS ci_upper FROM (
      SELECT {P}, replicate, max(mean) FILTER (side='c')-max(mean) FILTER (side='b') AS diff FROM x_rounds JOIN x_sides USING ({G}) GROUP BY {P}, replicate) WHERE diff IS NOT NULL GROUP BY {P})
    JOIN (SELECT {P}, avg(latency_ms) FILTER (side='c')-avg(latency_ms) FILTER (side='b') AS mean_diff FROM x_runs JOIN x_sides USING ({G}) GROUP BY {P}) USING ({P})""",
)(lambda w: resample.bootstrap_mean_diff(w.runs, w.pairs))
query("v4_verdict_payload")(
    lambda w: decide.verdict_payload(
        decided(w),
        resample.drift_ci(replicates(w), scored(w)),
        significance.top_contributors(attributed(w)),
        compare.evidence(w.wide, compare.largest_share_shift(w.dist, w.pairs), compare.largest_share_shift(w.dist, w.pairs, "outcome")),
        decide.rollback(decided(w)),
        resample.mde(replicates(w), sizes(w)),
        resample.runs_forecast(replicates(w), sizes(w)),
    )
)
