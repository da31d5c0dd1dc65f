"""From drift to a decision: verdicts, causes, hypotheses, rollback and the gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.functions import constants as K
from tidemark.operators import pairs as P
from tidemark.operators import ranks


def verdict(
    scored: DataFrame,
    thresholds: DataFrame | None = None,
    downgraded: DataFrame | None = None,
    checks: dict[str, Column] | None = None,
) -> DataFrame:
    """Both verdicts of every pair: by thresholds (none for TIER1/2) and by severity.

    ``thresholds``: pair, monitor, review, block. ``checks``: named user predicates; a failing one
    raises SHIP or MONITOR to REVIEW and is named in ``failed_checks``.
    """
    if downgraded is not None:
        scored = scored.drop("tier").join(downgraded.select(*K.PAIR, "tier"), K.PAIR)
    if thresholds is None:
        cuts = None
    else:
        scored = scored.join(thresholds, K.PAIR, "left")
        cuts = {k: F.coalesce(F.col(k.lower()), F.lit(v)) for k, v in K.COMPOSITE_CUTS.items()}
    outcome = C.threshold_verdict(F.col("drift_score"), F.col("decision_drift"), cuts)
    failed = F.filter(
        F.array(*[F.when(~test, F.lit(name)) for name, test in (checks or {}).items()]).cast("array<string>"),
        lambda x: x.isNotNull(),
    )
    raised = F.when((F.size("failed_checks") > 0) & outcome.isin("SHIP", "MONITOR"), "REVIEW").otherwise(outcome)
    return (
        scored.withColumn("failed_checks", failed)
        .withColumn("verdict", F.when(F.col("tier") == "TIER3", raised))
        .withColumn("severity_verdict", C.severity_verdict(F.col("severity")))
        .withColumn("exit_code", F.when(F.col("verdict").isin("REVIEW", "BLOCK"), 1).otherwise(0))
    )


def gate(scored: DataFrame, cut: float | None = None) -> DataFrame:
    """Pairs that stop a deployment: score above the cut, or any drift at all without one."""
    limit = 0.0 if cut is None else cut
    return scored.where(F.col("drift_score") > limit).select(*K.PAIR, "drift_score")


def anomaly_override(scored: DataFrame, anomaly: DataFrame) -> DataFrame:
    """A CRITICAL anomaly raises none/low to moderate and moderate to significant."""
    joined = scored.join(anomaly.select(*K.PAIR, F.col("level").alias("anomaly_level")), K.PAIR, "left")
    critical = F.coalesce(F.col("anomaly_level") == "CRITICAL", F.lit(False))
    raised = (
        F.when(critical & F.col("severity").isin("none", "low"), "moderate")
        .when(critical & (F.col("severity") == "moderate"), "significant")
        .otherwise(F.col("severity"))
    )
    return joined.withColumn("severity_after", raised).withColumn("overridden", F.col("severity") != F.col("severity_after"))


def main_cause(top: DataFrame, dims: DataFrame) -> DataFrame:
    """The leading dimension as text with its score and share of the drift. ``top``: from T4."""
    first = top.where(F.col("position") == 1)
    return first.join(dims, [*K.PAIR, "dim"]).select(
        *K.PAIR,
        F.format_string(
            "%s: %.3f (%.1f%% of drift)", F.col("dim"), C.fixed(F.col("score"), 3), C.fixed(F.col("percent"), 1)
        ).alias("cause"),
    )


def escalation_delta(dist: DataFrame, pairs: DataFrame) -> DataFrame:
    """Change in the share of escalated outcomes, 0 when a side has none."""
    share = dist.where((F.col("kind") == "outcome") & (F.col("key") == "escalated"))
    sided = P.attach(share.select(*K.GROUP, "share"), pairs)
    on = lambda s: F.coalesce(F.max(F.when(F.col("side") == s, F.col("share"))), F.lit(0.0))
    found = sided.groupBy(*K.PAIR).agg((on("c") - on("b")).alias("escalation_delta"))
    return pairs.join(found, K.PAIR, "left").withColumn("escalation_delta", F.coalesce("escalation_delta", F.lit(0.0)))


def cost_delta(costs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Change in the price of ten thousand runs. ``costs``: from ``fingerprint.cost_per_10k``."""
    wide = P.both_sides(costs, pairs, ["cost_10k"])
    b, c = F.col("b_cost_10k"), F.col("c_cost_10k")
    return wide.select(
        *K.PAIR,
        b.alias("baseline_cost"),
        c.alias("current_cost"),
        (c - b).alias("delta"),
        F.when(b > 0, (c - b) / b * 100).otherwise(0.0).alias("delta_pct"),
    )


def cost_projection(runs: DataFrame, pairs: DataFrame, volume: int = 100_000) -> DataFrame:
    """Monthly and yearly cost of both sides at a monthly volume, per rate card."""
    means = runs.groupBy(*K.GROUP).agg(
        F.avg(F.coalesce(F.col("prompt_tokens"), F.lit(0))).alias("prompt"),
        F.avg(F.coalesce(F.col("completion_tokens"), F.lit(0))).alias("completion"),
    )
    wide = P.both_sides(means, pairs, ["prompt", "completion"])
    cards = F.array(
        *[F.struct(F.lit(k).alias("rate_card"), F.lit(p).alias("rp"), F.lit(c).alias("rc")) for k, (p, c) in K.RATE_CARDS.items()]
    )
    monthly = lambda s: (F.col(f"{s}_prompt") / 1e6 * F.col("rp") + F.col(f"{s}_completion") / 1e6 * F.col("rc")) * volume
    flat = wide.select("*", F.explode(cards).alias("card")).select("*", "card.rate_card", "card.rp", "card.rc")
    b, c = F.col("baseline_monthly"), F.col("current_monthly")
    return (
        flat.withColumn("baseline_monthly", monthly("b"))
        .withColumn("current_monthly", monthly("c"))
        .select(
            *K.PAIR,
            "rate_card",
            b,
            c,
            (c - b).alias("delta_monthly"),
            ((c - b) * 12).alias("delta_yearly"),
            F.when(b > 0, (c - b) / b * 100).otherwise(0.0).alias("delta_pct"),
        )
    )


def verdict_payload(
    decided: DataFrame,
    ci: DataFrame,
    top: DataFrame,
    evidence: DataFrame,
    rollback_to: DataFrame | None = None,
    mdes: DataFrame | None = None,
    forecast: DataFrame | None = None,
) -> DataFrame:
    """One JSON document per pair for a pipeline to read."""
    leaders = (
        top.join(evidence, [*K.PAIR, "dim"], "left")
        .groupBy(*K.PAIR)
        .agg(F.array_sort(F.collect_list(F.struct("position", "dim", "attribution", "percent", "evidence"))).alias("top"))
    )
    joined = decided.join(ci.select(*K.PAIR, "ci_lower", "ci_upper"), K.PAIR, "left").join(leaders, K.PAIR, "left")
    as_map = lambda df, v: df.groupBy(*K.PAIR).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("dim", v)))).alias(v)
    )
    extras = []
    if rollback_to is not None:
        joined = joined.join(rollback_to.select(*K.PAIR, "rollback_version"), K.PAIR, "left")
        extras.append(F.col("rollback_version").alias("rollback_target"))
    if mdes is not None:
        joined = joined.join(as_map(mdes, "mde"), K.PAIR, "left")
        extras.append(F.col("mde").alias("mdes"))
    if forecast is not None:
        joined = joined.join(as_map(forecast, "more_runs"), K.PAIR, "left")
        extras.append(F.when(F.col("tier").isin("TIER1", "TIER2"), F.col("more_runs")).alias("power_forecast"))
    body = F.struct(
        F.lit("1.0").alias("version"),
        F.when(F.col("tier") == "TIER3", F.col("severity_verdict")).alias("verdict"),
        F.round("drift_score", 4).alias("composite_score"),
        F.col("tier").alias("confidence_tier"),
        F.struct("ci_lower", "ci_upper").alias("confidence"),
        F.col("top").alias("top_contributors"),
        F.struct(F.col("baseline_n").alias("baseline"), F.col("current_n").alias("current")).alias("sample_sizes"),
        *extras,
    )
    return joined.select(*K.PAIR, F.to_json(body).alias("payload"))


# ---- causes ------------------------------------------------------------------------------------
def change_diff(changes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Change types of both versions of a pair; ``changed`` where the values differ.

    ``changes``: session_id, deployment_version, change_type, current_value.
    """
    sides = F.array(
        F.struct(F.lit("b").alias("side"), F.col("baseline_version").alias("deployment_version")),
        F.struct(F.lit("c").alias("side"), F.col("current_version").alias("deployment_version")),
    )
    sided = pairs.select(*K.PAIR, F.explode(sides).alias("s")).select(*K.PAIR, "s.side", "s.deployment_version")
    on = lambda s: F.max(F.when(F.col("side") == s, F.col("current_value")))
    return (
        sided.join(changes, ["session_id", "deployment_version"])
        .groupBy(*K.PAIR, "change_type")
        .agg(on("b").alias("previous"), on("c").alias("current"))
        .withColumn("changed", ~F.col("previous").eqNullSafe(F.col("current")))
    )


def change_dims(spark: SparkSession) -> DataFrame:
    rows = [(c, d) for c, ds in K.CHANGE_DIMS.items() for d in ds]
    return spark.createDataFrame(rows, "change_type string, dim string")


def affected_dims(diff: DataFrame, dims: DataFrame, cut: float = 0.15) -> DataFrame:
    """Changed types with the drifted dimensions they can explain; unknown types may explain all."""
    drifted = dims.where(F.col("score") > cut).select(*K.PAIR, "dim")
    bridge = F.create_map(*[x for c, ds in K.CHANGE_DIMS.items() for x in (F.lit(c), F.array(*[F.lit(d) for d in ds]))])
    reach = bridge[F.col("change_type")]
    return (
        diff.where("changed")
        .join(drifted, K.PAIR)
        .where(reach.isNull() | F.array_contains(reach, F.col("dim")))
        .select(*K.PAIR, "change_type", "dim")
    )


def root_cause(dims: DataFrame, changes: DataFrame, pairs: DataFrame, cut: float = 0.15) -> DataFrame:
    """The change that explains most drifted dimensions per pair, with its confidence and what to do about it.

    Every pair gets a row: without recorded events ``has_changes`` is false and score and confidence are null;
    with events that do not differ the score is 0.
    """
    diff = change_diff(changes, pairs)
    drifted = dims.where(F.col("score") > cut).groupBy(*K.PAIR).agg(F.count("*").alias("drifted"))
    hits = affected_dims(diff, dims, cut).groupBy(*K.PAIR, "change_type").agg(
        F.count("*").alias("hits"), F.array_join(F.array_sort(F.collect_list("dim")), ",").alias("affected")
    )
    scored = (
        diff.where("changed")
        .join(hits, [*K.PAIR, "change_type"], "left")
        .join(drifted, K.PAIR, "left")
        .withColumn("cause_score", F.coalesce(F.col("hits") / F.col("drifted"), F.lit(0.0)))
    )
    best = F.min(
        F.struct(
            (-F.col("cause_score")).alias("minus"),
            F.col("change_type"),
            F.col("previous"),
            F.col("current"),
            F.coalesce("affected", F.lit("")).alias("affected"),
        )
    )
    ruled_out = diff.groupBy(*K.PAIR).agg(
        F.array_join(F.array_sort(F.collect_list(F.when(~F.col("changed"), F.col("change_type")))), ",").alias("ruled_out")
    )
    recorded, score = F.col("seen"), F.coalesce(-F.col("w.minus"), F.lit(0.0))
    confidence = F.when(score >= 0.8, "HIGH").when(score >= 0.5, "MEDIUM").when(score >= 0.2, "LOW").otherwise("UNLIKELY")
    found = ruled_out.join(scored.groupBy(*K.PAIR).agg(best.alias("w")), K.PAIR, "left").withColumn("seen", F.lit(True))
    whole = pairs.select(*K.PAIR).join(found, K.PAIR, "left").withColumn("seen", F.coalesce("seen", F.lit(False)))
    return whole.select(
        *K.PAIR,
        recorded.alias("has_changes"),
        F.col("w.change_type").alias("winner"),
        F.when(recorded, score).alias("winner_score"),
        F.when(recorded, confidence).alias("confidence"),
        F.col("w.previous").alias("previous"),
        F.col("w.current").alias("current"),
        F.coalesce("w.affected", F.lit("")).alias("affected"),
        F.coalesce("ruled_out", F.lit("")).alias("ruled_out"),
        advice(recorded, F.col("w.change_type"), F.col("w.previous"), F.col("w.current")).alias("suggested_action"),
    )


def advice(recorded: Column, change: Column, previous: Column, current: Column) -> Column:
    """The text for a change type out of the fixed table, its places filled in."""
    texts = F.create_map(*[F.lit(x) for item in K.ADVICE.items() for x in item])
    half = F.when(previous.isNull() | current.isNull(), ", one side").otherwise("")
    key = F.coalesce(
        F.when(~recorded, "nothing recorded"),
        F.when(change.isNull(), "nothing changed"),
        F.when(change == "model_version", F.concat(change, half)),
        F.when(F.startswith(change, F.lit("custom")), "custom"),
        change,
    )
    text = F.coalesce(F.try_element_at(texts, key), F.lit(K.ADVICE["other"]))
    for place, value in (("{type}", change), ("{previous}", previous), ("{current}", current)):
        text = F.replace(text, F.lit(place), F.coalesce(value, F.lit("None")))
    return text


def keep_first(events: DataFrame, keys: list[str], at: str) -> DataFrame:
    """First record per key (change events)."""
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(at, *[c for c in rest if c != at])).alias("r")).select(*keys, "r.*")


def keep_last(events: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Last record per key (deploy outcomes)."""
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(at, *[c for c in rest if c != at])).alias("r")).select(*keys, "r.*")


def rollback(decided: DataFrame) -> DataFrame:
    """The baseline as the version to return to, for REVIEW and BLOCK with 30 baseline runs or more."""
    ok = (
        F.col("verdict").isin("REVIEW", "BLOCK")
        & (F.col("baseline_n") >= 30)
        & (F.col("baseline_version") != F.col("current_version"))
    )
    reason = F.format_string(
        "%s was last stable (SHIP) with %d runs recorded", F.col("baseline_version"), F.col("baseline_n")
    )
    return decided.where(ok).select(*K.PAIR, F.col("baseline_version").alias("rollback_version"), reason.alias("reason"))


def last_good_version(history: DataFrame, window: int | None = None, by: tuple[str, ...] = ("environment",)) -> DataFrame:
    """Newest SHIP (or undecided) version of each environment; with ``window`` only among so many newest verdicts of all.

    A verdict without a current version names its baseline.
    """
    recent = history if window is None else history.orderBy(F.col("recorded_at").desc(), F.col("verdict_id").desc()).limit(window)
    good = recent.where(F.col("verdict").isNull() | (F.col("verdict") == "SHIP"))
    version = F.when(F.coalesce("current_version", F.lit("")) != "", F.col("current_version")).otherwise(F.col("baseline_version"))
    return good.groupBy(*by).agg(F.max_by(version, F.struct("recorded_at", "verdict_id")).alias("last_good_version"))


# ---- hypotheses --------------------------------------------------------------------------------
RULE_COLUMNS = {
    "overall_drift_min": ("overall", ">="), "overall_drift_max": ("overall", "<="),
    "decision_drift_min": ("decision", ">="), "decision_drift_max": ("decision", "<="),
    "latency_drift_min": ("latency", ">="), "error_drift_min": ("error", ">="), "tool_drift_max": ("tool", "<="),
    "tool_decrease_min_pct": ("tool_decrease", ">="), "tool_increase_min_pct": ("tool_increase", ">="),
    "escalation_rate_delta_min": ("escalation", ">="), "escalation_rate_delta_max": ("escalation", "<="),
    "baseline_runs_min": ("baseline_runs", ">="), "current_runs_min": ("current_runs", ">="),
}
"""Bounds of a rule: the quantity each limits and how."""


def _rule_rows(rules: list[dict]) -> Column:
    """Rules as an array of structs; a bound left out is null and does not bind."""
    texts = ["rule_id", "observation", "likely_cause", "recommended_action"]
    return F.array(
        *[
            F.struct(
                F.lit(i).alias("rule_order"),
                *[F.lit(rule[t]).alias(t) for t in texts],
                *[F.lit(rule.get(c)).cast("double").alias(c) for c in RULE_COLUMNS],
            )
            for i, rule in enumerate(rules)
        ]
    )


def hypotheses(
    scored: DataFrame, tool_drift: DataFrame, escalation: DataFrame, moves: DataFrame, rules: list[dict] | None = None
) -> DataFrame:
    """Rules whose bounds all hold, with the tool names filled in. Each pair explodes into the rules,
    which are configuration, so there is no join with them.

    ``scored``: from ``compare.drift``; ``tool_drift``: pair, tool_jsd; ``escalation``: pair,
    escalation_delta; ``moves``: from ``compare.biggest_tool_moves``.
    """
    facts = (
        scored.join(tool_drift.select(*K.PAIR, "tool_jsd"), K.PAIR, "left")
        .join(escalation.select(*K.PAIR, "escalation_delta"), K.PAIR, "left")
        .join(moves, K.PAIR, "left")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    left = {
        "overall": zero("drift_score"),
        "decision": zero("decision_drift"),
        "latency": zero("latency"),
        "error": zero("error_rate"),
        "tool": zero("tool_jsd"),
        "tool_decrease": F.abs("fall_pct"),
        "tool_increase": F.col("rise_pct"),
        "escalation": zero("escalation_delta"),
        "baseline_runs": F.col("baseline_n"),
        "current_runs": F.col("current_n"),
    }
    holds = F.lit(True)
    for column, (quantity, op) in RULE_COLUMNS.items():
        value = left[quantity]
        bound = F.col(column)
        test = value >= bound if op == ">=" else value <= bound
        holds = holds & (bound.isNull() | F.coalesce(test, F.lit(False)))
    flat = facts.select("*", F.explode(_rule_rows(rules or K.HYPOTHESIS_RULES)).alias("rule")).select("*", "rule.*")
    hit = flat.where(holds)
    falling = F.col("rule_id").contains("decrease") | F.col("rule_id").contains("drop")
    rising = (
        F.col("rule_id").contains("increase") | F.col("rule_id").contains("rise") | F.col("rule_id").contains("escalation")
    )
    number = lambda c: F.format_string("%.0f", F.bround(F.abs(c), 0))

    def filled(text: Column, tool: str, pct: str) -> Column:
        named = F.replace(text, F.lit("{{tool_name}}"), F.col(tool))
        return F.replace(named, F.lit("{{delta_pct}}"), number(F.col(pct)))

    gone = F.concat(F.lit("Tool '"), F.col("fallen_tool"), F.lit("' dropped from baseline — no longer being called"))
    fresh = F.concat(F.lit("Tool '"), F.col("risen_tool"), F.lit("' is new in current version — not present in baseline"))
    fell, rose = F.col("fallen_tool").isNotNull(), F.col("risen_tool").isNotNull()
    obs, act = F.col("observation"), F.col("recommended_action")
    fall_obs = F.when(F.abs("fall_pct") >= 99, gone).otherwise(filled(obs, "fallen_tool", "fall_pct"))
    rise_obs = filled(obs, "risen_tool", "rise_pct")
    either = F.when(rose & (F.col("rise_pct") >= 99), fresh).when(fell & (F.abs("fall_pct") >= 99), gone)
    either = either.otherwise(F.when(fell, filled(obs, "fallen_tool", "fall_pct")).when(rose, rise_obs).otherwise(obs))
    text = F.when(falling, F.when(fell, fall_obs).otherwise(obs)).when(rising, F.when(rose, rise_obs).otherwise(obs)).otherwise(either)
    tool = F.when(falling, F.col("fallen_tool")).when(rising, F.col("risen_tool")).otherwise(
        F.coalesce("fallen_tool", "risen_tool")
    )
    action = F.when(tool.isNull(), act).otherwise(F.replace(act, F.lit("{{tool_name}}"), tool))
    return hit.select(
        *K.PAIR, "rule_order", "rule_id", text.alias("observation"), "likely_cause", action.alias("recommended_action")
    )


def benchmark_comparison(metrics: DataFrame, by: tuple[str, ...] = tuple(K.GROUP)) -> DataFrame:
    """Group metrics against industry benchmarks: GOOD within 10 %, WATCH under +50 %, else BAD.

    Metric names lose their ``avg_`` prefix before the lookup, as the benchmark table has none for
    most of them.
    """
    spark = metrics.sparkSession
    table = spark.createDataFrame(K.BENCHMARKS, "benchmark string, key string, expected double")
    names = ["avg_latency", "p95_latency", "avg_prompt_tokens", "avg_completion_tokens", "avg_loop_count", "avg_retry_count", "error_rate", "escalation_rate", "avg_tool_count"]
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in names])
    flat = metrics.select(*by, F.explode(rows).alias("m")).select(*by, "m.metric", "m.value")
    keyed = flat.withColumn("key", F.regexp_replace("metric", "avg_", ""))
    diff = F.when(F.col("expected") > 0, (F.col("value") - F.col("expected")) / F.col("expected") * 100).otherwise(0.0)
    status = F.when(F.abs("diff_pct") < 10, "GOOD").when(F.col("diff_pct") < 50, "WATCH").otherwise("BAD")
    return (
        keyed.join(F.broadcast(table), "key")
        .withColumn("diff_pct", diff)
        .select(*by, "benchmark", "metric", "value", "expected", "diff_pct", status.alias("status"))
    )


def newest_records(df: DataFrame, by: list[str], at: str, tie: str, n: int) -> DataFrame:
    """Newest n records per key (feedback, breaches, changes, verdicts)."""
    return ranks.newest(df, by, [F.col(at).desc(), F.col(tie).desc()], n, F.col(tie))
