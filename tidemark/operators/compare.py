"""Drift between two fingerprints on twelve dimensions, and what explains it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.functions import constants as K
from tidemark.operators import distance as D
from tidemark.operators import fingerprint as FP
from tidemark.operators import pairs as P
from tidemark.operators import ranks

SIDE_COLUMNS = [
    "n",
    "avg_output_length",
    "avg_loop_count",
    "avg_verbosity_ratio",
    "avg_retry_count",
    "avg_time_to_first_tool_ms",
    "error_rate",
    "p50_latency_ms",
    "p95_latency_ms",
    "p95_loop_count",
]


# ---- scores ------------------------------------------------------------------------------------
def _gaps() -> dict[str, Column]:
    b, c = (lambda x: F.col(f"b_{x}")), (lambda x: F.col(f"c_{x}"))
    relative = lambda x: F.abs(c(x) - b(x)) / F.greatest(b(x), F.lit(1.0))
    return {
        "latency": relative("p95_latency_ms"),
        "error": F.least(F.lit(1.0), 2 * F.abs(c("error_rate") - b("error_rate"))),
        "verbosity": F.abs(c("avg_verbosity_ratio") - b("avg_verbosity_ratio")),
        "loop": relative("p95_loop_count"),
        "output": relative("avg_output_length"),
        "retry": F.abs(c("avg_retry_count") - b("avg_retry_count")),
        "first_tool": relative("avg_time_to_first_tool_ms"),
    }


def dimension_scores(with_emd: bool = True) -> dict[str, tuple[Column, Column]]:
    """Per dimension the reported score and the term that enters the composite."""
    g, one, s = _gaps(), F.lit(1.0), C.anchored_sigmoid
    decision, outcome = F.col("decision_jsd"), F.col("outcome_jsd")
    latency_term = s(g["latency"], 2.0, 1.0)
    if with_emd:
        latency_term = F.when(
            F.col("emd").isNotNull(), 0.5 * latency_term + 0.5 * C.emd_signal(F.col("emd"))
        ).otherwise(latency_term)
    verbosity = s(g["verbosity"], 3.0, 0.3)
    return {
        "decision_drift": (decision, decision),
        "semantic_drift": (outcome, s(outcome, 4.0, 0.3)),
        "latency": (F.least(one, g["latency"]), latency_term),
        "error_rate": (g["error"], s(g["error"], 4.0, 0.3)),
        "tool_distribution": (decision, decision),
        "verbosity_ratio": (verbosity, verbosity),
        "loop_depth": (F.least(one, g["loop"]), s(g["loop"], 2.5, 0.4)),
        "output_length": (F.least(one, g["output"]), s(g["output"], 2.0, 0.4)),
        "tool_sequence": (decision, decision),
        "retry_rate": (F.least(one, 2 * g["retry"]), s(g["retry"], 4.0, 0.2)),
        "time_to_first_tool": (F.least(one, g["first_tool"]), s(g["first_tool"], 2.0, 0.5)),
        "tool_sequence_transitions": (F.col("transition_distance"), F.col("transition_distance")),
    }


def resample_composite() -> Column:
    """Fixed-weight composite used on replicates: ten terms, latency by its 95th percentile only."""
    g, s, w = _gaps(), C.anchored_sigmoid, K.RESAMPLE_WEIGHTS
    decision = F.col("decision_jsd")
    terms = {
        "decision": decision,
        "latency": s(g["latency"], 2.0, 1.0),
        "errors": s(g["error"], 4.0, 0.3),
        "semantic": s(F.col("outcome_jsd"), 4.0, 0.3),
        "output": s(F.least(F.lit(1.0), g["output"]), 3.0, 0.3),
        "verbosity": s(g["verbosity"], 3.0, 0.3),
        "loop": s(g["loop"], 2.5, 0.4),
        "output_length": s(g["output"], 2.0, 0.4),
        "tool_sequence": decision,
        "retry": s(g["retry"], 4.0, 0.2),
    }
    total = F.lit(0.0)
    for name, term in terms.items():
        total = total + F.lit(w[name]) * term
    return C.clamp01(total)


def floor_composite(total: Column, decision: Column) -> Column:
    clamped = C.clamp01(total)
    return F.when(decision > 0.30, F.greatest(clamped, F.lit(0.15))).otherwise(clamped)


def compared(fp_scalar: DataFrame, dist: DataFrame, pairs: DataFrame, emd: DataFrame | None = None) -> DataFrame:
    """One row per pair: both sides' numbers, divergences and, if given, the latency distance."""
    wide = P.both_sides(fp_scalar, pairs, SIDE_COLUMNS)
    jsd = D.jsd_wide(D.share_table(dist, pairs))
    wide = wide.join(jsd, K.PAIR, "left").fillna(
        0.0, ["decision_jsd", "outcome_jsd", "tool_jsd", "transition_distance"]
    )
    if emd is None:
        return wide.withColumn("emd", F.lit(None).cast("double"))
    return wide.join(emd, K.PAIR, "left")


ExtraDims = dict[str, Callable[[Callable[[str], Column], Callable[[str], Column]], Column]]


def drift_dim(wide: DataFrame, extra_dims: ExtraDims | None = None) -> DataFrame:
    """Long form: (pair, dim, score, term). ``extra_dims`` maps a name to f(baseline, current)."""
    scores = dict(dimension_scores())
    for name, fn in (extra_dims or {}).items():
        value = fn(lambda c: F.col(f"b_{c}"), lambda c: F.col(f"c_{c}"))
        scores[name] = (value, value)
    rows = F.array(
        *[
            F.struct(F.lit(dim).alias("dim"), score.cast("double").alias("score"), term.cast("double").alias("term"))
            for dim, (score, term) in scores.items()
        ]
    )
    return wide.select(*K.PAIR, F.explode(rows).alias("d")).select(*K.PAIR, "d.dim", "d.score", "d.term")


def drift(wide: DataFrame, weights: dict[str, float] | None = None, needed: int = K.TIER2_MIN) -> DataFrame:
    """Whole comparison with one weight set for all pairs, straight from the wide rows (no shuffle)."""
    weights = weights or K.FALLBACK_WEIGHTS
    scores = dimension_scores()
    total = F.lit(0.0)
    for dim, (_, term) in scores.items():
        total = total + F.lit(float(weights.get(dim, 0.0))) * term
    n = F.least(F.col("b_n"), F.col("c_n"))
    return (
        wide.select(
            *K.PAIR,
            F.col("b_n").alias("baseline_n"),
            F.col("c_n").alias("current_n"),
            *[score.alias(dim) for dim, (score, _) in scores.items()],
            floor_composite(total, F.col("decision_jsd")).alias("drift_score"),
        )
        .withColumn("severity", C.severity(F.col("drift_score"), F.least("baseline_n", "current_n")))
        .withColumn("tier", C.tier(F.least("baseline_n", "current_n"), F.lit(needed)))
    )


def composite(dims: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Weighted score per pair from the long form; ``weights`` holds (pair, dim, weight)."""
    if weights is None:
        mapping = F.create_map(*[F.lit(x) for kv in K.FALLBACK_WEIGHTS.items() for x in kv])
        weighted = dims.withColumn("weight", F.coalesce(mapping[F.col("dim")], F.lit(0.0)))
    else:
        weighted = dims.join(weights.select(*K.PAIR, "dim", "weight"), [*K.PAIR, "dim"], "left").fillna(0.0, ["weight"])
    decision = F.max(F.when(F.col("dim") == "decision_drift", F.col("score")))
    return weighted.groupBy(*K.PAIR).agg(
        floor_composite(F.sum(F.col("weight") * F.col("term")), decision).alias("drift_score"),
        decision.alias("decision_drift"),
    )


# ---- clusters ----------------------------------------------------------------------------------
def cluster_drift(runs: DataFrame, pairs: DataFrame, k: int = 5, min_n: int = 10) -> DataFrame:
    """Drift inside each common task cluster, with its contributors in order of size."""
    by = [*K.GROUP, "cluster"]
    tagged = runs.withColumn("cluster", C.task_cluster(F.col("tools"), F.col("raw_prompt")))
    per_sequence = tagged.groupBy(*by, C.sequence_key(F.col("tools")).alias("key")).agg(
        F.count("*").alias("k"), F.sum("error_count").alias("errors")
    )
    stats = per_sequence.groupBy(*by).agg(
        F.sum("k").alias("n"),
        (F.sum("errors") / F.sum("k")).alias("error_rate"),
        (F.count("*") / F.sum("k")).alias("variance"),
    )
    top = ranks.newest(stats, K.GROUP, [F.col("n").desc(), F.col("cluster")], k, F.col("cluster"))
    p95 = ranks.floor_percentile(tagged, by, "latency_ms", {"p95": ranks.percent_rank(95)})
    columns = ["n", "error_rate", "variance", "p95"]
    sided = P.attach(top.join(p95, by), pairs)
    wide = P.pivot_sides(sided, columns, [*K.PAIR, "cluster"]).where((F.col("b_n") >= min_n) & (F.col("c_n") >= min_n))
    latency = F.abs(F.col("c_p95") - F.col("b_p95")) / F.greatest(F.col("b_p95"), F.lit(1.0))
    errors = F.abs(F.col("c_error_rate") - F.col("b_error_rate"))
    variance = F.abs(F.col("c_variance") - F.col("b_variance"))
    one = F.lit(1.0)
    score = 0.4 * F.least(one, latency) + 0.4 * F.least(one, 2 * errors) + 0.2 * F.least(one, variance)
    entry = lambda pos, name, v: F.struct((-v).alias("minus"), F.lit(pos).alias("pos"), F.lit(name).alias("name"))
    ordered = F.array_sort(
        F.array(entry(0, "latency_p95", latency), entry(1, "error_rate", errors), entry(2, "tool_variance", variance))
    )
    return wide.select(
        *K.PAIR,
        "cluster",
        F.col("b_n").alias("baseline_n"),
        F.col("c_n").alias("current_n"),
        C.clamp01(score).alias("cluster_score"),
        F.array_join(F.transform(ordered, lambda e: e["name"]), ",").alias("contributors"),
    )


# ---- tools and transitions ---------------------------------------------------------------------
def tool_frequency_diff(dist: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per tool: counts, shares in percent, relative and absolute change."""
    shares = D.share_table(dist.where(F.col("kind") == "tool"), pairs)
    b, c = F.col("p") * 100, F.col("q") * 100
    change = F.when(b == 0, F.when(c > 0, 100.0).otherwise(0.0)).otherwise((c - b) / b * 100)
    return shares.select(
        *K.PAIR,
        F.col("key").alias("tool"),
        F.col("b_n").alias("baseline_count"),
        F.col("c_n").alias("current_count"),
        F.bround(b, 2).alias("baseline_pct"),
        F.bround(c, 2).alias("current_pct"),
        F.bround(change, 1).alias("delta_pct"),
        (F.col("c_n") - F.col("b_n")).alias("delta_abs"),
    )


def transition_shifts(dist: DataFrame, pairs: DataFrame, k: int = 3) -> DataFrame:
    """The k tool transitions whose share moved most, in percentage points."""
    shares = D.share_table(dist.where(F.col("kind") == "bigram"), pairs).withColumn(
        "delta", (F.col("q") - F.col("p")) * 100
    )
    order = [F.abs(F.bround("delta", 1)).desc(), F.col("key").asc()]
    w = Window.partitionBy(*K.PAIR).orderBy(*order)
    return (
        ranks.newest(shares, K.PAIR, order, k, F.col("key"))
        .withColumn("position", F.row_number().over(w))
        .select(
            *K.PAIR,
            "position",
            F.col("key").alias("transition"),
            F.bround(F.col("p") * 100, 2).alias("baseline_pct"),
            F.bround(F.col("q") * 100, 2).alias("current_pct"),
            F.bround("delta", 1).alias("delta_pct"),
        )
    )


def biggest_tool_moves(dist: DataFrame, pairs: DataFrame) -> DataFrame:
    """Largest fall beyond -20 % and largest rise beyond +50 % per pair (a new tool rises 100 %)."""
    shares = D.share_table(dist.where(F.col("kind") == "tool"), pairs)
    b, c = F.col("p") * 100, F.col("q") * 100
    change = F.when(b == 0, 100.0).otherwise((c - b) / b * 100)
    moved = shares.withColumn("change", change)
    fall = F.min(F.when(F.col("change") < -20, F.struct("change", "key")))
    rise = F.min(F.when(F.col("change") > 50, F.struct((-F.col("change")).alias("minus"), F.col("key"))))
    return (
        moved.groupBy(*K.PAIR)
        .agg(fall.alias("f"), rise.alias("r"))
        .select(
            *K.PAIR,
            F.col("f.key").alias("fallen_tool"),
            F.col("f.change").alias("fall_pct"),
            F.col("r.key").alias("risen_tool"),
            (-F.col("r.minus")).alias("rise_pct"),
        )
    )


def largest_share_shift(dist: DataFrame, pairs: DataFrame, kind: str = "sequence") -> DataFrame:
    """The key of one kind with the largest absolute change in share, and how it changed."""
    shares = D.share_table(dist.where(F.col("kind") == kind), pairs)
    best = F.min(F.struct((-F.abs(F.col("q") - F.col("p"))).alias("minus"), F.col("key"), F.col("p"), F.col("q")))
    b, c = F.col("p") * 100, F.col("q") * 100
    how = (
        F.when(b < 0.1, "appeared").when(c < 0.1, "vanished").when(c > b, "increased").otherwise("decreased")
    )
    return (
        shares.groupBy(*K.PAIR)
        .agg(best.alias("s"))
        .where(F.col("s.minus") < 0)
        .select(*K.PAIR, "s.key", "s.p", "s.q")
        .select(*K.PAIR, F.col("key"), b.alias("baseline_pct"), c.alias("current_pct"), how.alias("change"))
    )


def indicative_signals(wide: DataFrame) -> DataFrame:
    """Directions of the dimensions that moved enough to mention, one row each."""
    b, c = (lambda x: F.col(f"b_{x}")), (lambda x: F.col(f"c_{x}"))
    base_p95 = F.greatest(b("p95_latency_ms"), F.lit(1))
    latency = (c("p95_latency_ms") - base_p95) / base_p95
    errors = c("error_rate") - b("error_rate")
    relative = lambda x: F.when(b(x) > 0, (c(x) - b(x)) / b(x))
    updown = lambda v, cut: F.when(F.abs(v) > cut, F.when(v > 0, "up").otherwise("down"))
    strength = lambda v: F.when(v > 0.20, "up").when(v > 0.10, "changed")
    signals = {
        "decision_patterns": strength(F.col("decision_jsd")),
        "latency": updown(latency, 0.10),
        "error_rate": updown(errors, 0.05),
        "verbosity": updown(relative("avg_verbosity_ratio"), 0.15),
        "reasoning_depth": updown(relative("p95_loop_count"), 0.20),
        "outcome_patterns": strength(F.col("outcome_jsd")),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("signal"), v.alias("direction")) for k, v in signals.items()])
    return (
        wide.select(*K.PAIR, F.explode(rows).alias("s"))
        .select(*K.PAIR, "s.signal", "s.direction")
        .where(F.col("direction").isNotNull())
    )


# ---- words -------------------------------------------------------------------------------------
def evidence(wide: DataFrame, sequence_shift: DataFrame, outcome_shift: DataFrame) -> DataFrame:
    """One sentence per pair and dimension from both sides' values."""
    renamed = lambda df, p: df.select(*K.PAIR, *[F.col(c).alias(f"{p}_{c}") for c in ("key", "baseline_pct", "current_pct", "change")])
    full = wide.join(renamed(sequence_shift, "seq"), K.PAIR, "left").join(renamed(outcome_shift, "out"), K.PAIR, "left")
    b, c = (lambda x: F.col(f"b_{x}")), (lambda x: F.col(f"c_{x}"))
    fs = F.format_string
    dp = C.fixed
    path = F.concat(
        F.lit("["), F.array_join(F.from_json(F.col("seq_key"), "array<string>"), ", "), F.lit("]")
    )
    s_b, s_c = dp(F.col("seq_baseline_pct"), 1), dp(F.col("seq_current_pct"), 1)
    decision = (
        F.when(F.col("seq_key").isNull(), F.lit("Tool sequence distribution changed"))
        .when(F.col("seq_change") == "appeared", fs("New tool path %s appeared in %.1f%% of runs", path, s_c))
        .when(F.col("seq_change") == "vanished", fs("Tool path %s dropped from %.1f%% to near 0%%", path, s_b))
        .otherwise(fs("Tool path %s %s from %.1f%% to %.1f%% of runs", path, F.col("seq_change"), s_b, s_c))
    )
    # Java rounds halves up and drops the sign of a rounded zero; the text keeps both as they were.
    size = lambda d, digits: fs(f"%.{digits}f", dp(F.abs(d), digits))
    signed = lambda d, digits: F.concat(F.when(d < 0, "-").otherwise("+"), size(d, digits))
    minus = lambda d, digits: F.concat(F.when(d < 0, "-").otherwise(""), size(d, digits))
    word = lambda d: F.when(d > 0, "increased").otherwise("decreased")
    plus = lambda d: F.when(d > 0, "+").otherwise("")
    p95b, p95c, p50b, p50c = b("p95_latency_ms"), c("p95_latency_ms"), b("p50_latency_ms"), c("p50_latency_ms")
    up95 = p95c - p95b
    latency = (
        F.when(p95b == 0, fs("P95 latency changed to %,dms", p95c))
        .when(
            (p50b > 0) & (F.abs((p50c - p50b) / p50b) * 100 > 10),
            fs("Median latency %s from %,dms to %,dms; P95 from %,dms to %,dms", word(up95), p50b, p50c, p95b, p95c),
        )
        .otherwise(
            fs("P95 latency %s from %,dms to %,dms (%s%s%%)", word(up95), p95b, p95c, plus(up95), signed(up95 / p95b * 100, 0))
        )
    )

    def moved(label: str, name: str, spec: str, unit: str, digits: int, zero: str) -> Column:
        before, after = b(name), c(name)
        delta = after - before
        return F.when(before == 0, fs(f"{zero} changed to {spec}{unit}", dp(after, digits))).otherwise(
            fs(
                f"{label} %s from {spec} to {spec}{unit} (%s%s%%)",
                word(delta), dp(before, digits), dp(after, digits), plus(delta), signed(delta / before * 100, 0),
            )
        )

    def rate(label: str, name: str, tail: str) -> Column:
        before, after = b(name) * 100, c(name) * 100
        delta = after - before
        return fs(
            f"{label} %s from %.1f%% to %.1f%%{tail} (%s%spp)",
            word(delta), dp(before, 1), dp(after, 1), plus(delta), minus(delta, 1),
        )

    o_b, o_c = F.col("out_baseline_pct"), F.col("out_current_pct")
    outcomes = F.when(F.col("out_key").isNull(), F.lit("Semantic cluster distribution changed")).otherwise(
        fs(
            "Semantic cluster '%s' %s from %.1f%% to %.1f%% of outcomes",
            F.col("out_key"), F.when(o_c > o_b, "grew").otherwise("shrank"), dp(o_b, 1), dp(o_c, 1),
        )
    )
    sentences = {
        "decision_drift": decision,
        "semantic_drift": outcomes,
        "latency": latency,
        "error_rate": rate("Error rate", "error_rate", ""),
        "tool_distribution": decision,
        "verbosity_ratio": moved("Verbosity ratio", "avg_verbosity_ratio", "%.2f", "", 2, "Verbosity ratio"),
        "loop_depth": moved("Average loop depth", "avg_loop_count", "%.1f", " iterations", 1, "Average loop depth"),
        "output_length": moved("Average output length", "avg_output_length", "%,.0f", " chars", 0, "Average output length"),
        "tool_sequence": decision,
        "retry_rate": rate("Retry rate", "avg_retry_count", " of runs"),
        "time_to_first_tool": moved("Time to first tool", "avg_time_to_first_tool_ms", "%,.0f", "ms", 0, "Time to first tool"),
        "tool_sequence_transitions": decision,
    }
    rows = F.array(*[F.struct(F.lit(k).alias("dim"), v.alias("evidence")) for k, v in sentences.items()])
    return full.select(*K.PAIR, F.explode(rows).alias("e")).select(*K.PAIR, "e.dim", "e.evidence")


def regression_pattern(metrics: DataFrame, pairs: DataFrame) -> DataFrame:
    """Named regressions with a confidence, from ``run_metrics`` of both sides."""
    columns = [
        "avg_latency", "avg_prompt_tokens", "avg_completion_tokens", "avg_loop_count", "avg_retry_count", "avg_tool_count",
    ]
    wide = P.both_sides(metrics, pairs, columns)
    growth = lambda x: F.when(F.col(f"b_{x}") != 0, (F.col(f"c_{x}") - F.col(f"b_{x}")) / F.col(f"b_{x}"))
    tokens = growth("avg_prompt_tokens") + growth("avg_completion_tokens")
    loops, retries = growth("avg_loop_count"), growth("avg_retry_count")
    fewer = -growth("avg_tool_count")
    capped = lambda v, top: F.least(v / F.lit(top), F.lit(1.0))
    found = {
        "token-bloat": F.when(growth("avg_completion_tokens") > 1.5, capped(growth("avg_completion_tokens"), 3.0)),
        "loop-detection": F.when((loops > 2.0) | (retries > 3.0), capped(loops + retries, 8.0)),
        "tool-dropout": F.when(fewer > 0.2, capped(fewer, 0.4)),
        "cost-explosion": F.when(tokens > 2.0, capped(tokens, 4.0)),
        "latency-creep": F.when(growth("avg_latency") > 2.0, capped(growth("avg_latency"), 4.0)),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("pattern"), v.alias("confidence")) for k, v in found.items()])
    return (
        wide.select(*K.PAIR, F.explode(rows).alias("r"))
        .select(*K.PAIR, "r.pattern", "r.confidence")
        .where(F.col("confidence").isNotNull())
    )


def explanation(wide: DataFrame, scored: DataFrame, tool_diff: DataFrame, threshold: float = K.DRIFT_THRESHOLD) -> DataFrame:
    """Plain sentence for pairs whose score reaches the threshold."""
    drop = F.min(F.when(F.col("delta_pct") < -5, F.struct("delta_pct", "tool")))
    rise = F.min(F.when(F.col("delta_pct") > 20, F.struct((-F.col("delta_pct")).alias("minus"), F.col("tool"))))
    moves = tool_diff.groupBy(*K.PAIR).agg(drop.alias("drop"), rise.alias("rise"))
    fs = F.format_string
    step = (F.col("c_p95_latency_ms") - F.col("b_p95_latency_ms")).cast("long")
    joined = scored.select(*K.PAIR, "drift_score", "error_rate").join(
        wide.select(*K.PAIR, "b_p95_latency_ms", "c_p95_latency_ms"), K.PAIR
    ).join(moves, K.PAIR, "left")
    part_drop = F.when(
        F.col("drop").isNotNull(),
        fs("Tool '%s' usage dropping by %.0f%%", F.col("drop.tool"), F.bround(F.abs(F.col("drop.delta_pct")), 0)),
    )
    part_rise = F.when(
        F.col("rise").isNotNull(),
        fs("Tool '%s' usage increasing by %.0f%%", F.col("rise.tool"), F.bround(-F.col("rise.minus"), 0)),
    )
    part_latency = F.when(step >= 100, fs("Latency increasing by %dms", step)).when(
        step <= -100, fs("Latency decreasing by %dms", -step)
    )
    part_error = F.when(F.col("error_rate") >= 0.2, F.lit("Error rate increased significantly"))
    parts = F.concat_ws(" and ", part_drop, part_rise, part_latency, part_error)
    fallback = fs(
        "Drift score %.2f exceeds threshold %.2f. Review dimension breakdown and tool changes.",
        C.fixed(F.col("drift_score"), 2), F.lit(threshold),
    )
    text = F.when(parts == "", fallback).otherwise(F.concat(F.lit("Drift driven by "), parts, F.lit(".")))
    return joined.where(F.col("drift_score") >= threshold).select(*K.PAIR, text.alias("explanation"))


def prepared(runs: DataFrame, pairs: DataFrame | None = None, kinds: Sequence[str] = FP.KINDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs, wide comparison and distributions for a table of runs."""
    pairs = pairs if pairs is not None else P.consecutive_pairs(runs)
    dist = FP.fp_dist(runs, K.GROUP, kinds)
    return pairs, compared(FP.fp_scalar(runs), dist, pairs, D.emd(runs, pairs)), dist
