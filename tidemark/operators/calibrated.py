"""The whole comparison as one job: weights and cuts from each baseline's own variance, tiers from its needs, one verdict per pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.functions import constants as K
from tidemark.operators import calibrate, compare, decide, significance, usecase


def inferred_presets(runs_signals: DataFrame, keyword_guess: DataFrame | None = None) -> DataFrame:
    """(session_id, dim, preset) of every agent: presets of the use cases that its behaviour and, if given, its tools' names suggest."""
    behaviour = usecase.behaviour_use_case(runs_signals)
    if keyword_guess is None:
        keyword_guess = behaviour.select("session_id", F.lit("GENERAL").alias("use_case"), F.lit(0.0).alias("confidence"))
    blended = usecase.blended_weights(usecase.blend_use_case(keyword_guess, behaviour))
    return blended.withColumnRenamed("weight", "preset")


def baseline_weights(
    correlated: DataFrame, stats: DataFrame, presets: DataFrame, unavailable: DataFrame | None = None, learned: DataFrame | None = None
) -> DataFrame:
    """(group, dim, weight): preset x reliability, less for dimensions that repeat each other, none for unavailable ones, blended with learned ones."""
    weights = calibrate.reliability_weights(stats, presets)
    weights = calibrate.correlation_factors(correlated, weights).drop("factor")
    if unavailable is not None:
        weights = calibrate.redistribute(weights, unavailable)
    return weights if learned is None else calibrate.learned_blend(weights, learned)


def gated_drift(wide: DataFrame, weights: DataFrame, tiered: DataFrame) -> DataFrame:
    """The comparison with the weights of each pair's baseline; only TIER3 pairs have scores.

    ``weights``: group, dim, weight; a dimension without one has its fixed weight. ``tiered``: pair, tier (a pair
    without one is TIER1). Pairs of TIER1 and TIER2 have too few runs: all their scores are 0, their severity is none.
    A baseline's weights are a map of twelve entries, so the pairs stay one row each.
    """
    maps = weights.groupBy(*K.GROUP).agg(F.map_from_entries(F.collect_list(F.struct("dim", "weight"))).alias("weights"))
    joined = wide.join(maps.withColumnRenamed("deployment_version", "baseline_version"), [*K.AGENT, "baseline_version"], "left")
    joined = joined.join(tiered.select(*K.PAIR, "tier"), K.PAIR, "left").withColumn("tier", F.coalesce("tier", F.lit("TIER1")))
    scores = compare.dimension_scores()
    total = F.lit(0.0)
    for dim, (_, term) in scores.items():
        total = total + F.coalesce(F.col("weights")[dim], F.lit(float(K.FALLBACK_WEIGHTS.get(dim, 0.0)))) * term

    def gated(score: Column) -> Column:
        return F.when(F.col("tier") == "TIER3", score).otherwise(0.0)

    return joined.select(
        *K.PAIR,
        F.col("b_n").alias("baseline_n"),
        F.col("c_n").alias("current_n"),
        "tier",
        *[gated(score.cast("double")).alias(dim) for dim, (score, _) in scores.items()],
        gated(compare.floor_composite(total, F.col("decision_jsd"))).alias("drift_score"),
    ).withColumn("severity", F.when(F.col("tier") == "TIER3", C.severity(F.col("drift_score"), F.least("baseline_n", "current_n"))).otherwise("none"))


def judged(
    wide: DataFrame,
    stats: DataFrame,
    weights: DataFrame,
    quantiles: DataFrame,
    mix: DataFrame | None = None,
    anomaly: DataFrame | None = None,
    sensitivity: str = "standard",
) -> DataFrame:
    """One row per pair of ``wide``: scores, tier, severity, the pair's own cuts and both verdicts.

    ``stats``: ``dim_stats`` of the runs, ``weights``: ``baseline_weights``, ``quantiles``: ``t_quantiles``; each is used
    in several places, so callers keep them as tables. ``mix`` (version sources per group) lowers tiers; ``anomaly``
    (pair, level) raises the severities of TIER3 pairs. All of it is one row per group and dimension or per pair.
    """
    sizes = wide.select(*K.PAIR, "b_n", "c_n")
    tiered = significance.tiers(sizes, significance.min_runs_dim(stats))
    if mix is not None:
        tiered = significance.version_source_downgrade(tiered, mix)
    cuts = calibrate.composite_thresholds(calibrate.dim_thresholds(stats, quantiles), weights, sizes, sensitivity)
    scored = gated_drift(wide, weights, tiered)
    if anomaly is not None:
        raised = F.when(F.col("tier") == "TIER3", F.col("severity_after")).otherwise("none")
        scored = decide.anomaly_override(scored, anomaly).withColumn("severity", raised).drop("severity_after", "overridden")
    return decide.verdict(scored, cuts)
