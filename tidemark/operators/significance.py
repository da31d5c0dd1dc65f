"""Significance tests, needed sample sizes, confidence tiers and attribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.functions import constants as K
from tidemark.operators import distance as D
from tidemark.operators import pairs as P


def _normal_tail(z: Column) -> Column:
    return (
        F.when(z > 3, 0.001).when(z > 2.5, 0.01).when(z > 2.0, 0.025).when(z > 1.96, 0.05).when(z > 1.0, 0.16).otherwise(0.50)
    )


def chi2_p(chi2: Column, df: Column) -> Column:
    """Stepped p-value; beyond df 10 and up to 30 the df 1 cut applies, above 30 a normal tail."""
    cut = F.lit(K.CHI2_CRITICAL[1])
    for degrees, value in K.CHI2_CRITICAL.items():
        cut = F.when(df == degrees, F.lit(value)).otherwise(cut)
    return (
        F.when(df <= 0, 1.0)
        .when(df > 30, _normal_tail((chi2 - df) / F.sqrt(2 * df)))
        .when(chi2 > cut, 0.01)
        .otherwise(0.10)
    )


def t_p(t: Column, df: Column) -> Column:
    return (
        F.when(df <= 0, 1.0)
        .when(df > 30, 2 * _normal_tail(t))
        .when(t > 2.5, 0.01)
        .when(t > 2.0, 0.05)
        .when(t > 1.5, 0.10)
        .otherwise(0.20)
    )


def chi2_test(counts: DataFrame, alpha: float = 0.05, by: list[str] | None = None) -> DataFrame:
    """Two-sample chi-square. ``counts``: pair, label, b_n, c_n (one row per label).

    Uses sum(b*b/l) and sum(c*c/l) over labels, so the labels need one pass and no totals first:
    chi2 = (N/B) sum(b*b/l) + (N/C) sum(c*c/l) - N with l = b + c.
    """
    by = by or K.PAIR
    b, c = F.col("b_n").cast("double"), F.col("c_n").cast("double")
    sums = counts.where((F.col("b_n") + F.col("c_n")) > 0).groupBy(*by).agg(
        F.sum(b).alias("tb"),
        F.sum(c).alias("tc"),
        F.sum(b * b / (b + c)).alias("sb"),
        F.sum(c * c / (b + c)).alias("sc"),
        (F.count("*") - 1).alias("df"),
    )
    n = F.col("tb") + F.col("tc")
    chi2 = F.greatest(F.lit(0.0), n / F.col("tb") * F.col("sb") + n / F.col("tc") * F.col("sc") - n)
    valid = (F.col("tb") > 0) & (F.col("tc") > 0)
    return (
        sums.withColumn("statistic", F.when(valid, chi2).otherwise(0.0))
        .withColumn("df", F.when(valid, F.col("df")).otherwise(F.lit(0)).cast("long"))
        .withColumn("p_value", F.when(valid, chi2_p(F.col("statistic"), F.col("df"))).otherwise(1.0))
        .withColumn("effect_size", F.when(valid, F.sqrt(F.col("statistic") / n)).otherwise(0.0))
        .withColumn("significant", F.col("p_value") < alpha)
        .select(*by, "statistic", "df", "p_value", "effect_size", "significant")
    )


def welch_t(runs: DataFrame, pairs: DataFrame, column: str = "latency_ms", alpha: float = 0.05) -> DataFrame:
    """Welch's t-test of one column's mean, from per-group moments."""
    moments = runs.where(F.col(column).isNotNull()).groupBy(*K.GROUP).agg(
        F.count("*").alias("n"), F.avg(column).alias("mean"), F.coalesce(F.var_samp(column), F.lit(0.0)).alias("var")
    )
    wide = P.both_sides(moments, pairs, ["n", "mean", "var"])
    n1, n2, v1, v2 = F.col("b_n"), F.col("c_n"), F.col("b_var"), F.col("c_var")
    e1, e2 = v1 / n1, v2 / n2
    enough = (n1 >= 2) & (n2 >= 2)
    t = F.when(e1 + e2 == 0, 0.0).otherwise((F.col("b_mean") - F.col("c_mean")) / F.sqrt(e1 + e2))
    df = F.when((v1 > 0) & (v2 > 0), (e1 + e2) * (e1 + e2) / (e1 * e1 / (n1 - 1) + e2 * e2 / (n2 - 1))).otherwise(
        n1 + n2 - 2
    )
    pooled = F.sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2))
    d = F.when(pooled > 0, F.abs(F.col("b_mean") - F.col("c_mean")) / pooled).otherwise(0.0)
    return (
        wide.withColumn("statistic", F.when(enough, t).otherwise(0.0))
        .withColumn("raw_df", F.when(enough, df).otherwise(0.0))
        .withColumn("p_value", F.when(enough, t_p(F.abs("statistic"), F.col("raw_df"))).otherwise(1.0))
        .withColumn("effect_size", F.when(enough, d).otherwise(0.0))
        .withColumn("df", F.col("raw_df").cast("long"))
        .withColumn("significant", F.col("p_value") < alpha)
        .select(*K.PAIR, "statistic", "df", "p_value", "effect_size", "significant")
    )


def outcome_counts(dist: DataFrame, pairs: DataFrame) -> DataFrame:
    return D.share_table(dist.where(F.col("kind") == "outcome"), pairs)


def error_counts(runs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Runs with and without an error per pair and side."""
    counts = runs.groupBy(
        *K.GROUP, F.when(F.col("error_count") > 0, "error").otherwise("success").alias("key")
    ).agg(F.count("*").alias("n"))
    counts = counts.withColumn("kind", F.lit("error")).withColumn("share", F.lit(0.0))
    return D.share_table(counts, pairs)


def significance(runs: DataFrame, dist: DataFrame, pairs: DataFrame, alpha: float = 0.05) -> DataFrame:
    """The three tests of a pair: outcomes, positive latency, error against success."""
    outcomes = chi2_test(outcome_counts(dist, pairs), alpha).withColumn("test", F.lit("outcomes"))
    latency = welch_t(runs.where(F.col("latency_ms") > 0), pairs, "latency_ms", alpha).withColumn("test", F.lit("latency"))
    errors = chi2_test(error_counts(runs, pairs), alpha).withColumn("test", F.lit("errors"))
    return outcomes.unionByName(latency).unionByName(errors)


# ---- needed runs and tiers ---------------------------------------------------------------------
def needed_runs(sigma: Column, n: Column, effect: Column) -> Column:
    """Runs per side needed to see a shift of ``effect``, 10 to 200; 50 without enough values."""
    z = K.Z_ALPHA + K.Z_BETA
    raw = F.ceil(2 * F.pow(F.lit(z) * sigma / effect, F.lit(2.0)))
    return (
        F.when(n < 10, F.lit(50)).when(sigma < 0.001, F.lit(10)).otherwise(F.least(F.lit(200), F.greatest(F.lit(10), raw)))
    ).cast("long")


def effect_size(use_case: Column) -> Column:
    mapping = F.create_map(*[F.lit(x) for kv in K.EFFECT_SIZES.items() for x in kv])
    return F.coalesce(mapping[use_case], F.lit(K.DEFAULT_EFFECT_SIZE))


def min_runs_dim(stats: DataFrame, use_case: Column | None = None) -> DataFrame:
    """Needed runs per group and dimension from ``calibrate.dim_stats``."""
    effect = effect_size(use_case if use_case is not None else F.lit("GENERAL"))
    return stats.withColumn("min_runs", needed_runs(F.col("sigma"), F.col("n_values"), effect))


def min_runs(per_dim: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The largest need over the dimensions (at least 30) and the dimension that sets it."""
    by = by or K.GROUP
    order = F.array_position(F.array(*[F.lit(d) for d in K.DIMS]), F.col("dim"))
    limiting = F.min(F.struct((-F.col("min_runs")).alias("minus"), order.alias("pos"), F.col("dim")))
    return (
        per_dim.groupBy(*by)
        .agg(limiting.alias("l"))
        .select(*by, F.greatest(F.lit(30), -F.col("l.minus")).alias("needed"), F.col("l.dim").alias("limiting_dim"))
    )


def dim_status(per_dim: DataFrame, sizes: DataFrame) -> DataFrame:
    """insufficient / indicative / reliable per pair and dimension. ``sizes``: pair, b_n, c_n."""
    base = per_dim.select(
        *K.AGENT, F.col("deployment_version").alias("baseline_version"), "dim", "min_runs"
    )
    n = F.least("b_n", "c_n")
    status = F.when(n < K.TIER1_MIN, "insufficient").when(n < F.col("min_runs"), "indicative").otherwise("reliable")
    return sizes.join(base, [*K.AGENT, "baseline_version"]).select(
        *K.PAIR, "dim", n.alias("smaller_n"), "min_runs", status.alias("status")
    )


def tiers(sizes: DataFrame, per_dim: DataFrame) -> DataFrame:
    """Confidence tier per pair: sample size against need, or eight reliable dimensions at 80 %."""
    needed = min_runs(per_dim).select(
        *K.AGENT, F.col("deployment_version").alias("baseline_version"), "needed", "limiting_dim"
    )
    reliable = (
        dim_status(per_dim, sizes)
        .groupBy(*K.PAIR)
        .agg(F.count_if(F.col("status") == "reliable").alias("reliable_dims"))
    )
    joined = (
        sizes.join(needed, [*K.AGENT, "baseline_version"], "left")
        .join(reliable, K.PAIR, "left")
        .withColumn("needed", F.coalesce("needed", F.lit(K.TIER2_MIN)))
        .withColumn("reliable_dims", F.coalesce("reliable_dims", F.lit(0)))
    )
    n = F.least("b_n", "c_n")
    partial = (F.col("reliable_dims") >= 8) & (n < F.col("needed")) & (n >= 0.8 * F.col("needed"))
    return joined.withColumn("partial", partial).select(
        *K.PAIR,
        n.alias("smaller_n"),
        "needed",
        "limiting_dim",
        "reliable_dims",
        "partial",
        F.when(partial, "TIER3").otherwise(C.tier(n, F.col("needed"))).alias("tier"),
    )


def version_source_downgrade(tiered: DataFrame, mix: DataFrame) -> DataFrame:
    """Lowers the tier by one when calendar versions dominate a side; unknown versions only warn."""
    pairs = tiered.select(*K.PAIR)
    shares = P.attach(mix.select(*K.GROUP, "epoch_share", "unknown_share"), pairs)
    worst = shares.groupBy(*K.PAIR).agg(F.max("epoch_share").alias("epoch"), F.max("unknown_share").alias("unknown"))
    epoch, unknown = F.coalesce("epoch", F.lit(0.0)) > 0.5, F.coalesce("unknown", F.lit(0.0)) > 0.5
    lowered = F.when(F.col("tier") == "TIER3", "TIER2").otherwise("TIER1")
    return tiered.join(worst, K.PAIR, "left").select(
        *K.PAIR,
        F.col("tier").alias("tier_before"),
        F.when(epoch, lowered).otherwise(F.col("tier")).alias("tier"),
        F.when(epoch, "time-bucketed").when(unknown, "unknown-source").otherwise("none").alias("warning"),
    )


# ---- attribution -------------------------------------------------------------------------------
def attribution(dims: DataFrame, scores: DataFrame, weights: DataFrame) -> DataFrame:
    """Composite minus the weighted sum of raw scores without the dimension. weights: dim, weight."""
    joined = dims.join(weights, "dim")
    total = F.sum(F.col("weight") * F.col("score")).over(Window.partitionBy(*K.PAIR))
    return (
        joined.withColumn("total", total)
        .join(scores.select(*K.PAIR, "drift_score"), K.PAIR)
        .select(
            *K.PAIR,
            "dim",
            (F.col("drift_score") - (F.col("total") - F.col("weight") * F.col("score"))).alias("attribution"),
        )
    )


def marginal(dims: DataFrame, weights: DataFrame) -> DataFrame:
    """weight x score and weight x composite term per dimension."""
    return dims.join(weights, "dim").select(
        *K.PAIR,
        "dim",
        (F.col("weight") * F.col("score")).alias("marginal"),
        (F.col("weight") * F.col("term")).alias("term_share"),
    )


def top_contributors(attributed: DataFrame, k: int = 3) -> DataFrame:
    """The k dimensions with the largest absolute attribution and their percent of the total."""
    order = F.array_position(F.array(*[F.lit(d) for d in K.DIMS]), F.col("dim"))
    size = F.abs(F.round("attribution", 9))
    ranked = Window.partitionBy(*K.PAIR).orderBy(size.desc(), order)
    whole = F.sum(F.abs("attribution")).over(Window.partitionBy(*K.PAIR))
    return (
        attributed.withColumn("position", F.row_number().over(ranked))
        .withColumn("percent", F.when(whole > 0, F.abs("attribution") / whole * 100).otherwise(0.0))
        .where(F.col("position") <= k)
        .select(*K.PAIR, "position", "dim", "attribution", "percent")
    )


def fallback_weights(spark) -> DataFrame:
    """The default weights as a twelve-row table (bounded, so safe to broadcast)."""
    return spark.createDataFrame([(d, float(w)) for d, w in K.FALLBACK_WEIGHTS.items()], "dim string, weight double")
