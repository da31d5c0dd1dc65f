"""Weights and thresholds learnt from the baseline's own variance, from labels and from feedback."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.functions import constants as K
from tidemark.operators import ranks
from tidemark.session import kept


def dimension_scores(runs: DataFrame, by: Sequence[str] = tuple(K.GROUP)) -> DataFrame:
    """Long per-run scores: (group, id, dim, score), absent where a run says nothing."""
    rows = F.array(
        *[F.struct(F.lit(d).alias("dim"), s.cast("double").alias("score")) for d, s in C.calibration_scores().items()]
    )
    return (
        runs.select(*by, "id", F.explode(rows).alias("s"))
        .select(*by, "id", "s.dim", "s.score")
        .where(F.col("score").isNotNull())
    )


def dim_stats(runs: DataFrame, by: Sequence[str] = tuple(K.GROUP)) -> DataFrame:
    """Mean, population deviation, coefficient of variation and reliability per group and dimension.

    Twelve aggregates in one pass over the runs; the long form is made from the aggregated rows.
    """
    scores = C.calibration_scores()
    wide = runs.groupBy(*by).agg(
        F.count("*").alias("n"),
        *[F.avg(s.cast("double")).alias(f"{d}__mean") for d, s in scores.items()],
        *[F.stddev_pop(s.cast("double")).alias(f"{d}__std") for d, s in scores.items()],
        *[F.count(s).alias(f"{d}__k") for d, s in scores.items()],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(d).alias("dim"),
                F.col(f"{d}__k").alias("n_values"),
                F.coalesce(F.col(f"{d}__mean"), F.lit(0.0)).alias("mean"),
                F.coalesce(F.col(f"{d}__std"), F.lit(0.0)).alias("sigma"),
            )
            for d in scores
        ]
    )
    std = F.when(F.col("sigma") == 0, F.lit(0.01)).otherwise(F.col("sigma"))
    cv = F.when((F.col("n_values") > 0) & (F.col("mean") > 0), F.col("std") / F.col("mean")).otherwise(0.0)
    return (
        wide.select(*by, "n", F.explode(rows).alias("s"))
        .select(*by, "n", "s.*")
        .withColumn("std", std)
        .withColumn("cv", cv)
        .withColumn("reliability", 1 / (1 + F.col("cv")))
    )


def _normalised(df: DataFrame, raw: str, by: Sequence[str], fallback: Column, name: str = "weight") -> DataFrame:
    """raw / sum over the group; twelve rows per group, summed by an aggregation and joined back."""
    totals = df.groupBy(*by).agg(F.sum(raw).alias("__total"))
    return (
        df.join(totals, list(by))
        .withColumn(name, F.when(F.col("__total") > 0, F.col(raw) / F.col("__total")).otherwise(fallback))
        .drop("__total")
    )


def reliability_weights(stats: DataFrame, presets: DataFrame, by: Sequence[str] = tuple(K.GROUP)) -> DataFrame:
    """preset x reliability, normalised. ``presets``: dim, preset (and any of ``by``)."""
    keys = [c for c in presets.columns if c in by] + ["dim"]
    joined = stats.join(presets, keys, "left").withColumn("preset", F.coalesce("preset", F.lit(0.111)))
    raw = joined.withColumn("__raw", F.col("preset") * F.col("reliability"))
    return _normalised(raw, "__raw", by, F.col("preset")).select(*by, "dim", "weight")


def _corr(a: Column, b: Column) -> Column:
    """Pearson correlation over rows where both are present; null when one of them does not vary."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def correlations(runs: DataFrame, by: Sequence[str] = tuple(K.GROUP), min_values: int = 30) -> DataFrame:
    """Spearman correlation of every two dimensions within a group, paired by run.

    Runs are first counted by their tuple of scores, with partial counts before the shuffle, so a tuple that a
    third of all runs share is one weighted row from there on and run ids never travel. Ranks with ties come from the
    counts of each dimension's values. They return to the tuples through one left join per dimension on (group,
    score), whose rank side has one row per key: adaptive execution sends it whole where it is small and splits
    skewed partitions where it is not. Correlations are weighted sums over centred ranks.
    Null and missing scores leave their pairs out.
    """
    by = list(by)
    dims = [d for d in K.DIMS if d not in ("semantic_drift", "tool_sequence_transitions", "tool_sequence", "tool_distribution", "decision_drift")]
    scores = C.calibration_scores()
    tuples = kept(
        runs.select(*by, *[scores[d].cast("double").alias(d) for d in dims]).groupBy(*by, *dims).agg(F.count("*").alias("k")), "tuples"
    )
    each = F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).alias("score")) for d in dims])
    values = (
        tuples.select(*by, "k", F.explode(each).alias("s"))
        .where(F.col("s.score").isNotNull())
        .groupBy(*by, "s.dim", "s.score")
        .agg(F.sum("k").alias("k"))
    )
    rank_rows = kept(ranks.average_rank_of_counts(values, [*by, "dim"], "score"), "ranks")
    ranked = tuples
    for d in dims:
        centred = (F.col("avg_rank") - (F.col("n") + 1) / 2).alias(f"r__{d}")
        of_dim = rank_rows.where(F.col("dim") == d).select(*by, F.col("score").alias(d), centred)
        ranked = ranked.join(of_dim, [*by, d], "left")
    # Sums per pattern of missing scores: within one, every two dimensions share their rows.
    r = {d: F.col(f"r__{d}") for d in dims}
    combos = [(a, b) for i, a in enumerate(dims) for b in dims[i + 1 :]]
    k = F.col("k")
    patterns = ranked.groupBy(*by, F.concat(*[r[d].isNull().cast("string") for d in dims]).alias("pattern")).agg(
        F.sum(k).alias("n"),
        *[F.sum(k * r[d]).alias(f"s__{d}") for d in dims],
        *[F.sum(k * r[a] * r[b]).alias(f"p__{a}__{b}") for a, b in [*zip(dims, dims, strict=True), *combos]],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(a).alias("dim_a"),
                F.lit(b).alias("dim_b"),
                F.col(f"s__{a}").alias("x"),
                F.col(f"s__{b}").alias("y"),
                F.col(f"p__{a}__{a}").alias("xx"),
                F.col(f"p__{b}__{b}").alias("yy"),
                F.col(f"p__{a}__{b}").alias("xy"),
            )
            for a, b in combos
        ]
    )
    # A product is null just where one of the two is missing.
    sums = (
        patterns.select(*by, "n", F.explode(rows).alias("c"))
        .select(*by, "n", "c.*")
        .where(F.col("xy").isNotNull())
        .groupBy(*by, "dim_a", "dim_b")
        .agg(F.sum("n").alias("n_pairs"), *[F.sum(c).alias(c) for c in ("x", "y", "xx", "yy", "xy")])
    )
    n, x, y, xx, yy, xy = (F.col(c) for c in ("n_pairs", "x", "y", "xx", "yy", "xy"))
    var_x, var_y = xx - x * x / n, yy - y * y / n
    # What is left of a constant is rounding alone.
    varies = (var_x > 1e-9 * xx) & (var_y > 1e-9 * yy)
    return sums.where((n >= min_values) & varies).select(
        *by, "dim_a", "dim_b", "n_pairs", ((xy - x * y / n) / F.sqrt(var_x * var_y)).alias("rho")
    )


def correlation_factors(
    correlated: DataFrame, weights: DataFrame, cut: float = 0.70, by: Sequence[str] = tuple(K.GROUP)
) -> DataFrame:
    """Factor per dimension: the lighter one of a strongly correlated pair loses up to half."""
    by = list(by)
    strong = correlated.where(F.col("rho") >= cut)
    wa = weights.select(*by, F.col("dim").alias("dim_a"), F.col("weight").alias("wa"))
    wb = weights.select(*by, F.col("dim").alias("dim_b"), F.col("weight").alias("wb"))
    lighter = (
        strong.join(wa, [*by, "dim_a"])
        .join(wb, [*by, "dim_b"])
        .select(
            *by,
            F.when(F.col("wa") <= F.col("wb"), F.col("dim_a")).otherwise(F.col("dim_b")).alias("dim"),
            (1 - F.least(F.lit(0.5), 0.5 * F.col("rho"))).alias("factor"),
        )
        .groupBy(*by, "dim")
        .agg(F.min("factor").alias("factor"))
    )
    adjusted = (
        weights.join(lighter, [*by, "dim"], "left")
        .withColumn("factor", F.coalesce("factor", F.lit(1.0)))
        .withColumn("__raw", F.col("weight") * F.col("factor"))
        .withColumnRenamed("weight", "before")
    )
    return _normalised(adjusted, "__raw", by, F.col("before")).select(*by, "dim", "factor", "weight")


def redistribute(weights: DataFrame, unavailable: DataFrame, by: Sequence[str] = tuple(K.GROUP)) -> DataFrame:
    """Takes the weight of unavailable dimensions (group, dim) and spreads it over the others."""
    by = list(by)
    keys = [c for c in unavailable.columns if c in (*by, "dim")]
    marked = weights.join(unavailable.select(*keys).distinct().withColumn("gone", F.lit(True)), keys, "left").withColumn(
        "gone", F.coalesce("gone", F.lit(False))
    )
    sums = marked.groupBy(*by).agg(
        F.sum(F.when(F.col("gone"), F.col("weight")).otherwise(0.0)).alias("freed"),
        F.sum(F.when(~F.col("gone"), F.col("weight")).otherwise(0.0)).alias("left"),
        F.count_if(~F.col("gone")).alias("available"),
    )
    w = F.col("weight")
    spread = (
        F.when(F.col("gone"), 0.0)
        .when(F.col("freed") <= 0, w)
        .when(F.col("left") <= 0, 1.0 / F.col("available"))
        .otherwise(w + F.col("freed") * w / F.col("left"))
    )
    return marked.join(sums, by).select(*by, "dim", spread.alias("weight"))


def learned_blend(weights: DataFrame, learned: DataFrame, by: Sequence[str] = tuple(K.GROUP), min_labels: int = 10) -> DataFrame:
    """f x learned + (1-f) x calibrated for agents with enough labels.

    ``learned``: session_id, dim, learned_weight, learned_factor, n_total, and the environment if it was learned
    for each one.
    """
    on = [c for c in ("session_id", "environment") if c in learned.columns and c in weights.columns] + ["dim"]
    usable = learned.where(F.col("n_total") >= min_labels).select(*on, "learned_weight", "learned_factor")
    factor = F.coalesce("learned_factor", F.lit(0.0))
    mixed = weights.join(usable, on, "left").withColumn(
        "__raw", factor * F.coalesce("learned_weight", F.lit(0.0)) + (1 - factor) * F.col("weight")
    )
    return _normalised(mixed.withColumnRenamed("weight", "before"), "__raw", by, F.col("before")).select(*by, "dim", "weight")


# ---- thresholds --------------------------------------------------------------------------------
def student_quantiles(batches: Iterator[pd.DataFrame], probs: dict[str, float]) -> Iterator[pd.DataFrame]:
    """Quantiles of Student's t per row's degrees of freedom, by bisection on the tail area.

    With theta = atan(t/sqrt(df)) the density becomes cos(theta)**(df-1), smooth on a finite range,
    so Simpson's rule gives the distribution to about twelve digits for every df.
    """
    import math

    import numpy as np

    x = np.linspace(0.0, 1.0, 2001)
    weights = np.ones(2001)
    weights[1:-1:2], weights[2:-1:2] = 4.0, 2.0

    def cdf_above_half(t: float, df: float) -> float:
        top = math.atan(t / math.sqrt(df))
        area = float((weights * np.cos(x * top) ** (df - 1)).sum()) * top / 6000.0
        norm = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)
        return 0.5 + norm * area

    for batch in batches:
        out = {"df": [], "level": [], "t": []}
        for df in batch["df"]:
            for level, prob in probs.items():
                lo, hi = 0.0, 4.0
                while cdf_above_half(hi, float(df)) < prob:
                    hi *= 2.0
                for _ in range(80):
                    mid = (lo + hi) / 2
                    lo, hi = (mid, hi) if cdf_above_half(mid, float(df)) < prob else (lo, mid)
                out["df"].append(int(df))
                out["level"].append(level)
                out["t"].append((lo + hi) / 2)
        yield pd.DataFrame(out)


EXPANDED_DF = 1000
"""From here on the expansion below differs from the integral by less than 1e-11."""


def expanded_quantile(df: Column, prob: float) -> Column:
    """Student's t by the series in 1/df around the normal quantile (Abramowitz and Stegun 26.7.5)."""
    z = NormalDist().inv_cdf(prob)
    terms = [
        z,
        (z**3 + z) / 4,
        (5 * z**5 + 16 * z**3 + 3 * z) / 96,
        (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160,
    ]
    total = F.lit(0.0)
    for term in reversed(terms):
        total = total / df + F.lit(term)
    return total


def t_quantiles(spark: SparkSession, needed: DataFrame) -> DataFrame:
    """(df, level, t) for the distinct degrees of freedom in ``needed``, each with its own value.

    Small ones (at most EXPANDED_DF rows) are integrated, the others are a column expression.
    """
    probs = dict(K.THRESHOLD_PROBS)
    wanted = needed.select(F.col("df").cast("long").alias("df")).distinct()
    small = wanted.where(F.col("df") < EXPANDED_DF).mapInPandas(
        lambda it: student_quantiles(it, probs), "df long, level string, t double"
    )
    rows = F.array(*[F.struct(F.lit(level).alias("level"), expanded_quantile(F.col("df"), p).alias("t")) for level, p in probs.items()])
    large = wanted.where(F.col("df") >= EXPANDED_DF).select("df", F.explode(rows).alias("r")).select("df", "r.level", "r.t")
    return small.unionByName(large)


def dim_thresholds(stats: DataFrame, quantiles: DataFrame, by: Sequence[str] = tuple(K.GROUP)) -> DataFrame:
    """mean + t x max(std, .01) per group, dimension and level; ``quantiles``: df, level, t."""
    df = F.greatest(F.lit(1), F.col("n") - 1).cast("long")
    return (
        stats.withColumn("df", df)
        .join(quantiles, "df")
        .select(*by, "dim", "level", (F.col("mean") + F.col("t") * F.greatest(F.col("std"), F.lit(0.01))).alias("threshold"))
    )


def volume_factor(n: Column) -> Column:
    return F.when(n < 500, 1.0).when(n < 2000, 0.9).when(n < 10000, 0.8).otherwise(0.7)


def composite_thresholds(thresholds: DataFrame, weights: DataFrame, sizes: DataFrame, sensitivity: str = "standard") -> DataFrame:
    """Weighted thresholds per pair, scaled by the current side's volume and the sensitivity.

    ``sizes``: pair, b_n, c_n. Baselines under 30 runs use the preset cuts.
    """
    weighted = (
        thresholds.join(weights.select(*K.GROUP, "dim", "weight"), [*K.GROUP, "dim"])
        .groupBy(*K.GROUP)
        .pivot("level", ["MONITOR", "REVIEW", "BLOCK"])
        .agg(F.sum(F.col("threshold") * F.col("weight")))
        .withColumnRenamed("deployment_version", "baseline_version")
    )
    factor = volume_factor(F.col("c_n")) * F.lit(K.SENSITIVITY[sensitivity])
    preset = F.col("b_n") < 30
    cuts = [
        F.when(preset, F.lit(cut)).otherwise(F.col(level) * factor).alias(level.lower())
        for level, cut in K.COMPOSITE_CUTS.items()
    ]
    return sizes.join(weighted, [*K.AGENT, "baseline_version"], "left").select(
        *K.PAIR, F.when(preset, "preset").otherwise("statistical").alias("method"), *cuts
    )


# ---- feedback ----------------------------------------------------------------------------------
def dismiss_counts(feedback: DataFrame) -> DataFrame:
    """Dismissals per agent and dimension."""
    return (
        feedback.where(F.col("action") == "dismiss")
        .select("session_id", F.explode("dismissed_dimensions").alias("dim"))
        .groupBy("session_id", "dim")
        .agg(F.count("*").alias("dismissals"))
    )


def feedback_decay(weights: DataFrame, feedback: DataFrame) -> DataFrame:
    """weight x max(.7^k, .1), not normalised again. ``weights`` carries session_id, dim, weight."""
    decay = F.greatest(F.pow(F.lit(0.7), F.coalesce("dismissals", F.lit(0))), F.lit(0.1))
    return weights.join(dismiss_counts(feedback), ["session_id", "dim"], "left").select(
        *weights.columns, F.coalesce("dismissals", F.lit(0)).alias("dismissals"), (F.col("weight") * decay).alias("adjusted")
    )


def feedback_impact(decayed: DataFrame) -> DataFrame:
    """What feedback changed: base, adjusted, dismissals and percent taken off."""
    cut = F.when(F.col("weight") > 0, (F.col("weight") - F.col("adjusted")) / F.col("weight") * 100).otherwise(0.0)
    return decayed.where(F.abs(F.col("weight") - F.col("adjusted")) > 0.001).withColumn("reduction_pct", cut)


# ---- labels ------------------------------------------------------------------------------------
def blending_factor(n: Column) -> Column:
    return F.when(n < 10, 0.0).otherwise(F.least(F.lit(0.70), F.lit(0.30) + (n - 10) / 90 * 0.40))


def outcome_pairs(runs: DataFrame, outcomes: DataFrame, min_runs: int = 5) -> DataFrame:
    """Per agent the oldest good version against every other labelled version with enough runs.

    ``outcomes``: session_id, deployment_version, outcome ('good' / 'bad').
    """
    firsts = runs.groupBy(*K.GROUP).agg(F.count("*").alias("n"), F.min("started_at").alias("first_at"))
    labelled = firsts.where(F.col("n") >= min_runs).join(outcomes, ["session_id", "deployment_version"])
    baseline = (
        labelled.where(F.col("outcome") == "good")
        .groupBy(*K.AGENT)
        .agg(F.min(F.struct("first_at", "deployment_version"))["deployment_version"].alias("baseline_version"))
    )
    return (
        labelled.join(baseline, K.AGENT)
        .where(F.col("deployment_version") != F.col("baseline_version"))
        .select(*K.AGENT, "baseline_version", F.col("deployment_version").alias("current_version"), "outcome")
    )


def learn_weights(scored: DataFrame, general: DataFrame, by: Sequence[str] = tuple(K.AGENT), min_rows: int = 10) -> DataFrame:
    """Weights from labelled comparisons: correlation of bad = 1 with each dimension's score.

    ``scored``: pair, outcome and one column per dimension. ``general``: dim, preset.
    """
    by = list(by)
    bad = (F.col("outcome") == "bad").cast("double")
    wide = scored.groupBy(*by).agg(
        F.count("*").alias("n_total"),
        F.count_if(F.col("outcome") == "bad").alias("n_bad"),
        *[
            F.greatest(F.lit(0.0), F.coalesce(_corr(bad, F.col(d)), F.lit(0.0))).alias(d)
            for d in K.DIMS
        ],
    )
    usable = wide.where((F.col("n_total") >= min_rows) & (F.col("n_bad") > 0))
    rows = F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).alias("correlation")) for d in K.DIMS])
    long = usable.select(*by, "n_total", "n_bad", F.explode(rows).alias("r")).select(*by, "n_total", "n_bad", "r.*")
    sums = long.groupBy(*by).agg(F.sum("correlation").alias("all_corr")).where(F.col("all_corr") > 0)
    factor = blending_factor(F.col("n_total"))
    blended = (
        long.join(sums, by)
        .join(general, "dim")
        .withColumn("learned_factor", factor)
        .withColumn("__raw", F.col("learned_factor") * F.col("correlation") / F.col("all_corr") + (1 - F.col("learned_factor")) * F.col("preset"))
    )
    return _normalised(blended, "__raw", by, F.col("preset"), "learned_weight").select(
        *by, "dim", "n_total", "n_bad", "correlation", "learned_factor", "learned_weight"
    )


def top_predictors(learned: DataFrame, by: Sequence[str] = tuple(K.AGENT), k: int = 3) -> DataFrame:
    """The k dimensions that predict bad outcomes best."""
    order = F.array_position(F.array(*[F.lit(d) for d in K.DIMS]), F.col("dim"))
    return ranks.newest(
        learned.where(F.col("correlation") > 0), by, [F.col("correlation").desc(), order], k, F.col("dim")
    ).select(*by, "dim", "correlation")


def stale_keys(cache: DataFrame, counts: DataFrame, keys: Sequence[str], growth: float = 1.20) -> DataFrame:
    """Keys to calibrate again: not cached yet, or grown by the factor since."""
    joined = counts.join(cache.withColumnRenamed("n", "cached_n"), list(keys), "left")
    return joined.where(F.col("cached_n").isNull() | (F.col("n") >= F.col("cached_n") * growth)).select(*keys, "n", "cached_n")
