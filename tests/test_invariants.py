"""Results must not depend on how the input is partitioned."""

import pytest
from generated import pair, uniform
from pyspark.sql import functions as F

from tidemark.operators import calibrate, compare, resample, usecase
from tidemark.operators import pairs as P


@pytest.fixture(scope="module")
def runs(spark):
    return pair(spark, n=120, error_count=(uniform("error") < 0.2).cast("long"))


def results(runs, partitions):
    runs = runs.repartition(partitions)
    pairs, wide, _ = compare.prepared(runs)
    score = compare.drift(wide).first().drift_score
    replicate = resample.bootstrap(runs, pairs, b=20, cap=50).orderBy("replicate").select("composite").collect()
    return [round(score, 9)] + [round(r.composite, 9) for r in replicate]


def test_partition_independence(runs):
    assert results(runs, 1) == results(runs, 8)


def test_calibrated_weights_sum_to_one(spark, runs):
    general = usecase.presets(spark).where("use_case = 'GENERAL'").drop("use_case")
    stats = calibrate.dim_stats(runs)
    weights = calibrate.reliability_weights(stats, general)
    adjusted = calibrate.correlation_factors(calibrate.correlations(runs), weights)
    for frame in (weights, adjusted):
        for row in frame.groupBy("deployment_version").agg(F.sum("weight").alias("w")).collect():
            assert abs(row.w - 1) < 1e-9


def test_interval_holds_the_score(runs):
    pairs = P.consecutive_pairs(runs)
    _, wide, _ = compare.prepared(runs, pairs)
    scored = compare.drift(wide)
    row = resample.drift_ci(resample.bootstrap(runs, pairs, b=100), scored).first()
    assert row.ci_lower <= row.drift_score <= row.ci_upper and not row.small_sample


def test_composite_thresholds_rise(spark, runs):
    stats = calibrate.dim_stats(runs)
    quantiles = calibrate.t_quantiles(spark, stats.select((F.col("n") - 1).alias("df")))
    rows = calibrate.dim_thresholds(stats, quantiles).groupBy("dim", "deployment_version").pivot("level", ["MONITOR", "REVIEW", "BLOCK"]).agg(F.first("threshold")).collect()
    assert rows and all(r.MONITOR < r.REVIEW < r.BLOCK for r in rows)
