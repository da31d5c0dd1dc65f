"""The calibrated comparison of one generated pair: weights, tier gate, version sources and anomalies."""

from generated import pair
from pyspark.sql import functions as F

from tidemark.functions import constants as K
from tidemark.operators import calibrate, calibrated, compare


def test_gate_and_overrides(spark):
    runs = pair(spark, latency_ms=F.lit(4000).cast("long"))
    _, wide, _ = compare.prepared(runs)
    wide = spark.createDataFrame(wide.collect(), wide.schema)
    stats = calibrate.dim_stats(runs)
    stats = spark.createDataFrame(stats.collect(), stats.schema)
    group = wide.select("session_id", F.col("baseline_version").alias("deployment_version"), "environment")
    dims = F.explode(F.array(*[F.lit(d) for d in K.DIMS])).alias("dim")
    weights = group.select("*", dims).withColumn("weight", F.when(F.col("dim") == "latency", 1.0).otherwise(0.0))
    quantiles = calibrate.t_quantiles(spark, stats.select((F.col("n") - 1).cast("long").alias("df")))
    anomaly = wide.select(*K.PAIR, F.lit("CRITICAL").alias("level"))
    bucketed = group.withColumn("epoch_share", F.lit(0.9)).withColumn("unknown_share", F.lit(0.0))

    plain = calibrated.judged(wide, stats, weights, quantiles).first()
    term = compare.drift_dim(wide).where("dim = 'latency'").first().term
    assert plain.tier == "TIER3" and abs(plain.drift_score - min(1.0, term)) < 1e-12 and plain.verdict is not None

    unweighted = weights.withColumn("weight", F.lit(0.0))
    calm = calibrated.judged(wide, stats, unweighted, quantiles, anomaly=anomaly).first()
    assert calm.drift_score == 0.0 and calm.severity == "moderate" and calm.severity_verdict == "MONITOR"

    lowered = calibrated.judged(wide, stats, weights, quantiles, mix=bucketed, anomaly=anomaly).first()
    assert lowered.tier == "TIER2" and lowered.drift_score == lowered.latency == 0.0
    assert lowered.severity == "none" and lowered.verdict is None
