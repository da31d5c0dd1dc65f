"""Bounds on generated pairs: nothing drifts, or one thing does."""

import pytest
from generated import normal, pair, uniform
from pyspark.sql import functions as F

from tidemark.operators import anomaly, compare, decide


def compared(runs):
    pairs, wide, dist = compare.prepared(runs)
    return pairs, wide, compare.drift(wide).first()


def test_no_drift_ships(spark):
    pairs, wide, row = compared(pair(spark))
    assert row.drift_score < 0.05
    assert row.tier == "TIER3"
    assert decide.verdict(compare.drift(wide)).first().verdict == "SHIP"


def test_decision_drift(spark):
    tools = F.when(uniform("shift") < 0.3, F.array(F.lit("tool_c"), F.lit("tool_d"))).otherwise(F.array(F.lit("tool_a"), F.lit("tool_b")))
    _, wide, row = compared(pair(spark, tools=tools))
    assert row.drift_score > 0.05 and row.decision_drift > 0.10 and row.tool_sequence > 0.05


def test_latency_drift(spark):
    slower = F.round(1000 + 200 * normal("latency") + F.when(F.pmod(F.col("k"), F.lit(2)) == 0, 500).otherwise(0)).cast("long")
    _, wide, row = compared(pair(spark, latency_ms=slower))
    assert row.latency > 0.05
    assert wide.first().c_p95_latency_ms > wide.first().b_p95_latency_ms


def test_error_rate_drift(spark):
    _, wide, row = compared(pair(spark, error_count=(uniform("error") < 0.3).cast("long")))
    assert wide.first().c_error_rate >= wide.first().b_error_rate
    assert row.error_rate > 0.2


def test_outcome_drift(spark):
    moved = F.when(uniform("cluster") < 0.6, "cluster_0").when(uniform("cluster") < 0.8, "cluster_escalated").otherwise("cluster_error")
    _, _, row = compared(pair(spark, semantic_cluster=moved))
    assert row.semantic_drift > 0.01


def test_tool_order_drift(spark):
    _, _, row = compared(pair(spark, tools=F.array(F.lit("tool_b"), F.lit("tool_a"))))
    assert row.tool_sequence_transitions > 0.3


def test_bimodal_latency_moves_the_latency_term(spark):
    two = F.when(F.pmod(F.col("k"), F.lit(2)) == 0, F.round(2000 + 100 * normal("two"))).otherwise(F.round(1000 + 200 * normal("latency"))).cast("long")
    _, wide, _ = compared(pair(spark, latency_ms=two))
    term = compare.drift_dim(wide).where("dim = 'latency'").first().term
    assert term > 0.2


def test_the_drifting_cluster_ranks_first(spark):
    def named(head):
        return F.array(F.element_at(F.array(*[F.lit(x) for x in ("alpha", "beta", "gamma")]), (F.pmod(F.col("k"), F.lit(3)) + 1).cast("int")), F.lit(head))

    slow = F.when(F.pmod(F.col("k"), F.lit(3)) == 1, 3000).otherwise(1000).cast("long")
    runs = pair(spark, n=300, latency_ms=slow, tools=named("x"))
    runs = runs.withColumn("tools", F.when(F.col("deployment_version") == "v1.0", F.array(F.element_at(F.array(*[F.lit(x) for x in ("alpha", "beta", "gamma")]), (F.pmod(F.split("id", "-")[1].cast("int"), F.lit(3)) + 1)), F.lit("x"))).otherwise(F.col("tools")))
    pairs, _, _ = compare.prepared(runs)
    top = compare.cluster_drift(runs, pairs).orderBy(F.col("cluster_score").desc()).first()
    assert top.cluster.startswith("beta:")
    assert top.contributors.startswith("latency_p95")


def test_anomaly_is_higher_for_a_shifted_side(spark):
    calm = pair(spark, n=150)
    odd = pair(
        spark,
        n=150,
        latency_ms=F.when(F.pmod(F.col("k"), F.lit(10)) == 0, F.lit(5000)).otherwise(F.lit(1000)).cast("long"),
        retry_count=F.when(F.pmod(F.col("k"), F.lit(10)) == 0, F.lit(5)).otherwise(F.lit(0)).cast("long"),
    )
    pairs, _, _ = compare.prepared(calm)

    def spread(runs):
        return anomaly.score_runs(runs, pairs, anomaly.forest(runs, trees=30)).agg(F.max("anomaly_score")).first()[0]

    assert spread(odd) > spread(calm)


@pytest.mark.parametrize("name", ["cost", "quality"])
def test_user_dimensions_and_checks(spark, name):
    _, wide, _ = compare.prepared(pair(spark))
    dims = compare.drift_dim(wide, {name: lambda b, c: F.abs(c("n") - b("n")) / 1000.0})
    assert dims.where(F.col("dim") == name).first().score == 0.0
    checked = decide.verdict(compare.drift(wide), checks={"never": F.lit(False)}).first()
    assert checked.verdict == "REVIEW" and checked.failed_checks == ["never"]
