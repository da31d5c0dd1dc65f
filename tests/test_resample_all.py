"""Replicates of all runs against draws and sums made row by row in Python."""

import hashlib
import math
from collections import Counter
from itertools import pairwise

import pytest
from generated import pair, uniform
from pyspark.sql import functions as F

from tidemark.functions import constants as K
from tidemark.operators import pairs as P
from tidemark.operators import resample

ROUNDS = 10


@pytest.fixture(scope="module")
def runs(spark):
    other = F.when(uniform("tools") < 0.5, F.array(F.lit("tool_a"), F.lit("tool_b"))).otherwise(F.array(F.lit("tool_a"), F.lit("tool_c"), F.lit("tool_b")))
    made = pair(spark, n=60, tools=other, error_count=(uniform("error") < 0.2).cast("long"))
    return made.withColumn("latency_ms", F.when(F.xxhash64("id") % 10 != 0, F.col("latency_ms")))


def draws(run, replicate):
    text = ":".join(["42", run.session_id, run.deployment_version, run.environment, run.id, str(replicate // 4)])
    start = 8 * (replicate % 4)
    u = int(hashlib.md5(text.encode()).hexdigest()[start : start + 8], 16)
    return sum(u >= cut for cut in K.POISSON_CUTS)


def divergence(a, b):
    na, nb = sum(a.values()), sum(b.values())
    nats = 0.0
    for key in a.keys() | b.keys():
        p, q = a[key] / na, b[key] / nb
        nats += 0.5 * sum(x * math.log(x / ((p + q) / 2)) for x in (p, q) if x)
    return nats


def p95(values):
    values = sorted(v for v in values if v is not None)
    return values[min(len(values) * 95 // 100, len(values) - 1)]


def expected(rows, replicate):
    sides = {}
    for run in rows:
        sides.setdefault(run.deployment_version, []).extend([run] * draws(run, replicate))
    old, new = (sides[v] for v in sorted(sides))
    sequences = [Counter(tuple(r.tools) for r in side) for side in (old, new)]
    moves = [Counter(m for r in side for m in pairwise(r.tools)) for side in (old, new)]
    latency = [p95([r.latency_ms for r in side]) for side in (old, new)]
    errors = [sum(r.error_count for r in side) / len(side) for side in (old, new)]
    return {
        "decision_drift": divergence(*sequences) / math.log(2),
        "tool_sequence_transitions": math.sqrt(divergence(*moves)),
        "latency": min(1.0, abs(latency[1] - latency[0]) / max(latency[0], 1.0)),
        "error_rate": min(1.0, 2 * abs(errors[1] - errors[0])),
    }


def replicates(runs, pairs, b=ROUNDS):
    return {r.replicate: r for r in resample.bootstrap(runs, pairs, b=b, cap=None).collect()}


def test_rounds_equal_brute_force_with_null_latencies(runs):
    got, rows = replicates(runs, P.consecutive_pairs(runs)), runs.collect()
    assert any(r.latency_ms is None for r in rows) and sorted(got) == list(range(ROUNDS))
    for replicate, row in got.items():
        for dim, value in expected(rows, replicate).items():
            assert row[dim] == pytest.approx(value, abs=1e-9), (replicate, dim)


def test_rounds_do_not_hang_on_partitions(runs):
    pairs = P.consecutive_pairs(runs)
    one, many = (replicates(runs.repartition(n), pairs) for n in (1, 9))
    assert one.keys() == many.keys()
    assert all(one[k].composite == pytest.approx(many[k].composite, abs=1e-9) for k in one)


def test_fewer_rounds_are_the_first_of_more(runs):
    pairs = P.consecutive_pairs(runs)
    few, more = replicates(runs, pairs, 5), replicates(runs, pairs)
    assert sorted(few) == list(range(5))
    assert all(few[k].composite == pytest.approx(more[k].composite, abs=1e-9) for k in few)


def test_rounds_without_a_run_of_a_side_do_not_count(runs):
    versions = sorted(r.deployment_version for r in runs.select("deployment_version").distinct().collect())
    lone = runs.where(F.col("deployment_version") == versions[1]).orderBy("id").limit(1).collect()[0]
    few = runs.where((F.col("deployment_version") == versions[0]) | (F.col("id") == lone.id))
    drawn = [i for i in range(20) if draws(lone, i)]
    assert len(drawn) < 20
    assert sorted(replicates(few, P.consecutive_pairs(few), 20)) == drawn


def test_no_runs_no_rounds(runs):
    none = runs.where("false")
    assert replicates(none, P.consecutive_pairs(none)) == {}
