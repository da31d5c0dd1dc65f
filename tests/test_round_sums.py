"""Vectors over the rounds: digests, sums that flush, percentiles outside their windows, odd numbers and ids."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F
from test_resample_all import draws, expected, runs  # noqa: F401

from tidemark.functions import constants as K
from tidemark.functions.draws import poisson_rounds
from tidemark.operators import pairs as P
from tidemark.operators import resample

ROUNDS = 30
PAIR = ("s", "e", "v1", "v2")


def drawn(prefix, replicate, per_digest):
    digest = hashlib.md5(prefix + b":%d" % (replicate // per_digest)).hexdigest()
    u = int(digest[8 * (replicate % per_digest) :][:8], 16)
    return sum(u >= cut for cut in K.POISSON_CUTS)


@pytest.mark.parametrize("per_digest", [1, 4])
def test_draws_are_those_of_md5_whatever_the_length(per_digest):
    prefixes = [("é%d" % i * 80).encode()[: i % 140] for i in range(300)]
    got = poisson_rounds(prefixes, 111, per_digest)
    assert got.shape == (300, 111)
    assert all(got[i, r] == drawn(prefixes[i], r, per_digest) for i in range(300) for r in range(111))


def replicates(runs, b=ROUNDS):  # noqa: F811
    return {r.replicate: r for r in resample.bootstrap(runs, P.consecutive_pairs(runs), b=b, cap=None).collect()}


@pytest.mark.parametrize(("name", "value"), [("REACH", 0.0), ("HELD", 1), ("SLICE", 7)])
def test_rounds_hang_on_no_window_nor_flush(runs, monkeypatch, name, value):  # noqa: F811
    monkeypatch.setattr(resample, name, value)
    rows = runs.collect()
    for replicate, row in replicates(runs, 10).items():
        for dim, score in expected(rows, replicate).items():
            assert row[dim] == pytest.approx(score, abs=1e-9), (replicate, dim)


def test_percentiles_of_runs_that_share_an_id(runs):  # noqa: F811
    """Rounds of few distinct ids lie far from the group's own percentile, outside the first window."""
    many = runs.select("*", F.explode(F.sequence(F.lit(1), F.lit(60))).alias("copy"))
    same = many.withColumn("latency_ms", F.col("latency_ms") * 100 + F.col("copy")).drop("copy").cache()
    rows = same.collect()
    got = replicates(same)
    assert sorted(got) == list(range(ROUNDS))
    for replicate in range(0, ROUNDS, 10):
        for dim, score in expected(rows, replicate).items():
            assert got[replicate][dim] == pytest.approx(score, abs=1e-9), (replicate, dim)


def test_one_vector_a_key_however_many_rounds(runs):  # noqa: F811
    rows = runs.select(*K.GROUP, resample._prefix(K.SEED), F.col("output_length").cast("double").alias("x"))
    few, more = (resample._round_sums(rows, b, 1, ["x"]).collect() for b in (3, 200))
    place = lambda r: (*[r[c] for c in K.GROUP], r.kind, r.key)
    sums = {place(r): r.sums for r in more}
    assert len(few) == len(more) == 2 * 3 and all(len(s) == 200 for s in sums.values())
    assert all(r.sums == pytest.approx(sums[place(r)][:3]) for r in few)


def test_an_infinite_value_counts_only_where_it_is_drawn(runs):  # noqa: F811
    rows = runs.select("*", F.lit(math.inf).alias("x")).limit(1).collect()
    one = runs.where(F.col("id") == rows[0].id).select(*K.GROUP, resample._prefix(K.SEED), F.lit(math.inf).alias("x"))
    got = {r.kind: r.sums for r in resample._round_sums(one, 40, 4, ["x"]).collect()}
    assert got["x"] == [math.inf if draws(rows[0], r) else 0.0 for r in range(40)]


def test_mean_difference_equals_brute_force_with_nulls(spark):
    rows = [(f"r{i}", "s", "e", "v1" if i % 3 else "v2", None if i % 7 == 0 else i * i % 101) for i in range(90)]
    rows += [("lone", None, "e", "v1", 5), (None, "s", "e", "v1", 7)]
    runs = spark.createDataFrame(rows, "id string, session_id string, environment string, deployment_version string, latency_ms long")  # noqa: F811
    pairs = spark.createDataFrame([PAIR], "session_id string, environment string, baseline_version string, current_version string")
    row = resample.bootstrap_mean_diff(runs, pairs, b=120).first()
    diffs = []
    for replicate in range(120):
        means = []
        for version in ("v2", "v1"):
            weighed = [(drawn(":".join(filter(None, ["42", s, v, e, i])).encode(), replicate, 1), x) for i, s, e, v, x in rows if v == version and s and x is not None]
            total = sum(n for n, _ in weighed)
            means.append(sum(n * x for n, x in weighed) / total)
        diffs.append(means[0] - means[1])
    diffs.sort()
    assert row.ci_lower == pytest.approx(diffs[3]) and row.ci_upper == pytest.approx(diffs[117])
