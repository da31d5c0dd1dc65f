"""Bucketed ranks against plain windows and Python, on groups of very different size."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import budget, epochs, ranks


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows; times repeat."""
    return spark.range(3000).select(
        F.when(F.col("id") % 10 < 8, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 3)).alias("g"),
        F.col("id").cast("string").alias("id"),
        F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, cast(pmod(xxhash64(id), 5000) as int), 0)").alias("ts"),
        F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(4000)).alias("v"),
    ).persist()


def test_numbered_equals_row_number(skewed):
    ours = ranks.numbered(skewed, ["g"], "ts", ["id"], name="rn").select("g", "id", "rn", "rn_n")
    w = Window.partitionBy("g")
    plain = skewed.select("g", "id", F.row_number().over(w.orderBy("ts", "id")).cast("long").alias("rn"), F.count("*").over(w).alias("rn_n"))
    assert ours.exceptAll(plain).count() == 0 and ours.count() == plain.count()


@pytest.mark.parametrize("n", [1, 7, 2000])
def test_newest_in_time(skewed, n):
    ours = ranks.newest_in_time(skewed, ["g"], "ts", ["id"], n)
    w = Window.partitionBy("g").orderBy(F.col("ts").desc(), F.col("id").desc())
    plain = skewed.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).drop("r")
    assert ours.columns == plain.columns
    assert ours.exceptAll(plain).count() == 0 and ours.count() == plain.count()


def test_percentiles(skewed):
    rows = skewed.groupBy("g").agg(F.collect_list("v").alias("v")).collect()
    floor = {r.g: r for r in ranks.floor_percentile(skewed, ["g"], "v", {"p95": ranks.percent_rank(95)}).collect()}
    counts = skewed.groupBy("g", "v").agg(F.count("*").alias("k"))
    linear = {r.g: r.p for r in ranks.interpolated_of_counts(counts, ["g"], "v", 0.9, "p").collect()}
    for row in rows:
        values = sorted(row.v)
        assert floor[row.g].p95 == values[min(int(len(values) * 95 / 100), len(values) - 1)]
        assert abs(linear[row.g] - np.percentile(values, 90)) < 1e-9


def test_average_rank(skewed):
    got = {(r.g, r.v): r.avg_rank for r in ranks.average_rank(skewed, ["g"], "v", 64).collect()}
    for row in skewed.groupBy("g").agg(F.collect_list("v").alias("v")).collect():
        values = np.sort(np.array(row.v))
        for v in set(row.v):
            places = np.flatnonzero(values == v) + 1
            assert got[(row.g, v)] == places.mean()


def test_rolling_mean_across_blocks(skewed):
    runs = skewed.select(F.col("g").alias("session_id"), F.lit("v1").alias("deployment_version"), "id", F.col("ts").alias("started_at"), F.col("v").alias("latency_ms"))
    ours = budget.rolling_history(runs, block=50).select("id", F.round("rolling_mean", 9).alias("m"))
    w = Window.partitionBy("session_id").orderBy("started_at", "id").rowsBetween(-9, 0)
    plain = runs.select("id", F.round(F.avg("latency_ms").over(w), 9).alias("m"))
    assert ours.exceptAll(plain).count() == 0 and ours.count() == plain.count()


def test_epoch_numbers_across_blocks(spark):
    positions = spark.range(500).select(F.lit("a").alias("session_id"), F.col("id").alias("r"), F.lit(500).alias("n"), F.col("id").cast("string").alias("id"))
    breaks = spark.createDataFrame([("a", 40), ("a", 41), ("a", 333)], "session_id string, position long")
    got = epochs.with_epoch(positions, breaks, block=17).orderBy("r").select("epoch").collect()
    assert [r.epoch for r in got] == [sum(b <= i for b in (40, 41, 333)) for i in range(500)]


def test_merge_breaks_is_greedy(spark):
    found = [5, 9, 14, 16, 40, 44, 49, 51, 70]
    kept = []
    for b in found:
        if not kept or b - kept[-1] >= 10:
            kept.append(b)
    breaks = spark.createDataFrame([("a", b) for b in found], "session_id string, position long")
    assert sorted(r.position for r in epochs.merge_breaks(breaks, 10).collect()) == kept


@pytest.mark.parametrize("gap", [1, 2, 7, 10])
def test_merged_breaks_equal_the_walk_on_dense_and_random_breaks(spark, gap):
    rng = random.Random(gap)
    found = {"dense": list(range(400)), "sparse": rng.sample(range(3000), 60), "mixed": [*rng.sample(range(900), 300), 5000, 5003, 5011], "one": [3]}
    want = []
    for agent, places in found.items():
        last = None
        for p in sorted(places):
            if last is None or p - last >= gap:
                want.append((agent, p))
                last = p
    rows = [(a, p) for a, places in found.items() for p in [*places, places[0]]] + [("one", None)]
    breaks = spark.createDataFrame(rows, "session_id string, position long").repartition(4)
    got = epochs.merge_breaks(breaks, gap).collect()
    assert sorted((r.session_id, r.position) for r in got) == sorted(want)
