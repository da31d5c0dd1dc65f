"""Multivariate anomaly signal: an isolation forest per baseline, scored on the current side."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.functions import constants as K
from tidemark.operators import pairs as P
from tidemark.operators import ranks

CHUNK = 50_000


def features() -> list[str]:
    return [f"x_{name}" for name in C.behaviour_vector()]


def vectors(runs: DataFrame) -> DataFrame:
    """Behaviour vector per run, one column per feature."""
    named = [v.cast("double").alias(f"x_{name}") for name, v in C.behaviour_vector().items()]
    return runs.select(*K.GROUP, "id", *named)


def _scaled() -> list:
    """Features in baseline deviations, for rows joined with ``scaling``."""
    return [((F.col(c) - F.col("mean")[i]) / F.col("std")[i]).alias(c) for i, c in enumerate(features())]


def _share(*parts) -> Column:
    """A reproducible number in 0..1 from a hash of the parts."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 30)) / F.lit(float(1 << 30))


def scaling(runs: DataFrame) -> DataFrame:
    """Mean and population deviation of every feature per group (0 deviation counts as 1)."""
    vector = C.behaviour_vector()
    std = lambda v: F.when(F.stddev_pop(v) > 0, F.stddev_pop(v)).otherwise(1.0)
    return runs.groupBy(*K.GROUP).agg(
        F.count("*").alias("group_n"),
        F.array(*[F.avg(v.cast("double")) for v in vector.values()]).alias("mean"),
        F.array(*[std(v.cast("double")) for v in vector.values()]).alias("std"),
    )


def _grow(sample: np.ndarray, rng: np.random.Generator, depth_limit: int) -> dict[str, np.ndarray]:
    """One isolation tree as a node table, grown level by level on all nodes of a level at once.

    Nodes are numbered in the order they are made, so a node's number is its place in the arrays.
    """
    level = np.zeros(len(sample), dtype=np.int64)
    columns: dict[str, list[np.ndarray]] = {k: [] for k in ("feature", "cut", "left", "right", "length")}
    size, depth = 1, 0
    points = sample
    while len(points):
        order = np.argsort(level, kind="stable")
        points, level = points[order], level[order]
        nodes, starts, counts = np.unique(level, return_index=True, return_counts=True)
        low, high = np.minimum.reduceat(points, starts), np.maximum.reduceat(points, starts)
        usable = high > low
        inner = usable.any(axis=1) & (depth < depth_limit)
        # A random usable feature per node: the largest of random marks on the usable ones.
        feature = np.where(usable, rng.random(usable.shape), -1.0).argmax(axis=1)
        at = np.arange(len(nodes))
        cut = low[at, feature] + rng.random(len(nodes)) * (high[at, feature] - low[at, feature])
        left = size + 2 * (np.cumsum(inner) - 1)
        leaf_length = depth + average_path(counts)
        columns["feature"].append(np.where(inner, feature, -1))
        columns["cut"].append(np.where(inner, cut, 0.0))
        columns["left"].append(np.where(inner, left, -1))
        columns["right"].append(np.where(inner, left + 1, -1))
        columns["length"].append(np.where(inner, 0.0, leaf_length))
        size += 2 * int(inner.sum())
        depth += 1
        which = np.repeat(at, counts)
        goes_on = inner[which]
        points, which = points[goes_on], which[goes_on]
        level = left[which] + (points[np.arange(len(points)), feature[which]] > cut[which])
    return {k: np.concatenate(v) for k, v in columns.items()}


def average_path(n):
    """Expected depth of an unsuccessful search among n points (a number or an array of numbers)."""
    n = np.asarray(n, dtype=float)
    big = np.maximum(n, 3.0)
    long = 2.0 * (np.log(big - 1.0) + np.euler_gamma) - 2.0 * (big - 1.0) / big
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, long))


TREES_PER_TASK = 10
NODE = ["feature", "cut", "left", "right", "length"]


def forest(runs: DataFrame, trees: int = 100, sample: int = 256, seed: int = K.SEED) -> DataFrame:
    """Trees per group, one row each: (group, tree, fitted_on) and a node table as arrays.

    Sampling is a filter on hashes and needs no sort: a huge group first keeps a random pool of about
    ``trees x sample`` rows, every tree keeps about twice its sample of the pool, and the tree's task
    takes the ``sample`` rows with the smallest hashes. A task sees one block of trees of one group.
    """
    pool_size = float(trees * sample)
    pooled = (
        vectors(runs)
        .join(scaling(runs).where(F.col("group_n") >= 30), K.GROUP)
        .where(_share(F.lit(seed), F.col("id")) * F.col("group_n") < pool_size)
        .select(*K.GROUP, "id", "group_n", *_scaled())
    )
    mark = _share(F.lit(seed + 1), F.col("tree"), F.col("id"))
    chosen = (
        pooled.select("*", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
        .withColumn("mark", mark)
        .where(F.col("mark") * F.least(F.col("group_n"), F.lit(pool_size)) < 2.0 * sample)
        .withColumn("block", F.floor(F.col("tree") / TREES_PER_TASK).cast("int"))
        .drop("group_n")
    )
    keys = [*K.GROUP, "block"]
    columns = features()

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        grown = []
        for tree, rows in pdf.groupby("tree", sort=True):
            points = rows.sort_values(["mark", "id"])[columns].to_numpy()[:sample]
            depth = int(np.ceil(np.log2(max(len(points), 2))))
            nodes = _grow(points, np.random.default_rng([seed, int(tree), len(points)]), depth)
            grown.append({"tree": int(tree), "fitted_on": len(points), **nodes})
        out = pd.DataFrame(grown)
        for k in K.GROUP:
            out[k] = pdf[k].iloc[0]
        return out[[*K.GROUP, "tree", "fitted_on", *NODE]]

    schema = (
        ", ".join(f"{g} string" for g in K.GROUP)
        + ", tree int, fitted_on int, feature array<int>, cut array<double>, left array<int>, right array<int>, length array<double>"
    )
    return ranks.spread(chosen, *keys).groupBy(*keys).applyInPandas(fit, schema)


def _path_lengths(points: np.ndarray, feature, cut, left, right, length) -> np.ndarray:
    at = np.zeros(len(points), dtype=np.int64)
    row = np.arange(len(points))
    while True:
        f = feature[at]
        inner = f >= 0
        if not inner.any():
            return length[at]
        goes_left = points[row, np.where(inner, f, 0)] <= cut[at]
        at = np.where(inner, np.where(goes_left, left[at], right[at]), at)


def score_runs(runs: DataFrame, pairs: DataFrame, trees: DataFrame) -> DataFrame:
    """Anomaly score of every run of the current side against the baseline's forest.

    The current side is cut into chunks of about 50,000 runs by a hash of the id; a task holds one
    chunk and one forest (a few megabytes), never a whole side.
    """
    current = pairs.withColumnRenamed("current_version", "deployment_version")
    scale = scaling(runs)
    sizes = scale.select(*K.GROUP, F.col("group_n").alias("n"))
    plan = (
        current.join(sizes, K.GROUP)
        .where(F.col("n") >= 5)
        .withColumn("chunks", F.greatest(F.lit(1), F.ceil(F.col("n") / CHUNK)).cast("int"))
        .select(*K.GROUP, "baseline_version", "chunks")
    )
    usable = scale.where(F.col("group_n") >= 30).withColumnRenamed("deployment_version", "baseline_version").drop("group_n")
    rows = (
        vectors(runs)
        .join(plan.join(usable, [*K.AGENT, "baseline_version"]), K.GROUP)
        .select(
            *K.AGENT,
            "baseline_version",
            F.col("deployment_version").alias("current_version"),
            F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int").alias("chunk"),
            "id",
            *_scaled(),
        )
    )
    copies = (
        trees.withColumnRenamed("deployment_version", "baseline_version")
        .join(plan.withColumnRenamed("deployment_version", "current_version"), [*K.AGENT, "baseline_version"])
        .select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
        .drop("chunks")
    )
    keys, columns = [*K.PAIR, "chunk"], features()

    def score(points: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        if points.empty or nodes.empty:
            return pd.DataFrame(columns=[*K.PAIR, "id", "anomaly_score"])
        x = points[columns].to_numpy()
        total = np.zeros(len(x))
        for arrays in zip(*[nodes[c] for c in NODE], strict=True):
            total += _path_lengths(x, *[np.asarray(a) for a in arrays])
        norm = float(average_path(nodes["fitted_on"].max()))
        out = points[[*K.PAIR, "id"]].copy()
        out["anomaly_score"] = np.round(np.power(2.0, -(total / len(nodes)) / max(norm, 1e-12)), 6)
        return out

    schema = ", ".join(f"{c} string" for c in K.PAIR) + ", id string, anomaly_score double"
    rows, copies = ranks.spread(rows, *keys), ranks.spread(copies, *keys)
    return rows.groupBy(*keys).cogroup(copies.groupBy(*keys)).applyInPandas(score, schema)


def isolation_forest(runs: DataFrame, pairs: DataFrame, trees: int = 100, sample: int = 256, seed: int = K.SEED) -> DataFrame:
    """Signal per pair: the 90th percentile of the min-max scaled scores and its level."""
    scored = score_runs(runs, pairs, forest(runs, trees, sample, seed))
    counts = scored.groupBy(*K.PAIR, "anomaly_score").agg(F.count("*").alias("k"))
    p90 = ranks.interpolated_of_counts(counts, K.PAIR, "anomaly_score", 0.90, "p90", width=1 / 1024)
    span = counts.groupBy(*K.PAIR).agg(
        F.min("anomaly_score").alias("lo"), F.max("anomaly_score").alias("hi"), F.sum("k").alias("eval_n")
    )
    scaled = F.when(F.col("hi") > F.col("lo"), (F.col("p90") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    return p90.join(span, K.PAIR).select(*K.PAIR, "eval_n", F.round(scaled, 4).alias("score")).withColumn("level", level(F.col("score")))


def level(score):
    """Name of an anomaly score."""
    return F.when(score >= 0.75, "CRITICAL").when(score >= 0.55, "HIGH").when(score >= 0.30, "ELEVATED").otherwise("NORMAL")


def top_dims(runs: DataFrame, pairs: DataFrame, k: int = 3) -> DataFrame:
    """The k features whose mean moved most, in baseline deviations."""
    vector = C.behaviour_vector()
    stats = runs.groupBy(*K.GROUP).agg(
        *[F.avg(v.cast("double")).alias(f"{d}__m") for d, v in vector.items()],
        *[F.stddev_pop(v.cast("double")).alias(f"{d}__s") for d, v in vector.items()],
    )
    wide = P.both_sides(stats, pairs, [c for c in stats.columns if c not in K.GROUP])
    shift = lambda d: F.when(F.col(f"b_{d}__s") < 1e-9, 0.0).otherwise(
        F.abs(F.col(f"c_{d}__m") - F.col(f"b_{d}__m")) / F.col(f"b_{d}__s")
    )
    rows = F.array(*[F.struct(F.lit(d).alias("dim"), shift(d).alias("shift"), F.lit(i).alias("pos")) for i, d in enumerate(vector)])
    flat = wide.select(*K.PAIR, F.explode(rows).alias("r")).select(*K.PAIR, "r.dim", "r.shift", "r.pos")
    w = Window.partitionBy(*K.PAIR).orderBy(F.round("shift", 9).desc(), "pos")
    return flat.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k).select(*K.PAIR, "position", "dim", "shift")
