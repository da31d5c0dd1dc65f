"""Distances between two distributions."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.functions import constants as K
from tidemark.operators import pairs as P
from tidemark.operators import ranks

LN2 = math.log(2)


def share_table(dist: DataFrame, pairs: DataFrame) -> DataFrame:
    """Both sides' shares and counts per (pair, kind, key); a missing side counts as 0."""
    return combine_sides(P.attach(dist, pairs), K.PAIR)


def combine_sides(sided: DataFrame, by: Sequence[str]) -> DataFrame:
    on = lambda side, c: F.coalesce(F.sum(F.when(F.col("side") == side, F.col(c))), F.lit(0))
    return sided.groupBy(*by, "kind", "key").agg(
        on("b", "share").alias("p"), on("c", "share").alias("q"), on("b", "n").alias("b_n"), on("c", "n").alias("c_n")
    )


def _jsd_term() -> Column:
    m = (F.col("p") + F.col("q")) / 2
    part = lambda c: F.when(F.col(c) > 0, F.col(c) * F.ln(F.col(c) / m)).otherwise(0.0)
    return 0.5 * (part("p") + part("q"))


def jsd_table(shares: DataFrame, by: Sequence[str] = tuple(K.PAIR)) -> DataFrame:
    """Per kind: ``jsd`` (base 2, clamped; one empty side gives 1) and ``js_distance`` (root, nats)."""
    raw = shares.groupBy(*by, "kind").agg(
        F.sum(_jsd_term()).alias("nats"), F.max("p").alias("has_b"), F.max("q").alias("has_c")
    )
    one_empty = (F.col("has_b") == 0) | (F.col("has_c") == 0)
    return raw.select(
        *by,
        "kind",
        F.when(one_empty, 1.0).otherwise(C.clamp01(F.col("nats") / LN2)).alias("jsd"),
        F.when(one_empty, 0.0).otherwise(F.sqrt(F.greatest(F.lit(0.0), F.col("nats")))).alias("js_distance"),
    )


def jsd_wide(shares: DataFrame, by: Sequence[str] = tuple(K.PAIR)) -> DataFrame:
    """One row per pair: decision, semantic and tool divergence and the transition distance."""
    return shares.groupBy(*by).agg(*jsd_columns())


def jsd_columns() -> list[Column]:
    """Aggregates over a share table (kind, p, q) that give the four distances of one group."""

    def parts(kind: str) -> tuple[Column, Column, Column]:
        of_kind = lambda c: F.when(F.col("kind") == kind, c)
        sides = F.least(
            F.coalesce(F.max(of_kind(F.col("p"))), F.lit(0.0)), F.coalesce(F.max(of_kind(F.col("q"))), F.lit(0.0))
        )
        return F.coalesce(F.sum(of_kind(_jsd_term())), F.lit(0.0)), sides, F.count(of_kind(F.lit(1)))

    return jsd_of_parts(parts)


def jsd_of_parts(parts: Callable[[str], tuple[Column, Column, Column]]) -> list[Column]:
    """The four distances from each kind's sum of terms, the smaller of its sides' largest shares and its number of keys."""

    def divergence(kind: str) -> Column:
        nats, smaller, keys = parts(kind)
        return F.when(keys == 0, 0.0).when(smaller == 0, 1.0).otherwise(C.clamp01(nats / LN2))

    nats, smaller, _ = parts("bigram")
    return [
        divergence("sequence").alias("decision_jsd"),
        divergence("outcome").alias("outcome_jsd"),
        divergence("tool").alias("tool_jsd"),
        F.when(smaller == 0, 0.0).otherwise(F.sqrt(F.greatest(F.lit(0.0), nats))).alias("transition_distance"),
    ]


def emd(runs: DataFrame, pairs: DataFrame, column: str = "latency_ms", width: float = 1024) -> DataFrame:
    """Earth mover's distance per pair: the integral of the gap between the two step functions."""
    counts = runs.where(F.col(column).isNotNull()).groupBy(*K.GROUP, F.col(column).alias("value")).agg(
        F.count("*").alias("k")
    )
    return emd_of_counts(P.attach(counts, pairs), K.PAIR, width)


def emd_of_counts(sided: DataFrame, by: Sequence[str], width: float = 1024) -> DataFrame:
    on = lambda side: F.coalesce(F.sum(F.when(F.col("side") == side, F.col("k"))), F.lit(0))
    values = sided.groupBy(*by, "value").agg(on("b").alias("kb"), on("c").alias("kc"))
    steps = ranks.running(values, by, "value", ["kb", "kc"], width, successor=True)
    gap = F.abs(F.col("cum_kb") / F.col("all_kb") - F.col("cum_kc") / F.col("all_kc"))
    return (
        steps.where((F.col("all_kb") > 0) & (F.col("all_kc") > 0))
        .groupBy(*by)
        .agg(F.sum(F.coalesce(gap * (F.col("next_value") - F.col("value")), F.lit(0.0))).alias("emd"))
    )
