"""Filters, limits and retention over runs."""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import constants as K
from tidemark.operators import ranks


def runs_for(
    runs: DataFrame,
    version: str | None = None,
    env: str | None = None,
    limit: int | None = None,
    by: Sequence[str] = tuple(K.GROUP),
) -> DataFrame:
    """Runs of a version and environment; with ``limit`` the newest so many of each group."""
    if version is not None:
        runs = runs.where(F.col("deployment_version") == version)
    if env is not None:
        runs = runs.where(F.col("environment") == env)
    return runs if limit is None else ranks.newest_in_time(runs, by, "started_at", ["id"], limit)


def filter_runs(
    runs: DataFrame,
    version: str | None = None,
    env: str | None = None,
    outcomes: Sequence[str] | None = None,
    min_latency: int | None = None,
    max_latency: int | None = None,
    hours: int | None = None,
    since: datetime | None = None,
    between: tuple[datetime, datetime] | None = None,
    as_of: datetime | None = None,
) -> DataFrame:
    """All filters a listing offers; every one reaches the scan."""
    tests: list[Column] = []
    if version is not None:
        tests.append(F.col("deployment_version") == version)
    if env is not None:
        tests.append(F.col("environment") == env)
    if outcomes:
        tests.append(F.col("semantic_cluster").isin(list(outcomes)))
    if min_latency is not None:
        tests.append(F.col("latency_ms") >= min_latency)
    if max_latency is not None:
        tests.append(F.col("latency_ms") <= max_latency)
    if hours is not None:
        if as_of is None:
            raise ValueError("hours needs as_of")
        tests.append(F.col("started_at") >= ntz(as_of - timedelta(hours=hours)))
    if since is not None:
        tests.append(F.col("started_at") >= ntz(since))
    if between is not None:
        tests.append(F.col("started_at").between(ntz(between[0]), ntz(between[1])))
    for test in tests:
        runs = runs.where(test)
    return runs


def ntz(at: datetime) -> Column:
    return F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz")


def count_runs(runs: DataFrame, **filters) -> DataFrame:
    return filter_runs(runs, **filters).agg(F.count("*").alias("run_count"))


def page(runs: DataFrame, offset: int = 0, limit: int = 50) -> DataFrame:
    """One page of a listing, newest first."""
    return runs.orderBy(F.col("started_at").desc(), F.col("id").desc()).offset(offset).limit(limit)


def last_n(runs: DataFrame, n: int, by: Sequence[str] = ("session_id", "environment")) -> DataFrame:
    """The newest n runs of an agent whatever their version."""
    return ranks.newest_in_time(runs, by, "started_at", ["id"], n)


def newest_run(runs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The newest run of each group (or of the table)."""
    record = F.struct(*[c for c in runs.columns if c not in by])
    newest = F.max_by(record, F.struct("started_at", "id")).alias("r")
    grouped = runs.groupBy(*by).agg(newest) if by else runs.agg(newest)
    return grouped.where(F.col("r").isNotNull()).select(*by, "r.*")


def run_by_id(runs: DataFrame, run_id: str) -> DataFrame:
    return runs.where(F.col("id") == run_id)


# ---- fixed values: hours meant by a named period -----------------------------------------------
NAMED_HOURS = {"today": 24, "yesterday": 48, "this-week": 168, "last-week": 336, "this-month": 720}


def time_filter(text: str, as_of: datetime, column: str = "started_at") -> Column:
    """``today``, ``24h``, ``7d``, ``2w`` or ``2024-01-01..2024-01-31`` as a predicate."""
    ts = F.col(column)
    if text in NAMED_HOURS:
        return ts >= ntz(as_of - timedelta(hours=NAMED_HOURS[text]))
    if ".." in text:
        lo, hi = (datetime.fromisoformat(part) for part in text.split("..", 1))
        return ts.between(ntz(lo), ntz(hi))
    match = re.fullmatch(r"(\d+)([hdw])", text)
    if not match:
        raise ValueError(f"unknown period: {text}")
    hours = int(match[1]) * {"h": 1, "d": 24, "w": 168}[match[2]]
    return ts >= ntz(as_of - timedelta(hours=hours))


def quality_filter(name: str) -> Column:
    """Named predicates of the listing."""
    named = {
        "errors-only": F.col("error_count") > 0,
        "slow": F.col("latency_ms") >= 1000,
        "fast": F.col("latency_ms") <= 100,
        "high-cost": F.col("prompt_tokens") >= 10000,
        "production": F.col("environment") == "production",
        "staging": F.col("environment") == "staging",
    }
    if name not in named:
        raise ValueError(f"unknown filter: {name}")
    return named[name]


def keep_last(runs: DataFrame, n: int, by: Sequence[str] = ()) -> DataFrame:
    """Retention by count: the newest n runs of each group, or of the whole table."""
    return ranks.newest_in_time(runs, by, "started_at", ["id"], n)


def older_than(runs: DataFrame, days: int, as_of: datetime, version: str | None = None, env: str | None = None) -> DataFrame:
    """Rows that retention by age removes, optionally only of one version or environment."""
    return filter_runs(runs, version=version, env=env).where(F.col("started_at") < ntz(as_of - timedelta(days=days)))


def prune_older(runs: DataFrame, days: int, as_of: datetime, version: str | None = None, env: str | None = None) -> DataFrame:
    """Rows that stay after retention by age."""
    doomed = F.col("started_at") < ntz(as_of - timedelta(days=days))
    if version is not None:
        doomed = doomed & (F.col("deployment_version") == version)
    if env is not None:
        doomed = doomed & (F.col("environment") == env)
    return runs.where(~F.coalesce(doomed, F.lit(False)))


def orphan_text(blobs: DataFrame, runs: DataFrame) -> DataFrame:
    """Text rows whose run is gone."""
    return blobs.join(runs.select(F.col("id").alias("run_id")), "run_id", "left_anti")


def low_sample(runs: DataFrame, n: int = 10, by: Sequence[str] = tuple(K.GROUP)) -> DataFrame:
    return runs.groupBy(*by).agg(F.count("*").alias("run_count")).where(F.col("run_count") < n)


def without(df: DataFrame, **keys: str) -> DataFrame:
    """All rows but those matching every given key (version, agent, ...)."""
    hit = F.lit(True)
    for column, value in keys.items():
        hit = hit & F.col(column).eqNullSafe(F.lit(value))
    return df.where(~hit)
