"""Registered queries: name, DataFrame function and, where SQL can say it, the SQL to compare with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans.oracle import sql
from tidemark.plans.workspace import Workspace, workspace

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def plain(df: DataFrame, digits: int = 6) -> DataFrame:
    """Columns in comparable types: rounded doubles without negative zeros, long integers, second-exact text times."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DoubleType):
            # The nudge sends exact ties up whatever order the sums were made in.
            c = F.round(c + 1e-10, digits) + F.lit(0.0)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.DecimalType)):
            c = c.cast("long")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(f.dataType, T.ArrayType):
            c = F.to_json(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, oracle: str | None = None) -> Callable:
    def register(fn: Callable[[Workspace], DataFrame]) -> Callable[[Workspace], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: plain(fn(workspace(spark, sf_dir)))
        if oracle is not None:
            ORACLES[name] = sql(oracle)
        return fn

    return register


def ts(column: str) -> str:
    """SQL text of a time, as ``plain`` writes it."""
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S')"
