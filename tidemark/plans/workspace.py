"""Tables shared by many queries, written once per session into the cluster's shared folder."""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators import compare, distance, fingerprint, pairs
from tidemark.plans import inputs
from tidemark.session import ensure_checkpoint_dir

_SPACES: dict[tuple[str, str], Workspace] = {}


class Workspace:
    """Derived tables for one input folder. Each is a Parquet table, so later plans stay shallow,
    prune columns and know their sizes, and a lost executor costs nothing."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        self.folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tidemark-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def table(self, name: str) -> DataFrame:
        return inputs.table(self.spark, self.sf_dir, name)

    @cached_property
    def runs(self) -> DataFrame:
        return self.keep(inputs.runs_from_events(self.spark, self.sf_dir), "runs")

    @cached_property
    def order_runs(self) -> DataFrame:
        return self.keep(inputs.runs_from_orders(self.spark, self.sf_dir), "order_runs")

    @cached_property
    def traces(self) -> tuple[DataFrame, DataFrame]:
        traces, observations = inputs.conversation_traces(self.spark, self.sf_dir)
        return self.keep(traces, "traces"), self.keep(observations, "observations")

    @cached_property
    def pairs(self) -> DataFrame:
        return self.keep(pairs.consecutive_pairs(self.runs), "pairs")

    @cached_property
    def fp(self) -> DataFrame:
        return self.keep(fingerprint.fp_scalar(self.runs), "fp")

    @cached_property
    def dist(self) -> DataFrame:
        return self.keep(fingerprint.fp_dist(self.runs), "dist")

    @cached_property
    def wide(self) -> DataFrame:
        emd = distance.emd(self.runs, self.pairs)
        return self.keep(compare.compared(self.fp, self.dist, self.pairs, emd), "wide")


def workspace(spark: SparkSession, sf_dir: str) -> Workspace:
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in _SPACES:
        _SPACES[key] = Workspace(spark, sf_dir.rstrip("/"))
    return _SPACES[key]
