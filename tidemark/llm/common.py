"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import ensure_checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable:
    def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back: lineage ends there and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of all texts: one scan of one column."""
    return docs.agg(F.sum(F.octet_length(column))).first()[0] or 0


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of an undirected edge table: root is the smallest node that links lead to.

    Each round every node takes the smallest root among its neighbours' roots, and roots then take their
    own root (two hops at once), so chains shrink by halves. Rounds are tables in the shared folder;
    the driver only learns whether anything changed. A neighbourhood is pre-aggregated before it moves.
    """
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("to"))
    both = keep(both.union(both.select("to", "node")).where("node != to").distinct(), "edges")
    roots = keep(both.groupBy("node").agg(F.min("to").alias("root")).select("node", F.least("node", "root").alias("root")), "roots")
    while True:
        told = both.join(roots.withColumnRenamed("node", "to"), "to").select("node", "root")
        own = roots.select("node", "root")
        # What a node hears goes to the root it had as well: whole trees hang on the smaller root at once.
        heard = told.groupBy("node").agg(F.min("root").alias("heard"))
        step = keep(own.join(heard, "node").select("node", "root", F.least("root", "heard").alias("new")), "step")
        moved = step.where("new < root")
        if moved.isEmpty():
            return roots
        hooks = keep(moved.groupBy(F.col("root").alias("old")).agg(F.min("new").alias("hook")), "hooks")
        hooked = step.select("node", F.col("root").alias("old"), "new").join(hooks, "old", "left")
        hooked = keep(hooked.select("node", F.least("new", F.coalesce("hook", "new")).alias("root")), "hooked")
        up = hooked.select(F.col("node").alias("root"), F.col("root").alias("higher"))
        roots = keep(hooked.join(up, "root", "left").select("node", F.least("root", F.coalesce("higher", "root")).alias("root")), "roots")
