"""Session helpers. On a cluster the session comes from outside; these are for tests and benches."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidemark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for reliable checkpoints: the cluster's own setting. A local session may do without; then a
    temporary folder serves, as there is no other machine that has to see it."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not configured and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    target = configured or tempfile.mkdtemp(prefix="tidemark-checkpoint-")
    spark.sparkContext.setCheckpointDir(target)
    return spark.sparkContext.getCheckpointDir()


def kept(df: DataFrame, name: str) -> DataFrame:
    """The rows as a written table in the shared folder: later plans start there, and lost executors cost nothing before it."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/tidemark-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
