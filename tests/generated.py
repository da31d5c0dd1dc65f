"""Generated pairs of versions: ``spark.range`` with hash-derived columns, no random numbers."""

from pyspark.sql import functions as F


def uniform(tag):
    return F.pmod(F.xxhash64(F.lit(tag), "k", "side"), F.lit(1 << 30)) / F.lit(float(1 << 30))


def normal(tag):
    """About N(0, 1): twelve uniforms minus six."""
    total = F.lit(-6.0)
    for i in range(12):
        total = total + uniform(f"{tag}{i}")
    return total


def pair(spark, n=200, **change):
    """n baseline and n current runs; ``change`` overrides columns of the current side."""
    sides = spark.range(n).withColumnRenamed("id", "k").select("k", F.explode(F.array(F.lit("b"), F.lit("c"))).alias("side"))
    base = {
        "tools": F.array(F.lit("tool_a"), F.lit("tool_b")),
        "latency_ms": F.greatest(F.lit(1), F.round(1000 + 200 * normal("latency"))).cast("long"),
        "error_count": (uniform("error") < 0.02).cast("long"),
        "semantic_cluster": F.when(uniform("cluster") < 0.9, "cluster_0").otherwise("cluster_error"),
        "output_length": F.round(300 + 50 * normal("length")).cast("long"),
        "retry_count": F.lit(0).cast("long"),
        "loop_count": F.lit(1).cast("long"),
        "verbosity_ratio": F.lit(0.5),
        "prompt_tokens": F.lit(100).cast("long"),
        "completion_tokens": F.lit(50).cast("long"),
        "raw_prompt": F.repeat(F.lit("p"), 240),
    }
    made = sides.select(
        "k",
        "side",
        F.concat_ws("-", "side", "k").alias("id"),
        F.lit("session").alias("session_id"),
        F.lit("production").alias("environment"),
        F.lit("tag").alias("version_source"),
        F.when(F.col("side") == "b", "v1.0").otherwise("v2.0").alias("deployment_version"),
        F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, k + if(side = 'c', 1000, 0))").alias("started_at"),
        *[(F.when(F.col("side") == "c", change[c]).otherwise(v) if c in change else v).alias(c) for c, v in base.items()],
    )
    return (
        made.withColumn("completed_at", F.col("started_at"))
        .withColumn("tool_call_count", F.size("tools").cast("long"))
        .withColumn("time_to_first_tool_ms", F.expr("latency_ms div 10"))
        .drop("k", "side")
    )
