"""Keyed state of streams: the newest rows of every key over restarts, and scores that change."""

from collections import defaultdict

from pyspark.sql import functions as F

from tidemark import streaming
from tidemark.streaming import state


def drained(stream, out, checkpoint):
    def handle(batch, batch_id):
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    streaming._batches(stream, checkpoint, handle).awaitTermination()


def test_newest_rows_over_restarts(spark, tmp_path):
    source, out, checkpoint = (f"{tmp_path}/{x}" for x in ("in", "out", "checkpoint"))
    schema = "agent string, id string, started_at timestamp, value long, tools array<string>"
    day = lambda k: f"timestamp'2024-01-01' + make_interval(0, 0, 0, {k})"
    hot = spark.range(3000).select(
        F.lit("hot").alias("agent"), F.format_string("r%05d", "id").alias("id"), F.expr("timestamp'2024-01-01' + make_dt_interval(0, 0, 0, id % 700)").alias("started_at"),
        F.col("id").alias("value"), F.array(F.lit("a"), F.col("id").cast("string")).alias("tools"),
    )
    late = spark.sql(f"select 'hot' agent, 'late' id, {day(0)} started_at, -1L value, array('x') tools union all select 'hot', 'new', {day(9)}, null, null")
    cold = spark.sql(f"select 'cold' agent, 'c1' id, {day(1)} started_at, 5L value, array('q') tools union all select 'cold', 'c1', {day(1)}, 5L, array('q') union all select null, null, {day(2)}, 6L, array()")
    seen, touched = defaultdict(list), []
    for drop in (hot.union(cold), late, cold):
        drop.write.mode("append").parquet(source)
        for r in drop.collect():
            seen[r.agent].append((r.started_at, r.id or "", r.value, r.tools))
        touched.append({r.agent for r in drop.collect()})
        stream = spark.readStream.schema(schema).parquet(source)
        drained(state.newest_rows(stream, ["agent"], ["value", "tools"], 4), out, checkpoint)
        last = spark.read.parquet(f"{out}/batch={len(touched) - 1}")
        got = defaultdict(list)
        for r in last.collect():
            got[r.agent].append((r.id, r.value, r.tools))
        assert set(got) == touched[-1]
        for agent, rows in got.items():
            want = sorted(seen[agent], key=lambda x: (x[0], x[1]), reverse=True)[:4]
            assert rows == [x[1:] for x in want]


def test_only_scores_that_change_are_told(spark, tmp_path):
    source, out, checkpoint = (f"{tmp_path}/{x}" for x in ("in", "out", "checkpoint"))
    rows = [[("a", 0.5, 0), ("a", 0.5, 1), ("b", 0.2, 1)], [("a", 0.5, 2), ("a", 0.6, 3), ("a", 0.6, 4)], [("a", 0.5, 5), ("b", 0.2, 6)]]
    for k, drop in enumerate(rows):
        spark.createDataFrame(drop, "agent string, score double, batch_id long").write.mode("append").parquet(source)
        stream = spark.readStream.schema("agent string, score double, batch_id long").parquet(source)
        told = state.changed_scores(stream, ["agent"])
        streaming._batches(told, checkpoint, lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/told={n}")).awaitTermination()
    got = {(r.agent, r.score, r.batch_id) for r in spark.read.parquet(f"{out}/told=*").collect()}
    assert got == {("a", 0.5, 0), ("b", 0.2, 1), ("a", 0.6, 3), ("a", 0.5, 5)}
