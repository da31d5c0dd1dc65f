"""Behavioural epochs: stretches of runs that behave alike, found over time without versions."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import constants as K
from tidemark.operators import distance as D
from tidemark.operators import fingerprint as FP
from tidemark.operators import ranks
from tidemark.operators import select as S
from tidemark.session import kept
from tidemark.session import ensure_checkpoint_dir

AGENT = ("session_id",)


def ordered(runs: DataFrame, by: Sequence[str] = AGENT) -> DataFrame:
    """Runs with their 0-based position ``r`` in the agent's time order and the agent's total ``n``."""
    return (
        ranks.numbered(runs, by, "started_at", ["id"], name="rn")
        .withColumn("r", F.col("rn") - 1)
        .withColumn("n", F.col("rn_n"))
        .drop("rn", "rn_n")
    )


def _entries() -> Column:
    return FP.dist_entries(("outcome", "tool"))


def epoch_windows(positions: DataFrame, w: int = K.EPOCH_WINDOW, by: Sequence[str] = AGENT, min_runs: int = K.EPOCH_MIN_RUNS) -> DataFrame:
    """Counts per (agent, window start, kind, key). Windows start every w/2 runs while start < n - w."""
    step = w // 2
    first = F.greatest(F.lit(0), F.ceil((F.col("r") - w + 1) / F.lit(step))).cast("long")
    last = F.least(F.floor(F.col("r") / F.lit(step)), F.floor((F.col("n") - w - 1) / F.lit(step))).cast("long")
    placed = (
        positions.where((F.col("n") >= min_runs) & (F.col("n") > w))
        .withColumn("first", first)
        .withColumn("last", last)
        .where(F.col("first") <= F.col("last"))
    )
    return (
        placed.select(*by, F.explode(F.sequence("first", "last")).alias("slot"), _entries().alias("entries"))
        .select(*by, (F.col("slot") * step).alias("window_start"), F.explode("entries").alias("e"))
        .groupBy(*by, "window_start", F.col("e.kind").alias("kind"), F.col("e.key").alias("key"))
        .agg(F.count("*").alias("n"))
    )


def window_change(windows: DataFrame, w: int = K.EPOCH_WINDOW, by: Sequence[str] = AGENT) -> DataFrame:
    """Mean of outcome and tool divergence between each window and the one before it."""
    by = list(by)
    step = w // 2
    shares = FP.with_share(windows, [*by, "window_start"])
    roles = F.array(
        F.struct(F.lit("c").alias("side"), F.col("window_start").alias("at")),
        F.struct(F.lit("b").alias("side"), (F.col("window_start") + step).alias("at")),
    )
    sided = shares.select(*by, "kind", "key", "n", "share", F.explode(roles).alias("x")).select(
        *by, "kind", "key", "n", "share", "x.side", "x.at"
    )
    table = D.combine_sides(sided, [*by, "at"])
    both = table.groupBy(*by, "at").agg(F.max("b_n").alias("has_b"), F.max("c_n").alias("has_c"))
    wide = D.jsd_wide(table, [*by, "at"]).join(both, [*by, "at"])
    return wide.where((F.col("has_b") > 0) & (F.col("has_c") > 0)).select(
        *by, F.col("at").alias("position"), ((F.col("outcome_jsd") + F.col("tool_jsd")) / 2).alias("change")
    )


def epoch_breaks(windows: DataFrame, w: int = K.EPOCH_WINDOW, cut: float = K.EPOCH_CUT, by: Sequence[str] = AGENT) -> DataFrame:
    """Positions where behaviour changes by more than the cut."""
    return window_change(windows, w, by).where(F.col("change") > cut)


def _next_breaks(breaks: DataFrame, gap: int, by: list[str]) -> DataFrame:
    """Each break with the first one at least ``gap`` later (``after``) and whether one lies less than ``gap`` before it (``near``).

    Every break asks at its own place and at ``gap`` behind it. Positions are cut into blocks of ``gap``, so a task orders
    at most ``gap`` breaks and as many questions; what has no answer inside a block comes from the table of blocks.
    """
    points = (
        breaks.select(*by, F.col("position").alias("at"), F.lit(None).cast("long").alias("asks"))
        .unionByName(breaks.select(*by, (F.col("position") + gap).alias("at"), F.col("position").alias("asks")))
        .withColumn("block", F.floor(F.col("at") / gap))
    )
    real = F.when(F.col("asks").isNull(), F.col("at"))
    blocks = points.groupBy(*by, "block").agg(F.min(real).alias("first"))
    back = Window.partitionBy(*by).orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    later = blocks.select(*by, "block", F.last("first", ignorenulls=True).over(back).alias("later"))
    # From the end of a block: breaks before the questions at the same place.
    down = Window.partitionBy(*by, "block").orderBy(F.col("at").desc(), F.col("asks").asc_nulls_first())
    so_far = down.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    others = Window.partitionBy(*by, "block").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    seen = points.select(
        "*",
        F.last(real, ignorenulls=True).over(so_far).alias("inside"),
        # A question further on belongs to a break of the block before that lies less than gap away.
        F.max(F.col("asks").isNotNull()).over(down.rowsBetween(Window.unboundedPreceding, -1)).alias("open"),
        F.count(real).over(others).alias("same"),
    )
    answers = (
        seen.where(F.col("asks").isNotNull())
        .join(later, [*by, "block"])
        .select(*by, F.col("asks").alias("position"), F.coalesce("inside", "later").alias("after"), F.lit(None).cast("boolean").alias("near"))
    )
    own = seen.where(F.col("asks").isNull()).select(
        *by, F.col("at").alias("position"), F.lit(None).cast("long").alias("after"), (F.coalesce("open", F.lit(False)) | (F.col("same") > 0)).alias("near")
    )
    return answers.unionByName(own).groupBy(*by, "position").agg(F.max("after").alias("after"), F.bool_or("near").alias("near"))


def merge_breaks(breaks: DataFrame, gap: int = 10, by: Sequence[str] = AGENT) -> DataFrame:
    """Drops a break closer than ``gap`` runs to the last one kept.

    A break with none less than ``gap`` before it is always kept and starts a chain; the others are kept if a chain
    of jumps to the next break at least ``gap`` away meets them. Pointer jumping walks all chains at once: each round
    marks what the marked ones reach and doubles the jumps, and only jumps that still have a next one
    stay, so the rounds are the logarithm of the number of breaks in a row that are kept. Repeated positions count once, null ones go.
    """
    by = list(by)
    found = breaks.where(F.col("position").isNotNull()).select(*by, F.col("position").cast("long").alias("position")).distinct()
    if gap <= 1:
        return found
    linked = kept(_next_breaks(found, gap, by), "breaks")
    marked = linked.where(~F.col("near")).select(*by, "position")
    jumps = linked.where(F.col("after").isNotNull()).select(*by, "position", "after")
    while not jumps.isEmpty():
        reached = marked.join(jumps, [*by, "position"]).select(*by, F.col("after").alias("position"))
        marked = kept(marked.unionByName(reached).distinct(), "marked")
        further = jumps.select(*by, F.col("position").alias("after"), F.col("after").alias("last"))
        jumps = kept(jumps.join(further, [*by, "after"]).select(*by, "position", F.col("last").alias("after")), "jumps")
    return marked


def with_epoch(positions: DataFrame, breaks: DataFrame, by: Sequence[str] = AGENT, min_runs: int = K.EPOCH_MIN_RUNS, block: int = 100_000) -> DataFrame:
    """Runs with the number of their epoch: how many breaks lie at or before them.

    Counting runs per block of positions and the offset of each block from the (small) break table
    keeps an agent with very many runs spread over many tasks.
    """
    by = list(by)
    blocked = positions.where(F.col("n") >= min_runs).withColumn("__block", F.floor(F.col("r") / block))
    marks = breaks.select(*by, F.col("position").alias("r"), F.floor(F.col("position") / block).alias("__block"))
    per_block = marks.groupBy(*by, "__block").agg(F.count("*").alias("k"))
    # Every block needs its offset, also those without breaks.
    blocks = blocked.groupBy(*by, "__block").agg(F.count("*").alias("size"))
    offsets = (
        blocks.join(per_block, [*by, "__block"], "left")
        .withColumn("k", F.coalesce("k", F.lit(0)))
        .withColumn(
            "offset",
            F.coalesce(
                F.sum("k").over(Window.partitionBy(*by).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ),
        )
        .select(*by, "__block", "offset")
    )
    flagged = blocked.join(marks.withColumn("hit", F.lit(1)), [*by, "__block", "r"], "left").join(offsets, [*by, "__block"])
    inside = Window.partitionBy(*by, "__block").orderBy("r")
    return flagged.withColumn(
        "epoch", F.col("offset") + F.coalesce(F.sum("hit").over(inside), F.lit(0))
    ).drop("hit", "offset", "__block")


def epochs(tagged: DataFrame, by: Sequence[str] = AGENT) -> DataFrame:
    """One row per epoch: first and last run, times, size, label and stability."""
    by = list(by)
    bounds = tagged.groupBy(*by, "epoch").agg(
        F.min("r").alias("start_r"),
        F.count("*").alias("run_count"),
        F.min_by("id", "r").alias("start_run_id"),
        F.max_by("id", "r").alias("end_run_id"),
        F.min_by("started_at", "r").alias("start_time"),
        F.max_by("completed_at", "r").alias("end_time"),
    )
    return (
        bounds.join(epoch_stability(tagged, bounds, by), [*by, "epoch"], "left")
        .withColumn("label", F.concat(F.lit("epoch-"), F.to_date("start_time")))
        .withColumn("stability", F.coalesce("stability", F.lit("UNKNOWN")))
    )


def epoch_stability(tagged: DataFrame, bounds: DataFrame, by: Sequence[str] = AGENT) -> DataFrame:
    """HIGH / MODERATE / LOW by the change between the two halves of an epoch; UNKNOWN under 10 runs."""
    by = list(by)
    sized = tagged.drop("run_count").join(
        bounds.where(F.col("run_count") >= 10).select(*by, "epoch", "start_r", "run_count"), [*by, "epoch"]
    )
    side = F.when(F.col("r") - F.col("start_r") < F.expr("run_count div 2"), "b").otherwise("c")
    counts = (
        sized.select(*by, "epoch", side.alias("side"), F.explode(_entries()).alias("e"))
        .groupBy(*by, "epoch", "side", F.col("e.kind").alias("kind"), F.col("e.key").alias("key"))
        .agg(F.count("*").alias("n"))
    )
    table = D.combine_sides(FP.with_share(counts, [*by, "epoch", "side"]), [*by, "epoch"])
    change = (F.col("outcome_jsd") + F.col("tool_jsd")) / 2
    level = F.when(change < 0.10, "HIGH").when(change < 0.20, "MODERATE").otherwise("LOW")
    return D.jsd_wide(table, [*by, "epoch"]).select(*by, "epoch", change.alias("inner_change"), level.alias("stability"))


def detect(runs: DataFrame, w: int = K.EPOCH_WINDOW, cut: float = K.EPOCH_CUT, by: Sequence[str] = AGENT) -> DataFrame:
    """From runs to epochs. Merging only matters for windows under 20 runs and is skipped otherwise.

    The break table is small and read several times, so it is checkpointed to the shared folder.
    """
    positions = ordered(runs, by)
    breaks = epoch_breaks(epoch_windows(positions, w, by), w, cut, by)
    if w // 2 < 10:
        breaks = merge_breaks(breaks, by=by)
    ensure_checkpoint_dir(runs.sparkSession)
    breaks = breaks.select(*by, "position").checkpoint()
    return epochs(with_epoch(positions, breaks, by), by)


def epoch_trend(found: DataFrame, by: Sequence[str] = AGENT) -> DataFrame:
    """Shifts, present state and longest HIGH epoch per agent."""
    latest = F.max_by("stability", "epoch")
    state = (
        F.when(F.col("latest").isin("HIGH", "MODERATE"), "STABLE").when(F.col("latest") == "LOW", "DEGRADED").otherwise("INSUFFICIENT_DATA")
    )
    high = F.min(F.when(F.col("stability") == "HIGH", F.struct((-F.col("run_count")).alias("minus"), F.col("epoch"), F.col("label"))))
    return (
        found.groupBy(*by)
        .agg((F.count("*") - 1).alias("shifts"), latest.alias("latest"), high.alias("h"), F.sum("run_count").alias("runs"))
        .select(*by, "shifts", state.alias("state"), F.col("h.label").alias("longest_stable"), (-F.col("h.minus")).alias("longest_runs"), "runs")
    )


def temporal_sides(runs: DataFrame, as_of: datetime, days: int = 7, hours: int = 24) -> DataFrame:
    """The trailing week (side b) and the trailing day (side c) of the same version; they overlap."""
    recent = runs.where((F.col("started_at") >= S.ntz(as_of - timedelta(days=days))) & (F.col("started_at") <= S.ntz(as_of)))
    in_day = F.col("started_at") >= S.ntz(as_of - timedelta(hours=hours))
    sides = F.when(in_day, F.array(F.lit("b"), F.lit("c"))).otherwise(F.array(F.lit("b")))
    return recent.select("*", F.explode(sides).alias("side"))


def temporal_pair(runs: DataFrame, as_of: datetime, days: int = 7, hours: int = 24, min_runs: int = 10) -> DataFrame:
    """Fingerprints of both time sides per group, where each holds enough runs."""
    fp = FP.fp_scalar(temporal_sides(runs, as_of, days, hours), [*K.GROUP, "side"]).where(F.col("n") >= min_runs)
    whole = fp.groupBy(*K.GROUP).agg(F.count("*").alias("k")).where(F.col("k") == 2).select(*K.GROUP)
    return fp.join(whole, K.GROUP, "left_semi")


def changes_near_epochs(found: DataFrame, changes: DataFrame, days: int = 1) -> DataFrame:
    """Change events within some days of an epoch's start: an equi-join on agent and day bucket.

    ``changes``: session_id, change_type, recorded_at. Each epoch start looks into the day buckets it
    can reach, so no pair outside them is ever formed.
    """
    day = lambda c: F.datediff(F.col(c), F.lit("1970-01-01").cast("date"))
    reach = found.select(
        "session_id", "epoch", "label", "start_time", F.explode(F.sequence(day("start_time") - days, day("start_time") + days)).alias("bucket")
    )
    dated = changes.select("session_id", "change_type", "recorded_at", day("recorded_at").alias("bucket"))
    gap = F.timestamp_diff("SECOND", F.col("start_time"), F.col("recorded_at"))
    return (
        reach.join(dated, ["session_id", "bucket"])
        .withColumn("gap_seconds", gap)
        .where(F.abs("gap_seconds") <= days * 86400)
        .drop("bucket")
    )


