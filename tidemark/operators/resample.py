"""Resampling: replicates of a comparison and what is read from them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.functions import constants as K
from tidemark.functions.draws import poisson_rounds
from tidemark.operators import compare as CM
from tidemark.operators import distance as D
from tidemark.operators import pairs as P
from tidemark.operators import ranks
from tidemark.session import kept

REPLICATE = [*K.PAIR, "replicate"]
REPLICATE_COLUMNS = [
    "n",
    "avg_output_length",
    "avg_verbosity_ratio",
    "avg_retry_count",
    "avg_time_to_first_tool_ms",
    "error_rate",
    "p95_latency_ms",
    "p95_loop_count",
]


def capped_sample(
    runs: DataFrame, cap: int = K.BOOTSTRAP_CAP, seed: int = K.SEED, by: Sequence[str] = tuple(K.GROUP)
) -> DataFrame:
    """A reproducible sample of at most ``cap`` runs per group, numbered from 0 in ``idx``."""
    order = [F.md5(F.concat_ws(":", F.lit(seed), "id")), F.col("id")]
    few = ranks.newest(runs, by, order, cap, F.col("id"))
    w = Window.partitionBy(*by)
    return few.withColumn("idx", (F.row_number().over(w.orderBy(*order)) - 1).cast("long")).withColumn(
        "sample_n", F.count("*").over(w)
    )


CHUNKS = 16


def paired_samples(sample: DataFrame, pairs: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One row per pair with both sides' samples as arrays (at most ``cap`` entries each), repeated
    per chunk of rounds and spread, so that all rounds of a chunk are drawn and reduced in one task
    without a further shuffle."""
    arrays = sample.groupBy(*K.GROUP).agg(F.sort_array(F.collect_list(F.struct("idx", *fields))).alias("rows"))
    side = lambda s: arrays.select(
        *K.AGENT, F.col("deployment_version").alias(f"{s}_version"), F.col("rows").alias(f"{s}_rows")
    )
    both = (
        pairs.select(*K.PAIR)
        .join(side("baseline"), [*K.AGENT, "baseline_version"])
        .join(side("current"), [*K.AGENT, "current_version"])
    )
    chunked = both.select("*", F.explode(F.sequence(F.lit(0), F.lit(CHUNKS - 1))).alias("chunk"))
    return ranks.spread(chunked, *K.PAIR, "chunk")


def _draw(samples: DataFrame, b: int, seed: int) -> DataFrame:
    """Per pair, round and side the drawn rows: as many draws with replacement as the sample holds."""
    sides = F.array(
        F.struct(F.lit("b").alias("side"), F.col("baseline_rows").alias("rows")),
        F.struct(F.lit("c").alias("side"), F.col("current_rows").alias("rows")),
    )
    rounds = samples.select(
        *K.PAIR,
        "chunk",
        sides.alias("sides"),
        F.explode(F.filter(F.sequence(F.lit(0), F.lit(b - 1)), lambda x: x % CHUNKS == F.col("chunk"))).alias("replicate"),
    )
    sided = rounds.select(*K.PAIR, "chunk", "replicate", F.explode("sides").alias("s")).select(
        *K.PAIR, "chunk", "replicate", "s.side", "s.rows", F.size("s.rows").alias("n")
    )
    prefix = F.concat_ws(":", F.lit(seed), *K.PAIR, "side", "replicate")
    picks = F.transform(
        F.sequence(F.lit(0), F.col("n") - 1), lambda j: C.seeded_index([F.col("prefix"), j], F.col("n")).cast("int")
    )
    return (
        sided.withColumn("prefix", prefix)
        .withColumn("picks", picks)
        .select(
            *K.PAIR, "chunk", "replicate", "side", "n", F.transform("picks", lambda i: F.get(F.col("rows"), i)).alias("drawn")
        )
    )


def bootstrap(
    runs: DataFrame,
    pairs: DataFrame,
    b: int = K.BOOTSTRAP_ROUNDS,
    cap: int | None = K.BOOTSTRAP_CAP,
    seed: int = K.SEED,
) -> DataFrame:
    """Replicates: per pair and round all twelve dimensions and the fixed-weight composite.

    ``cap=None`` resamples all runs of every group (``bootstrap_all``). Otherwise the sample is capped per group before anything is multiplied, so the work is pairs x b x cap
    draws whatever the size of the groups. Each round's keys and numbers go through one aggregation
    as (kind, key, weight) rows; a key weighs one over the side's total, so sums are shares.
    """
    if cap is None:
        return bootstrap_all(runs, pairs, b, seed)
    sample = capped_sample(runs, cap, seed).select(
        *K.GROUP,
        "idx",
        "latency_ms",
        "loop_count",
        "output_length",
        "verbosity_ratio",
        "retry_count",
        "time_to_first_tool_ms",
        "error_count",
        C.sequence_key(F.col("tools")).alias("sequence"),
        F.coalesce("semantic_cluster", F.lit("cluster_none")).alias("outcome"),
        F.transform(C.bigrams(F.col("tools")), lambda p: F.concat(p["head"], F.lit(" -> "), p["tail"])).alias("moves"),
    )
    drawn = _draw(paired_samples(sample, pairs, [c for c in sample.columns if c not in (*K.GROUP, "idx")]), b, seed)
    field = lambda name: F.transform("drawn", lambda d: d[name])
    mean = lambda name: F.aggregate(
        "drawn", F.lit(0.0), lambda acc, d: acc + d[name].cast("double")
    ) / F.col("n")
    p95 = lambda name: F.get(
        F.array_sort(field(name)), F.least(F.expr("(n * 95) div 100"), F.col("n") - 1).cast("int")
    ).cast("double")
    numbers = {
        "n": F.col("n").cast("double"),
        "avg_output_length": mean("output_length"),
        "avg_verbosity_ratio": mean("verbosity_ratio"),
        "avg_retry_count": mean("retry_count"),
        "avg_time_to_first_tool_ms": mean("time_to_first_tool_ms"),
        "error_rate": mean("error_count"),
        "p95_latency_ms": p95("latency_ms"),
        "p95_loop_count": p95("loop_count"),
    }
    with_moves = drawn.withColumn("moves", F.flatten(field("moves")))
    entry = lambda kind, key, weight: F.struct(
        F.lit(kind).alias("kind"), key.alias("key"), weight.alias("weight")
    )
    one = F.lit(1.0) / F.col("n")
    rows = F.concat(
        F.transform("drawn", lambda d: entry("sequence", d["sequence"], one)),
        F.transform("drawn", lambda d: entry("outcome", d["outcome"], one)),
        F.transform("moves", lambda m: entry("bigram", m, F.lit(1.0) / F.size("moves"))),
        F.array(*[entry("number", F.lit(name), value) for name, value in numbers.items()]),
    )
    weighed = with_moves.select(*REPLICATE, "chunk", "side", F.explode(rows).alias("e")).select(
        *REPLICATE, "chunk", "side", "e.kind", "e.key", "e.weight"
    )
    on = lambda side: F.coalesce(F.sum(F.when(F.col("side") == side, F.col("weight"))), F.lit(0.0))
    shares = weighed.groupBy(*REPLICATE, "chunk", "kind", "key").agg(on("b").alias("p"), on("c").alias("q"))
    number = lambda side, name: F.max(
        F.when((F.col("kind") == "number") & (F.col("key") == name), F.col(side))
    )
    full = shares.groupBy(*REPLICATE, "chunk").agg(
        *D.jsd_columns(),
        *[number("p", c).alias(f"b_{c}") for c in numbers],
        *[number("q", c).alias(f"c_{c}") for c in numbers],
    )
    return _scored(full)


def _scored(full: DataFrame) -> DataFrame:
    scores = CM.dimension_scores(with_emd=False)
    return full.select(
        *REPLICATE,
        *[score.cast("double").alias(dim) for dim, (score, _) in scores.items()],
        CM.resample_composite().alias("composite"),
    )


ROUNDS_PER_DIGEST = 4
MEANS = ["output_length", "verbosity_ratio", "retry_count", "time_to_first_tool_ms", "error_count"]
MEAN_NAMES = {c: "error_rate" if c == "error_count" else f"avg_{c}" for c in MEANS}
TAILS = ["latency_ms", "loop_count"]
REACH = 8.0  # standard errors of a 95th percentile within which the rounds' percentiles are looked for first
SLICE = 2048  # runs drawn, or entries added up, at once
HELD = 4096  # vectors that a task keeps before it hands them on
SUMS = "session_id string, deployment_version string, environment string, kind string, key long, sums array<double>"


def _matrix(column: pa.Array, b: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, b)


def _segments(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where a new combination of values begins."""
    new = np.zeros(len(sorted_columns[0]), bool)
    new[:1] = True
    for c in sorted_columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _vectors(places: Sequence[tuple], vectors: Sequence[np.ndarray], names: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Rows of the places' values and one vector each."""
    for at in range(0, len(places), 512):
        some, stacked = places[at : at + 512], np.stack(vectors[at : at + 512])
        offsets = np.arange(len(some) + 1, dtype=np.int32) * stacked.shape[1]
        values = pa.ListArray.from_arrays(pa.array(offsets), pa.array(stacked.ravel()))
        yield pa.RecordBatch.from_arrays([*map(pa.array, zip(*some, strict=True)), values], names=list(names))


def _added(
    part: pa.RecordBatch, b: int, per_digest: int, numbers: Sequence[str], keys: Sequence[str], lists: Sequence[str]
) -> Iterator[tuple[tuple, np.ndarray]]:
    """Sums of some runs' draws, a vector over the rounds for every (group, kind, key)."""
    known: dict[tuple, int] = {}
    groups = zip(*(part.column(c).to_pylist() for c in K.GROUP), strict=True)
    code = np.array([known.setdefault(g, len(known)) for g in groups])
    names = list(known)
    draws = poisson_rounds(part.column("prefix").to_pylist(), b, per_digest)

    weights, odd, entries = {"n": np.ones(len(code))}, [], []
    for c in numbers:
        column = part.column(c)
        x = column.fill_null(0.0).to_numpy(zero_copy_only=False)
        weights[c], weights[f"n_{c}"] = np.where(np.isfinite(x), x, 0.0), column.is_valid().to_numpy(zero_copy_only=False)
        odd += [(c, i, x[i]) for i in np.flatnonzero(~np.isfinite(x))]
    for c in keys:
        column = part.column(c)
        weights[f"n_{c}"] = valid = column.is_valid().to_numpy(zero_copy_only=False)
        entries.append((c, np.flatnonzero(valid), column.drop_null().to_numpy(zero_copy_only=False)))
    for c in lists:
        column = part.column(c)
        weights[f"n_{c}"] = sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
        entries.append((c, np.repeat(np.arange(len(code)), sizes), column.flatten().to_numpy(zero_copy_only=False)))

    order, stacked = np.argsort(code, kind="stable"), np.array([*weights.values()], np.float64)
    for rows in np.split(order, _segments(code[order])[1:]):
        sums = stacked[:, rows] @ draws[rows].astype(np.float64)
        yield from (((*names[code[rows[0]]], kind, 0), s) for kind, s in zip(weights, sums, strict=True))
    for c, i, x in odd:  # only rounds that draw the run take its infinity
        yield (*names[code[i]], c, 0), np.where(draws[i] > 0, x, 0.0)
    for kind, rows, values in entries:
        order = np.lexsort((values, code[rows]))
        for at in range(0, len(order), SLICE):
            some = order[at : at + SLICE]
            of, key = code[rows[some]], values[some]
            starts = _segments(of, key)
            sums = np.add.reduceat(draws[rows[some]], starts, axis=0, dtype=np.uint16)
            yield from (((*names[of[i]], kind, int(key[i])), s) for i, s in zip(starts, sums, strict=True))


def _round_sums(
    rows: DataFrame, b: int, per_digest: int, numbers: Sequence[str] = (), keys: Sequence[str] = (), lists: Sequence[str] = ()
) -> DataFrame:
    """Sums over the runs of a group, each a vector over the rounds: draws (kind ``n``), draws times a number (its name)
    and draws per value of a key or a list's entry (its name and ``key``), with the draws that have one (``n_<name>``).

    Runs are dealt by ranges of group, key and id, so that tasks are alike in size, a hot group is cut and a task meets
    few keys. A task adds up vectors and never holds its runs; the tasks' vectors of a key are then added.
    """
    session = rows.sparkSession
    tasks = max(int(session.conf.get("spark.sql.shuffle.partitions")), session.sparkContext.defaultParallelism)
    order = [*K.GROUP, *keys[:1]]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        names = [*K.GROUP, "kind", "key", "sums"]
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                for place, sums in _added(batch.slice(at, SLICE), b, per_digest, numbers, keys, lists):
                    if place in held:
                        held[place] += sums
                    else:
                        held[place] = sums.astype(np.float64)
                    if len(held) >= HELD:
                        yield from _vectors([*held], [*held.values()], names)
                        held.clear()
        yield from _vectors([*held], [*held.values()], names)

    dealt = rows.repartitionByRange(tasks, *order, F.xxhash64("prefix")).sortWithinPartitions(*order)
    parts = dealt.mapInArrow(apply, SUMS).groupBy(*K.GROUP, "kind", "key").agg(F.collect_list("sums").alias("parts"))
    add = lambda x, y: F.zip_with(x, y, lambda a, c: a + c)
    whole = F.aggregate(F.slice("parts", F.lit(2), F.size("parts")), F.get("parts", F.lit(0)), add)
    return parts.select(*K.GROUP, "kind", "key", whole.alias("sums"))


def _grouped(runs: DataFrame) -> DataFrame:
    """Runs that can belong to a pair."""
    return runs.where(F.expr(" AND ".join(f"{c} IS NOT NULL" for c in K.GROUP)))


def _prefix(seed: int) -> Column:
    """The text before a round's number in its digest."""
    return F.concat_ws(":", F.lit(seed), *K.GROUP, "id").cast("binary").alias("prefix")


def _windows(slim: DataFrame, reach: float) -> DataFrame:
    """Per group and counted number the values around its 95th percentile, ``reach`` standard errors to either side."""
    entries = F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("value")) for c in TAILS])
    counts = (
        slim.select(*K.GROUP, F.explode(entries).alias("e"))
        .select(*K.GROUP, "e.*")
        .where(F.col("value").isNotNull())
        .groupBy(*K.GROUP, "kind", "value")
        .agg(F.count("*").alias("k"))
    )
    ranked = ranks.running(counts, [*K.GROUP, "kind"], "value", ["k"]).withColumn("n", F.col("all_k"))
    rank, far = ranks.percent_rank(95), F.lit(reach) * F.sqrt(F.col("n") * 0.95 * 0.05)
    near = (F.col("cum_k") >= rank - far) & (F.col("cum_k") - F.col("k") <= rank + far)
    return ranked.where(near).groupBy(*K.GROUP, "kind").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))


def _clipped(slim: DataFrame, windows: DataFrame) -> DataFrame:
    """Runs whose counted numbers outside the windows stand directly beside them."""
    of = lambda c, name: F.max(F.when(F.col("kind") == c, F.col(name))).alias(f"{c}_{name}")
    wide = windows.groupBy(*K.GROUP).agg(*[of(c, name) for c in TAILS for name in ("lo", "hi")])
    lo, hi = (lambda c: F.col(f"{c}_lo")), (lambda c: F.col(f"{c}_hi"))
    inside = {c: F.when(F.col(c) < lo(c), lo(c) - 1).when(F.col(c) > hi(c), hi(c) + 1).otherwise(F.col(c)) for c in TAILS}
    return slim.join(wide, K.GROUP, "left").withColumns(inside).select(*slim.columns)


def _percentiles(sums: DataFrame, b: int) -> DataFrame:
    """95th percentiles of the counted numbers, a vector per group and kind: values pass in order, their draws' sums stay."""
    total = F.col("kind").isin([f"n_{c}" for c in TAILS])
    counted = sums.where(total | F.col("kind").isin(TAILS)).select(
        *K.GROUP, F.regexp_replace("kind", "^n_", "").alias("kind"), F.when(~total, F.col("key")).alias("key"), "sums"
    )
    by = [*K.GROUP, "kind"]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, rank, upto, found = None, None, None, None
        for batch in batches:
            places = zip(*(batch.column(c).to_pylist() for c in by), strict=True)
            for this, key, sums in zip(places, batch.column("key").to_pylist(), _matrix(batch.column("sums"), b), strict=True):
                if key is None:  # a group's totals come before its values
                    if place is not None:
                        yield from _vectors([place], [found], [*by, "p95"])
                    place, rank = this, np.minimum(sums * 95 // 100, sums - 1)
                    upto, found = np.zeros(b), np.full(b, np.nan)
                else:
                    before, upto = upto, upto + sums
                    found[(before <= rank) & (rank < upto)] = key
        if place is not None:
            yield from _vectors([place], [found], [*by, "p95"])

    schema = "session_id string, deployment_version string, environment string, kind string, p95 array<double>"
    ordered = ranks.spread(counted, *by).sortWithinPartitions(*by, F.col("key").asc_nulls_first())
    return ordered.mapInArrow(apply, schema).withColumn("p95", F.transform("p95", lambda x: F.when(~F.isnan(x), x)))


def _tails(slim: DataFrame, sums: DataFrame, windows: DataFrame, b: int, reach: float) -> DataFrame:
    """The rounds' 95th percentiles. Groups with a round outside its window are counted again in wider windows."""
    done = None
    while True:
        tails = kept(_percentiles(sums, b), "tails")
        beside = F.exists("p95", lambda x: F.coalesce((x < F.col("lo")) | (x > F.col("hi")), F.lit(False)))
        missed = kept(tails.join(windows, [*K.GROUP, "kind"]).where(beside).select(*K.GROUP).distinct(), "missed")
        right = tails.join(missed, K.GROUP, "left_anti")
        done = right if done is None else done.unionByName(right)
        if missed.isEmpty():
            return done
        slim, reach = slim.join(missed, K.GROUP, "left_semi"), 8 * reach + 1
        windows = kept(_windows(slim, reach), "windows")
        sums = kept(_round_sums(_clipped(slim, windows), b, ROUNDS_PER_DIGEST, keys=TAILS), "sums")


def _distances(shares: DataFrame, b: int) -> DataFrame:
    """Per pair, kind and round what the divergences are made of, added up per task: terms, largest shares, keys."""
    by = [*K.PAIR, "kind"]
    names = ["nats", "p", "q", "keys"]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                known: dict[tuple, int] = {}
                places = zip(*(part.column(c).to_pylist() for c in by), strict=True)
                code = np.array([known.setdefault(x, len(known)) for x in places])
                p, q = _matrix(part.column("p"), b), _matrix(part.column("q"), b)
                middle = (p + q) / 2
                with np.errstate(divide="ignore", invalid="ignore"):
                    terms = 0.5 * (np.where(p > 0, p * np.log(p / middle), 0.0) + np.where(q > 0, q * np.log(q / middle), 0.0))
                for place, i in known.items():
                    rows = code == i
                    new = np.array([terms[rows].sum(0), p[rows].max(0), q[rows].max(0), (middle[rows] > 0).sum(0)])
                    if place in held:
                        old = held[place]
                        new = np.array([old[0] + new[0], np.maximum(old[1], new[1]), np.maximum(old[2], new[2]), old[3] + new[3]])
                    held[place] = new
                if len(held) >= HELD // 4:
                    yield from _stacked(held)
                    held = {}
        yield from _stacked(held)

    def _stacked(held: dict[tuple, np.ndarray]) -> Iterator[pa.RecordBatch]:
        rows = [(*place, name) for place in held for name in names]
        return _vectors(rows, [v for vectors in held.values() for v in vectors], [*by, "part", "x"])

    schema = ", ".join(f"{c} string" for c in [*by, "part"]) + ", x array<double>"
    parts = shares.select(*by, "p", "q").mapInArrow(apply, schema)
    rounds = parts.select(*by, "part", F.posexplode("x").alias("replicate", "x"))

    def of(kind: str) -> tuple[Column, Column, Column]:
        part = lambda name: F.when((F.col("kind") == kind) & (F.col("part") == name), F.col("x"))
        most = lambda name: F.coalesce(F.max(part(name)), F.lit(0.0))
        total = lambda name: F.coalesce(F.sum(part(name)), F.lit(0.0))
        return total("nats"), F.least(most("p"), most("q")), total("keys")

    return rounds.groupBy(*REPLICATE).agg(*D.jsd_of_parts(of))


def bootstrap_all(runs: DataFrame, pairs: DataFrame, b: int = K.BOOTSTRAP_ROUNDS, seed: int = K.SEED) -> DataFrame:
    """Replicates from all runs: a run's place in a round is its Poisson(1) number of draws.

    Rounds belong to groups, not to pairs, so a version in two pairs is drawn once. All rounds of a sum are one vector
    (draws per sequence, outcome, transition, latency and loop count, and the sums behind the means), so runs are never
    repeated per round: no group has to fit in a task, and what is shuffled follows the distinct keys of a group. Keys
    travel as 64-bit hashes. The 95th percentiles are read off running sums of draws over sorted values; only values
    near a group's own percentile are told apart, and groups where a round's percentile lies elsewhere are counted
    again. Rounds that draw no run of a side (groups of a few runs) do not count. Null numbers count in no mean and no
    percentile.
    """
    moves = F.transform(C.bigrams(F.col("tools")), lambda p: F.xxhash64(p["head"], p["tail"]))
    slim = _grouped(runs).select(
        *K.GROUP,
        _prefix(seed),
        *[F.col(c).cast("double").alias(c) for c in MEANS],
        *[F.col(c).cast("long").alias(c) for c in TAILS],
        F.xxhash64(C.sequence_key(F.col("tools"))).alias("sequence"),
        F.xxhash64(F.coalesce("semantic_cluster", F.lit("cluster_none"))).alias("outcome"),
        F.coalesce(moves, F.array().cast("array<bigint>")).alias("bigram"),
    )
    windows = kept(_windows(slim, REACH), "windows")
    keys = ["sequence", "outcome", *TAILS]
    sums = kept(_round_sums(_clipped(slim, windows), b, ROUNDS_PER_DIGEST, MEANS, keys, ["bigram"]), "sums")
    tails = _tails(slim, sums, windows, b, REACH)

    only = lambda kind, name: F.first(F.when(F.col("kind") == kind, F.col(name)), ignorenulls=True)
    moments = ["n", "n_bigram", *MEANS, *[f"n_{c}" for c in MEANS]]
    totals = sums.where(F.col("kind").isin(moments)).groupBy(*K.GROUP).agg(*[only(c, "sums").alias(c) for c in moments])
    ends = tails.groupBy(*K.GROUP).agg(*[only(c, "p95").alias(f"p95_{c}") for c in TAILS])
    zipped = F.arrays_zip(*moments, *[f"p95_{c}" for c in TAILS])
    numbered = (
        totals.join(ends, K.GROUP, "left")
        .select(*K.GROUP, F.posexplode(zipped).alias("replicate", "z"))
        .select(*K.GROUP, "replicate", "z.*")
        .where(F.col("n") > 0)
        .withColumns({name: F.try_divide(F.col(c), F.col(f"n_{c}")) for c, name in MEAN_NAMES.items()})
    )
    wide = P.pivot_sides(P.attach(numbered, pairs), REPLICATE_COLUMNS, REPLICATE)

    whole = F.when(F.col("kind") == "bigram", F.col("n_bigram")).otherwise(F.col("n"))
    share = F.zip_with("sums", whole, lambda k, n: F.coalesce(F.try_divide(k, n), F.lit(0.0)))
    keyed = sums.where(F.col("kind").isin("sequence", "outcome", "bigram"))
    shares = keyed.join(totals.select(*K.GROUP, "n", "n_bigram"), K.GROUP).select(*K.GROUP, "kind", "key", share.alias("share"))
    of = lambda version, name: shares.withColumnsRenamed({"deployment_version": version, "share": name}).join(
        pairs.select(*K.PAIR), [*K.AGENT, version]
    )
    both = of("baseline_version", "p").join(of("current_version", "q"), [*K.PAIR, "kind", "key"], "full")
    none = F.array_repeat(F.lit(0.0), b)
    both = both.withColumns({side: F.coalesce(side, none) for side in ("p", "q")})
    return _scored(wide.join(_distances(both, b), REPLICATE))


def drift_ci(replicates: DataFrame, scored: DataFrame) -> DataFrame:
    """95 % interval of the composite, widened to hold the point score; flags small samples."""
    bounds = replicates.groupBy(*K.PAIR).agg(
        F.percentile("composite", F.lit(0.025)).alias("lo"), F.percentile("composite", F.lit(0.975)).alias("hi")
    )
    return scored.join(bounds, K.PAIR).select(
        *K.PAIR,
        "drift_score",
        F.least("lo", "drift_score").alias("ci_lower"),
        F.greatest("hi", "drift_score").alias("ci_upper"),
        (F.least("baseline_n", "current_n") < 30).alias("small_sample"),
    )


def _long(replicates: DataFrame) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).alias("value")) for d in K.DIMS])
    return replicates.select(*K.PAIR, F.explode(rows).alias("r")).select(*K.PAIR, "r.dim", "r.value")


def dimension_ci(replicates: DataFrame, dims: DataFrame) -> DataFrame:
    """95 % interval per dimension; significant when it lies above 0."""
    bounds = _long(replicates).groupBy(*K.PAIR, "dim").agg(
        F.percentile("value", F.lit(0.025)).alias("ci_lower"), F.percentile("value", F.lit(0.975)).alias("ci_upper")
    )
    return dims.join(bounds, [*K.PAIR, "dim"]).select(
        *K.PAIR, "dim", F.col("score").alias("observed"), "ci_lower", "ci_upper", (F.col("ci_lower") > 0).alias("significant")
    )


def _spread(replicates: DataFrame, sizes: DataFrame) -> DataFrame:
    sigma = _long(replicates).groupBy(*K.PAIR, "dim").agg(F.stddev_samp("value").alias("sigma"))
    return sigma.join(sizes.select(*K.PAIR, "b_n", "c_n"), K.PAIR)


def mde(replicates: DataFrame, sizes: DataFrame) -> DataFrame:
    """Smallest effect each dimension can show at the present sample sizes."""
    z = K.Z_ALPHA + K.Z_BETA
    return _spread(replicates, sizes).select(
        *K.PAIR, "dim", (F.lit(z) * F.col("sigma") * F.sqrt(1 / F.col("b_n") + 1 / F.col("c_n"))).alias("mde")
    )


def runs_forecast(replicates: DataFrame, sizes: DataFrame, target: float = 0.10) -> DataFrame:
    """Further runs needed for every dimension to show an effect of ``target``."""
    z = K.Z_ALPHA + K.Z_BETA
    per_side = F.pow(F.lit(z) * F.col("sigma") / F.lit(target), F.lit(2.0))
    more = F.ceil(2 * per_side) - (F.col("b_n") + F.col("c_n"))
    return _spread(replicates, sizes).select(*K.PAIR, "dim", F.greatest(F.lit(0), more).cast("long").alias("more_runs"))


def bootstrap_mean_diff(
    runs: DataFrame, pairs: DataFrame, column: str = "latency_ms", b: int = 1000, seed: int = K.SEED
) -> DataFrame:
    """Observed difference of means and its resampled 95 % bounds, read by index; both from all runs.

    A run's place in a round is its Poisson(1) number of draws, so a round is a sum over runs. The rounds of a
    sum are one vector that tasks add up before it is shuffled, and no group has to fit in a task. Rounds that
    draw no run of a side (groups of a few runs) do not count.
    """
    values = _grouped(runs).where(F.col(column).isNotNull()).select(*K.GROUP, _prefix(seed), F.col(column).cast("double").alias("x"))
    only = lambda kind: F.first(F.when(F.col("kind") == kind, F.col("sums")), ignorenulls=True)
    per_group = (
        _round_sums(values, b, 1, ["x"])
        .groupBy(*K.GROUP)
        .agg(F.zip_with(only("x"), only("n"), lambda x, n: F.try_divide(x, n)).alias("means"))
    )
    observed = values.groupBy(*K.GROUP).agg(F.avg("x").alias("observed"))
    wide = P.both_sides(per_group.join(observed, K.GROUP), pairs, ["means", "observed"])
    diffs = F.zip_with("b_means", "c_means", lambda x, y: y - x)
    n = F.size("diffs")
    at = lambda i: F.get(F.col("diffs"), i.cast("int"))
    return wide.withColumn("diffs", F.array_sort(F.filter(diffs, lambda d: d.isNotNull()))).select(
        *K.PAIR,
        (F.col("c_observed") - F.col("b_observed")).alias("mean_diff"),
        at(F.floor(n * 0.025)).alias("ci_lower"),
        at(F.least(F.floor(n * 0.975), n - 1)).alias("ci_upper"),
    )
