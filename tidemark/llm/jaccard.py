"""Jaccard join of documents by word shingles as an exact metric-space join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import kernels
from tidemark.llm.common import connected_components, keep, query, table
from tidemark.llm.exchange import Exchange, parts

WORDS, PERCENT = 5, 75
BIN = 0.05
"""Points of a region are put in bins of this width by their distance to the pivot; windows are ranges of bins."""
BLOCK_HASHES = 150_000
"""Blocks of points that a task compares hold about so many hashes (one point at least)."""


def shingle_kernel(n_words: int):
    def kernel(raw: np.ndarray, at: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return kernels.shingles(*kernels.words(raw, at, lower=True), n_words)

    return kernel


def sets(docs: DataFrame, id_col: str, text: str, n_words: int, percent: int) -> DataFrame:
    """One row per row: uid (of id and text), id, n_shingles, two sums that name the set, and for documents that can
    have a partner at all the hashes other documents hold (sorted) and the prefix.

    Partners share at least ``percent`` % of either set. So a document of whose shingles more than the rest are
    its own has no partner, and any two partners share one of the first n - ceil(n * percent / 100) + 1
    shingles, in any order common to all; here the rarest go first.
    """
    exchange, kernel = Exchange(docs, id_col, text), shingle_kernel(n_words)

    def finish(batch: pa.Table, classes) -> pa.Table:
        raw, at, ids = parts(batch)
        hashes, owners = kernel(raw, at, ids)
        order = np.lexsort((hashes, owners))
        hashes, owners = hashes[order], owners[order]
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])
        hashes, owners = hashes[new], owners[new]
        rank = classes(hashes)
        n = len(at) - 1
        begin = np.searchsorted(owners, np.arange(n + 1))
        sizes, shared = np.diff(begin), np.bincount(owners, weights=rank > 0, minlength=n).astype(np.int64)
        able = (sizes > 0) & (100 * shared >= percent * sizes)
        mixed = kernels.mix(hashes ^ np.uint64(0x5851F42D4C957F2D))
        total = np.zeros((2, len(hashes) + 1), np.uint64)
        np.cumsum(hashes, out=total[0, 1:])
        np.cumsum(mixed, out=total[1, 1:])
        names = total[:, begin[1:]] - total[:, begin[:-1]]
        prefixes, packed = [None] * n, [None] * n
        for i in np.flatnonzero(able):
            own, cls = hashes[begin[i] : begin[i + 1]], rank[begin[i] : begin[i + 1]]
            own, cls = own[cls > 0], cls[cls > 0]
            least = -(-percent * int(sizes[i]) // 100)
            length = int(sizes[i]) - least + 1 - int(sizes[i] - shared[i])
            prefixes[i] = own[np.lexsort((own, cls))[:length]].view(np.int64)
            packed[i] = own.tobytes()
        content = content_hashes(raw, at)
        uid = kernels.mix(content ^ kernels.mix(ids.view(np.uint64)))
        return pa.table(
            {
                "uid": pa.array(uid.view(np.int64)),
                "content": pa.array(content.view(np.int64)),
                "id": batch.column("id"),
                "n": pa.array(sizes.astype(np.int64)),
                "name_a": pa.array(names[0].view(np.int64)),
                "name_b": pa.array(names[1].view(np.int64)),
                "centre": pa.array(np.bincount(owners, weights=rank, minlength=n) / np.maximum(sizes, 1)),
                "prefix": pa.array(prefixes, pa.list_(pa.int64())),
                "packed": pa.array(packed, pa.binary()),
            }
        )

    return exchange.told(kernel, finish, "uid long, content long, id long, n long, name_a long, name_b long, centre double, prefix array<long>, packed binary")


def content_hashes(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each text's bytes, the same as the engine's own xxhash64 of a text."""
    data = raw.tobytes()
    return np.array([xxhash.xxh64_intdigest(data[at[i] : at[i + 1]], 42) for i in range(len(at) - 1)], np.uint64)


@F.pandas_udf(T.LongType())
def common_hashes(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Size of the intersection of two packed sets."""
    for left, right in batches:
        out = np.zeros(len(left), np.int64)
        for i, (a, b) in enumerate(zip(left, right, strict=True)):
            both = np.concatenate([np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")])
            both.sort()
            out[i] = np.count_nonzero(both[1:] == both[:-1])
        yield pd.Series(out)


def measured(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with n_a, n_b, ``both``, and ``distance`` = 1 - both / union."""
    side = lambda s: members.select(F.col("uid").alias(s), F.col("n").alias(f"n_{s}"), F.col("packed").alias(f"packed_{s}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("both", common_hashes("packed_a", "packed_b"))
    return keep(joined.drop("packed_a", "packed_b").withColumn("distance", 1 - F.col("both") / (F.col("n_a") + F.col("n_b") - F.col("both"))), "measured")


def is_link(percent: int):
    return 100 * F.col("both") >= percent * (F.col("n_a") + F.col("n_b") - F.col("both"))


def common_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of two blocks."""
    index = np.concatenate(a)
    owner = np.repeat(np.arange(len(a)), [len(x) for x in a])
    order = np.argsort(index)
    index, owner = index[order], owner[order]
    out = np.zeros((len(b), len(a)), np.int64)
    for i, x in enumerate(b):
        low, high = np.searchsorted(index, x, "left"), np.searchsorted(index, x, "right")
        many = high - low
        hit = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        out[i] = np.bincount(owner[hit], minlength=len(a))
    return out.T


def new_links(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(a, b) of roots that a pair of points of two blocks links; of equal pairs one."""
    for record in batches:
        for row in record.to_pylist():
            left, right = ([(p["root"], p["n"], np.frombuffer(p["packed"], "<u8")) for p in row[side]] for side in ("some", "every"))
            roots_a, roots_b = np.array([p[0] for p in left]), np.array([p[0] for p in right])
            if len(np.unique(np.concatenate([roots_a, roots_b]))) < 2:
                continue
            both = common_counts([p[2] for p in left], [p[2] for p in right])
            union = np.array([p[1] for p in left])[:, None] + np.array([p[1] for p in right])[None, :] - both
            i, j = np.nonzero((100 * both >= percent * union) & (roots_a[:, None] != roots_b[None, :]))
            found = np.unique(np.sort(np.column_stack([roots_a[i], roots_b[j]]), axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0], pa.int64()), pa.array(found[:, 1], pa.int64())], names=["a", "b"])


def join(docs: DataFrame, id_col: str = "doc_id", text: str = "text", n_words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: id, ``n_shingles``, ``component_id`` and ``content`` (a hash of the text).

    Two documents link when their Jaccard distance is at most r = 1 - percent / 100. The distance is a metric, and:

    1. Documents that hold one set are one point.
    2. A point belongs to the cells of its rarest shingles, as many as it needs so that partners meet in one of
       them (``sets``). Each cell takes the most central of its points (whose shingles most others hold) as
       pivot; cells with one pivot are its region. So partners meet in a region, and a point measures its
       distance to the pivots of its regions only. (Voronoi regions of freely chosen pivots would not do: random
       texts have distance 1 to all of them, so every window would hold every point.)
    3. Points within r of a pivot are linked to it, so n near copies cost n measurements, not n * n.
    4. In a region that holds points not linked yet, these are joined with the points in their window: by the
       triangle inequality partners' distances to the pivot differ by r at most. Points lie in bins by that
       distance, bins are cut into blocks, and a task compares two blocks and returns links between
       components, never pairs of points. This is exact: nothing is left out but what the inequality excludes
       and what is linked already.
    5. Links make components; the smallest id names each.

    Null and empty texts have no shingles and are linked with nothing. Rows that repeat an id with one text are one
    document; with different texts they are points of their own. A row with a null id takes part, but names no
    component; if all of its component lack ids, ``component_id`` is null. Extra columns are not looked at.
    """
    radius = 1 - percent / 100
    every = keep(sets(docs, id_col, text, n_words, percent), "sets")
    able = every.where("packed is not null")
    points = keep(able.groupBy("n", "name_a", "name_b").agg(F.min("uid").alias("point")), "points")
    copies = keep(able.select("uid", "n", "name_a", "name_b").distinct().join(points, ["n", "name_a", "name_b"]).select("uid", "point"), "copies")
    members = able.join(points.select(F.col("point").alias("uid")), "uid", "left_semi").dropDuplicates(["uid"])
    members = keep(members.select("uid", "n", "centre", "prefix", "packed"), "members")
    keys = keep(members.select("uid", "centre", F.explode("prefix").alias("key")), "keys")

    pivots = keys.groupBy("key").agg(F.max_by("uid", F.struct("centre", "uid")).alias("pivot"), F.min("uid").alias("lo"), F.max("uid").alias("hi"))
    pivots = keep(pivots.where("lo != hi").select("key", "pivot"), "pivots")
    belongs = keep(keys.join(pivots, "key").where("uid != pivot").select(F.col("uid").alias("a"), F.col("pivot").alias("b")).distinct(), "belongs")
    near = measured(belongs, members)
    roots = connected_components(near.where(is_link(percent)).select("a", "b"))
    rooted = keep(members.select("uid").join(roots.withColumnRenamed("node", "uid"), "uid", "left").select("uid", F.coalesce("root", "uid").alias("root")), "rooted")

    in_region = near.select(F.col("b").alias("region"), F.col("a").alias("uid"), F.col("n_a").alias("n"), "distance")
    homes = rooted.select(F.col("uid").alias("region"), F.col("root").alias("home"))
    in_region = keep(in_region.join(rooted, "uid").join(homes, "region").withColumn("open", F.col("root") != F.col("home")), "regions")
    open_regions = keep(in_region.where("open").groupBy("region").agg(F.min("distance").alias("low"), F.max("distance").alias("high")), "open")
    # The pivot was measured against all: it needs no place in its region any more.
    placed = in_region.join(open_regions, "region").where((F.col("distance") >= F.col("low") - radius - BIN) & (F.col("distance") <= F.col("high") + radius + BIN))
    placed = placed.select("region", "uid", "n", "root", "open", F.floor(F.col("distance") / BIN).cast("int").alias("bin"))
    cuts = keep(placed.groupBy("region", "bin", "open").agg(F.ceil(F.sum("n") / BLOCK_HASHES).cast("int").alias("cuts")), "cuts")
    placed = placed.join(cuts, ["region", "bin", "open"]).withColumn("block", F.pmod(F.xxhash64("uid"), F.col("cuts")))
    blocks = placed.join(members.select("uid", "packed"), "uid").groupBy("region", "bin", "open", "block").agg(F.collect_list(F.struct("root", "n", "packed")).alias("points"))
    blocks = keep(blocks, "blocks")
    reach = int(np.ceil(radius / BIN)) + 1
    some = blocks.where("open").select("region", F.col("points").alias("some"), F.explode(F.sequence(F.col("bin") - reach, F.col("bin") + reach)).alias("bin"))
    tiles = some.join(blocks.select("region", "bin", F.col("points").alias("every")), ["region", "bin"])
    found = keep(tiles.select("some", "every").mapInArrow(lambda it: new_links(it, percent), "a long, b long"), "found")
    above = connected_components(found).select(F.col("node").alias("root"), F.col("root").alias("top"))
    whole = rooted.join(above, "root", "left").select(F.col("uid").alias("point"), F.coalesce("top", "root").alias("top"))
    placed = keep(copies.join(whole, "point").select("uid", "top"), "placed")
    tops = keep(every.select("uid", "id").where("id is not null").join(placed, "uid").groupBy("top").agg(F.min("id").alias("component_id")), "tops")
    named = keep(placed.join(tops, "top").select("uid", "component_id"), "named")
    return every.join(named, "uid", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), "content"
    )


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The row with the smallest id of each component, with all its columns; rows that repeat it go too.

    Rows are told apart by id and text, so of two texts under one id each is judged for itself. Rows with a
    null id cannot be named and all stay.
    """
    joined = keep(join(docs, id_col, text).where(F.col(id_col).isNotNull()), "joined")
    gone = keep(joined.where(F.col("component_id") != F.col(id_col)).select(F.col(id_col).alias("_id"), F.col("content").alias("_content")).distinct(), "gone")
    own = F.xxhash64(F.coalesce(F.col(f"d.`{text}`"), F.lit("")))
    # The list of copies grows with the corpus: a shuffle at every size, never a broadcast.
    kept = docs.alias("d").join(gone.hint("merge"), (F.col(f"d.`{id_col}`") == F.col("_id")) & (own == F.col("_content")), "left_anti")
    again = joined.where(F.col("component_id") == F.col(id_col)).groupBy(id_col, "content").agg(F.count("*").alias("n")).where("n > 1")
    again = keep(again.select(F.col(id_col).alias("_id")).distinct(), "again")
    if again.isEmpty():
        return kept
    several = kept.join(again, F.col(id_col) == F.col("_id"), "left_semi").dropDuplicates([id_col, text])
    return kept.join(again, F.col(id_col) == F.col("_id"), "left_anti").unionByName(several)


@query("op3_jaccard_join")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents")).drop("content")
