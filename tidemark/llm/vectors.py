"""Near-duplicate vectors by collision counting over one-dimensional projections."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import connected_components, keep, query, table

COSINE = 0.93
PROJECTIONS, SEED = 48, 5
WINDOW = 1.2
"""Half width of the window around a query's projection, as a multiple of the distance of two vectors just similar enough."""
MISS = 1e-6
"""A pair just similar enough passes the count with at least this probability missing; nearer pairs miss less."""
BLOCK = 1024


def windows(cosine: float, m: int = PROJECTIONS, miss: float = MISS) -> tuple[float, int]:
    """(half width, least count of collisions).

    Projections on independent normal directions of unit vectors at distance d differ by a normal variable of
    deviation d. So the collisions of a pair are binomial, and the least count is the largest that a pair at
    ``cosine`` itself reaches with probability 1 - ``miss``.
    """
    distance = math.sqrt(2 - 2 * cosine)
    p = math.erf(WINDOW / math.sqrt(2))
    below, count = 0.0, 0
    while (below := below + math.comb(m, count) * p**count * (1 - p) ** (m - count)) <= miss:
        count += 1
    return WINDOW * distance, count


def unit_rows(vectors: list) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows and which of the vectors have one: not null, not empty or zero, all components finite."""
    size = max((len(v) for v in vectors if v is not None), default=0)
    out, good = np.zeros((len(vectors), size)), np.zeros(len(vectors), bool)
    for i, v in enumerate(vectors):
        if v is None or len(v) != size or any(x is None for x in v):
            continue
        row = np.asarray(v, float)
        if np.isfinite(row).all() and (top := np.abs(row).max(initial=0.0)) > 0:
            row = row / top  # lengths of very large and very small vectors stay finite
            out[i], good[i] = row / math.sqrt(row @ row), True
    return out, good


def directions(size: int, m: int = PROJECTIONS) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((size, m))


def candidates(left: np.ndarray, right: np.ndarray, half: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of two tables of projections that lie in each other's window at least ``least`` times.

    Each projection of ``right`` is sorted; the window of every query is then a range of ranks in it.
    """
    count = np.zeros((len(left), len(right)), np.uint8)
    for j in range(left.shape[1]):
        order = np.argsort(right[:, j])
        ranked = right[order, j]
        low, high = np.searchsorted(ranked, left[:, j] - half, "left"), np.searchsorted(ranked, left[:, j] + half, "right")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        count += (rank >= low[:, None].astype(np.int32)) & (rank < high[:, None].astype(np.int32))
    return np.nonzero(count >= least)


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For n nodes the smallest node that links lead to."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        if (root == before).all() and (root[a] == root[b]).all():
            break
    return root


def near_vectors(rows: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row per row: id, ``n_links``, ``component_id`` and ``kept``.

    Rows with equal labels, not null, link when the cosine of their vectors in double precision is at least
    ``cosine``; every link reported is verified. Null, empty or zero vectors and such with null or non-finite
    components link with nothing. Vectors of different lengths link with nothing as well. Rows that repeat an
    id are rows of their own for ``n_links`` and one node for components; rows with a null id link, and their
    component is named by the others (null if there are none). Extra columns are not looked at.

    Equal vectors of a label are one row with a count. The rest of a label is dealt into blocks of about
    ``BLOCK`` rows, and each pair of blocks is a task's row: projections are sorted, collisions of windows
    counted for every pair, and the pairs that pass the count verified. A task returns sums of links and a
    spanning forest, never pairs, so a group of n near copies gives at most n edges per pair of blocks.
    Work within a label grows with the square of its rows (as counting does: a window on one normal direction
    holds a fixed share of the label); it is split over as many tasks as there are pairs of blocks.
    """
    half, least = windows(cosine)
    usable = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.col(label).cast("string").alias("label"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists("v", lambda x: x != 0)
    usable = keep(usable.withColumn("fine", F.coalesce(fine, F.lit(False))).withColumn("point", F.when(F.col("fine"), F.xxhash64("label", "v"))), "usable")
    points = usable.where("fine").groupBy("label", "point").agg(F.first("v").alias("v"), F.count("*").alias("copies"))
    points = keep(points, "points")
    counts = keep(points.groupBy("label").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "blocks")
    dealt = points.join(counts, "label").withColumn("block", F.pmod(F.col("point"), F.col("blocks")).cast("int"))

    def block(t: pa.Table) -> pa.Table:
        out: dict[str, list] = {k: [] for k in ("label", "blocks", "block", "size", "points", "copies", "units")}
        lengths = np.array([len(v) for v in t.column("v").to_pylist()])
        for size in np.unique(lengths):  # vectors of other lengths meet nothing here
            own = t.filter(pa.array(lengths == size))
            units, _ = unit_rows(own.column("v").to_pylist())
            out["label"].append(own.column("label")[0].as_py())
            out["blocks"].append(own.column("blocks")[0].as_py())
            out["block"].append(own.column("block")[0].as_py())
            out["size"].append(int(size))
            out["points"].append(own.column("point").to_numpy().astype("<i8").tobytes())
            out["copies"].append(own.column("copies").to_numpy().astype("<i8").tobytes())
            out["units"].append(units.astype("<f8").tobytes())
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.table({k: pa.array(v, kind) for (k, v), kind in zip(out.items(), kinds, strict=True)})

    kind = "label string, blocks int, block int, size int, points binary, copies binary, units binary"
    blocks = keep(dealt.groupBy("label", "block").applyInArrow(block, kind), "packed")

    def unpacked(batch: dict, i: int, side: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        points = np.frombuffer(batch[f"points_{side}"][i], "<i8")
        return points, np.frombuffer(batch[f"copies_{side}"][i], "<i8"), np.frombuffer(batch[f"units_{side}"][i], "<f8").reshape(len(points), -1)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in batches:
            batch = record.to_pydict()
            for i in range(record.num_rows):
                same = batch["block_a"][i] == batch["block_b"][i]
                pa_, ca, ua = unpacked(batch, i, "a")
                pb, cb, ub = unpacked(batch, i, "b")
                g = directions(ua.shape[1])
                a, b = candidates(ua @ g, ub @ g, half, least)
                if same:
                    a, b = a[a < b], b[a < b]
                # An equality of rounded sums decides at the border: single products, in double precision.
                close = np.concatenate([np.einsum("ij,ij->i", ua[a[k : k + 65536]], ub[b[k : k + 65536]]) for k in range(0, len(a), 65536)] or [np.zeros(0)]) >= cosine
                a, b = a[close], b[close]
                links_a, links_b = np.bincount(a, weights=cb[b], minlength=len(pa_)), np.bincount(b, weights=ca[a], minlength=len(pb))
                root = forest(a, b + (0 if same else len(pa_)), len(pa_) + (0 if same else len(pb)))
                nodes = pa_ if same else np.concatenate([pa_, pb])
                links = links_a + links_b if same else np.concatenate([links_a, links_b])
                use = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes[use]), pa.array(links[use].astype(np.int64)), pa.array(nodes[root[use]])], names=["point", "links", "root"]
                )

    side = lambda s, name: blocks.select("label", "size", *(F.col(c).alias(f"{c}_{s}") for c in ("block", "points", "copies", "units")), *name)
    # Partners of a block by number: rows of the table of blocks, never of vectors.
    onward = side("a", ["blocks"]).withColumn("block_b", F.explode(F.sequence("block_a", F.col("blocks") - 1))).drop("blocks")
    tiles = onward.join(side("b", []), ["label", "size", "block_b"]).repartition("label", "block_a", "block_b")
    found = keep(tiles.mapInArrow(compare, "point long, links long, root long"), "found")
    links = found.groupBy("point").agg(F.sum("links").alias("links"))
    roots = connected_components(found.where("point != root").select(F.col("point").alias("a"), F.col("root").alias("b")))
    stats = points.select("point", "copies").join(links, "point", "left").join(roots.withColumnRenamed("node", "point"), "point", "left")
    stats = keep(stats.select("point", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "point").alias("root")), "stats")
    rooted = usable.where("fine and id is not null").select("id", "point").join(stats.select("point", "root"), "point")
    names = keep(rooted.groupBy("root").agg(F.min("id").alias("component_id")), "names")
    named = keep(stats.join(names, "root", "left").select("point", "n_links", "component_id"), "named")
    out = usable.select("id", "point").join(named, "point", "left")
    component = F.coalesce("component_id", F.when(F.col("point").isNull(), F.col("id")))
    return out.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept")
    )


@query("op10_embedding_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
