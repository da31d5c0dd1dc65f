"""Benchmark passages in documents: a set join on the rarest shingle of every window, verified word by word."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import kernels
from tidemark.llm.common import keep, query, table
from tidemark.llm.units import by_bytes

WINDOW, SHINGLE = 10, 5
PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = re.compile(PATTERN)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

FILTER_BITS = 1 << 26
"""Bits of the filter that tasks hold (8 MB at every size): it only saves traffic, as what passes is verified."""

BROADCAST_WINDOWS = 50_000
"""So many distinct windows are sent to all executors at most (10 words each, so under 10 MB of usual words); more are shuffled."""

BROADCAST_BYTES = 16 << 20
SALTS = 16

_PLAIN = np.zeros(256, bool)
_PLAIN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def word_hashes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words of texts, their first and last byte + 1, and the n + 1 places where each text's words begin."""
    hashes, firsts, lasts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for begin, end in cuts(raw, at):
        part = raw[begin:end]
        full = np.zeros(len(part) + 2, bool)
        full[1:-1] = _PLAIN[part]
        new = np.zeros(len(part) + 1, bool)
        inside = at[np.searchsorted(at, begin, "right") : np.searchsorted(at, end, "left")] - begin
        new[inside] = True
        starts = np.flatnonzero(full[1:] & (~full[:-1] | new))
        ends = np.flatnonzero(full[:-1] & (~full[1:] | new))
        up, down = kernels.powers(len(part))
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(kernels.BYTE[kernels.LOWER[part]] * up, out=total[1:])
        hashes.append(kernels.mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64)))
        firsts.append(starts + begin)
        lasts.append(ends + begin)
    first = np.concatenate(firsts)
    return np.concatenate(hashes), first, np.concatenate(lasts), np.searchsorted(first, at, "left")


def cuts(raw: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int]]:
    """Spans of about ``kernels.SPAN`` bytes that end where a text or a word does."""
    begin, n = 0, len(raw)
    while begin < n:
        end = min(begin + kernels.SPAN, n)
        if end < n:
            last = int(at[np.searchsorted(at, end, "right") - 1])
            if last > begin:
                end = last
            else:
                stop = int(at[np.searchsorted(at, end, "left")])
                while end < stop and _PLAIN[raw[end]]:
                    gaps = np.flatnonzero(~_PLAIN[raw[end : min(stop, end + kernels.SPAN)]])
                    end = end + int(gaps[0]) if len(gaps) else min(stop, end + kernels.SPAN)
        yield begin, end
        begin = end


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of ``size`` consecutive words from every place on; the last places of the block have none."""
    n = max(len(hashes) - size + 1, 0)
    value = np.zeros(n, np.uint64)
    for k in range(size):
        value = value * kernels.BASE + hashes[k : k + n]
    return kernels.mix(value + np.uint64(size))


def fold(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def windows_of(items: DataFrame, id_col: str, text: str, window: int) -> DataFrame:
    """(item, words, n): every window of every item; ``words`` joined by blanks. Items without words have none."""
    words = F.regexp_extract_all(fold(F.coalesce(F.col(f"`{text}`"), F.lit(""))), F.lit(f"({PATTERN})"), F.lit(1))
    sized = items.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null")).alias("item"), words.alias("words")).where("size(words) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1)))
    each = sized.select("item", "words", F.explode(starts).alias("start")).select("item", F.slice("words", F.col("start"), window).alias("w"))
    return each.select("item", F.array_join("w", " ").alias("words"), F.size("w").alias("n")).distinct()


def member_filter(spark: SparkSession, windows: DataFrame, shingle: int, bits: int) -> np.ndarray:
    """Bits of the hashes of all shingles of all windows. At most ``bits`` / 8 bytes reach the driver, whatever the windows."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = kernels.buffers(batch.column("words"))
            hashes, _, _, begins = word_hashes(raw, at)
            sizes = np.diff(begins)
            found = [np.zeros(0, np.uint64)]
            for size in range(1, shingle + 1):
                mine = shingle_hashes(hashes, size)
                for k in np.unique(sizes[np.minimum(sizes, shingle) == size]):
                    first = begins[:-1][sizes == k]
                    found.extend(mine[first + i] for i in range(int(k) - size + 1))
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(found) % np.uint64(bits)).astype(np.int64))], names=["place"])

    hit = windows.select("words").mapInArrow(places, "place long")
    maps = hit.groupBy(F.expr("bitmap_bucket_number(place + 1)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(place + 1))").alias("bitmap"))
    out = np.zeros(bits // 8, np.uint8)
    for row in maps.toLocalIterator():
        part = np.frombuffer(row["bitmap"], np.uint8)
        start = (row["bucket"] - 1) * len(part)
        out[start : start + len(part)] = part
    return out


SCANNED = "id {id}, n_words long, regions array<struct<start: int, words: string>>"


def regions(docs: DataFrame, present: np.ndarray, classes: dict[int, int], id_col: str, text: str) -> DataFrame:
    """One row per document: its words' number, and the ``regions`` that may hold windows: where they start, and their words joined by blanks.

    A region is a run of consecutive shingles that all pass the filter. ``classes`` has the sizes of shingles in use
    and the words of the shortest window that each serves: shorter runs cannot hold a window.
    """
    sent = docs.sparkSession.sparkContext.broadcast(present)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        modulus = np.uint64(len(bits) * 8)
        for batch in (part for whole in batches for part in by_bytes(whole, "text")):
            raw, at = kernels.buffers(batch.column("text"))
            hashes, first, last, begins = word_hashes(raw, at)
            owner = np.repeat(np.arange(len(at) - 1), np.diff(begins))
            covered = np.zeros(len(hashes) + 1, np.int64)
            for size, least in classes.items():
                value = shingle_hashes(hashes, size) % modulus
                good = (bits[(value >> np.uint64(3)).astype(np.int64)] >> (value & np.uint64(7)).astype(np.uint8)) & 1 == 1
                good &= owner[: len(good)] == owner[size - 1 : size - 1 + len(good)]
                # Runs of good places of one document; the shingles of a run span ``size`` - 1 words more.
                edge = np.flatnonzero(np.diff(np.concatenate([[False], good, [False]]).astype(np.int8)))
                starts, stops = edge[::2], edge[1::2]
                inner = np.flatnonzero(good[1:] & good[:-1] & (owner[1 : len(good)] != owner[: max(len(good) - 1, 0)])) + 1
                starts, stops = np.sort(np.concatenate([starts, inner])), np.sort(np.concatenate([stops, inner]))
                long = stops - starts + size - 1 >= least
                np.add.at(covered, starts[long], 1)
                np.add.at(covered, stops[long] + size - 1, -1)
            inside = np.cumsum(covered[:-1]) > 0
            change = np.ones(len(hashes) + 1, bool)
            change[1:-1] = (inside[1:] != inside[:-1]) | (owner[1:] != owner[:-1])
            edges = np.flatnonzero(change)
            keep_from = edges[:-1][inside[edges[:-1]]] if len(hashes) else edges[:0]
            keep_to = edges[1:][inside[edges[:-1]]] if len(hashes) else edges[:0]
            whole = raw.tobytes() if len(keep_from) else b""
            texts = [WORD.findall(whole[first[a] : last[b - 1]].decode("utf-8", "replace").translate(_FOLD)) for a, b in zip(keep_from, keep_to, strict=True)]
            rows = np.searchsorted(owner[keep_from], np.arange(len(at)), "left") if len(keep_from) else np.zeros(len(at), np.int64)
            structs = pa.StructArray.from_arrays(
                [pa.array((keep_from - begins[owner[keep_from]]).astype(np.int32), pa.int32()), pa.array([" ".join(t) for t in texts], pa.string())], names=["start", "words"]
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(np.diff(begins)), pa.ListArray.from_arrays(pa.array(rows.astype(np.int32)), structs)], names=["id", "n_words", "regions"]
            )

    narrow = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text"))
    return narrow.mapInArrow(scan, SCANNED.format(id=narrow.schema["id"].dataType.simpleString()))


_FOLD = str.maketrans(UPPER, LOWER)


def shingled(rows: DataFrame, sizes: Column, carried: Sequence[str], reach: int = 0) -> DataFrame:
    """``rows`` (array ``w`` of words) spread to their shingles of the given sizes: ``offset`` (from 0) and ``shingle``.

    With ``reach``, also ``near``: the words around, so many before and ``reach`` from the shingle's first on, and ``before``, how many of
    them are in front. A row of n words so makes n short rows, whatever n is.
    """

    def one(k: Column) -> Column:
        places = F.when(F.size("w") >= k, F.sequence(F.lit(0), F.size("w") - k)).otherwise(F.expr("cast(array() as array<int>)"))

        def at(o: Column) -> Column:
            low = F.greatest(o - reach, F.lit(0))
            near = [F.slice("w", low + 1, o - low + reach).alias("near"), (o - low).alias("before")] if reach else []
            return F.struct(o.alias("offset"), F.array_join(F.slice("w", o + 1, k), " ").alias("shingle"), *near)

        return F.transform(places, at)

    return rows.select(*carried, F.inline(F.flatten(F.transform(sizes, one))))


def few(rows: DataFrame, columns: Sequence[str]) -> bool:
    """Whether a table of windows may be sent to all executors: its rows and bytes are counted, not estimated."""
    size = rows.agg(F.count("*").alias("rows"), F.sum(sum(F.octet_length(c) for c in columns)).alias("bytes")).first()
    return size["rows"] <= BROADCAST_WINDOWS and (size["bytes"] or 0) <= BROADCAST_BYTES


def meet(places: DataFrame, windows: DataFrame, key: str, small: bool) -> DataFrame:
    """Places joined with windows. A key may stand at a third of all places: few windows are sent to them, many wait under several salts."""
    if small:
        return places.join(F.broadcast(windows), key)
    salted = places.withColumn("_salt", F.pmod(F.xxhash64("row", "at"), F.lit(SALTS)))
    return salted.join(windows.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [key, "_salt"]).drop("_salt")


def found(docs: DataFrame, items: DataFrame, id_col: str, text: str, item_col: str, item_text: str, window: int, shingle: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents (row, id, n_words), the windows found in them (row, at, n, words), and the items' windows (item, words, n)."""
    spark = docs.sparkSession
    windows = keep(windows_of(items, item_col, item_text, window), "windows")
    lengths = [r[0] for r in windows.select("n").distinct().collect()]
    classes = {size: min(n for n in lengths if min(n, shingle) == size) for size in sorted({min(n, shingle) for n in lengths})}
    present = member_filter(spark, windows, shingle, FILTER_BITS)
    scanned = keep(regions(docs, present, classes, id_col, text).withColumn("row", F.monotonically_increasing_id()), "regions")
    runs = scanned.where("size(regions) > 0").select("row", F.inline("regions")).select("row", F.col("start").alias("region"), F.split("words", " ").alias("w"))
    if not classes:
        return scanned, spark.createDataFrame([], "row long, at long, n int, words string"), windows
    size_of = F.least(F.col("n"), F.lit(shingle))
    distinct = windows.select("words", "n").distinct().withColumn("w", F.split("words", " "))
    known = shingled(distinct, F.array(size_of), ("words", "n"))
    # Rarity: how often a shingle stands in the regions of all documents. The rarest of each window is its prefix.
    sizes = F.array(*(F.lit(size) for size in classes))
    counts = shingled(runs, sizes, ()).groupBy("shingle").agg(F.count("*").alias("times"))
    rare = known.join(counts, "shingle").groupBy("words", "n").agg(F.count("*").alias("seen"), F.min(F.struct("times", "shingle", "offset")).alias("prefix"))
    # A window can occur only if every shingle of it does.
    prefixes = rare.where(F.col("seen") == F.col("n") - size_of + 1).select("words", "n", F.col("prefix.shingle").alias("shingle"), F.col("prefix.offset").alias("lead"))
    prefixes = keep(prefixes, "prefixes")
    places = shingled(runs, sizes, ("row", "region"), window).withColumn("at", (F.col("region") + F.col("offset")).cast("long"))
    pairs = meet(places, prefixes, "shingle", few(prefixes, ("words", "shingle")))
    # Position and length: the whole window must lie in the region. Then its words are compared.
    start = F.col("before") - F.col("lead")
    fits = pairs.where((start >= 0) & (start + F.col("n") <= F.size("near")))
    true = fits.where(F.array_join(F.slice("near", start + 1, F.col("n")), " ") == F.col("words"))
    return scanned, true.select("row", (F.col("at") - F.col("lead")).alias("at"), "n", "words"), windows


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE
) -> DataFrame:
    """One row per row of ``docs``: id, ``n_words``, ``spans`` (first word and end of maximal hit runs), ``n_hit`` and ``items``.

    A window is ``window`` consecutive words of an item, or all words of a shorter one; a word of a document is hit if
    it lies in an occurrence of a window. Shingles are ordered by how often they occur; a document that holds a
    window holds its rarest shingle too, so only that prefix is joined. Position and length bounds leave the places where
    the window fits, and its words are compared one by one: the result is exact, whatever hashes do.

    Texts are scanned once, where they lie. A filter of fixed size, made of all items' shingles, leaves the runs of words that
    may hold a window; only these travel. A passage that a third of all documents hold is joined with broadcast prefixes
    where these are few, else under salted keys.

    Null and empty texts have no words. Rows that repeat an id are judged one by one. Null ids stay. Items without words
    are never found; items that repeat an id are one item, those with a null id are the item ``null``; equal items are all
    reported. Extra columns are not looked at, and the names of the result are fixed. Empty tables give no row, or no hit.
    """
    scanned, hits, windows = found(docs, items, id_col, text, item_col, item_text, window, shingle)
    hits = keep(hits.distinct(), "hits")
    # A row's windows are bounded by its own words.
    longest = hits.groupBy("row", "at").agg(F.max("n").alias("n")).groupBy("row").agg(F.sort_array(F.collect_list(F.struct(F.col("at").cast("int").alias("start"), (F.col("at") + F.col("n")).cast("int").alias("end")))).alias("all"))
    first = F.element_at("all", 1)
    joined = F.aggregate(
        F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(0))),
        F.struct(F.expr("cast(array() as array<struct<start: int, end: int>>)").alias("done"), first.alias("open")),
        lambda s, x: F.when(
            x["start"] <= s["open"]["end"],
            F.struct(s["done"].alias("done"), F.struct(s["open"]["start"].alias("start"), F.greatest(s["open"]["end"], x["end"]).alias("end")).alias("open")),
        ).otherwise(F.struct(F.concat(s["done"], F.array(s["open"])).alias("done"), x.alias("open"))),
        lambda s: F.concat(s["done"], F.array(s["open"])),
    )
    spans = longest.select(F.col("row").alias("_row"), joined.alias("spans"))
    held = meet(hits.select("row", "words", "at"), windows.select("item", "words"), "words", few(windows, ("item", "words")))
    named = held.groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    wide = scanned.select("row", "id", "n_words").join(spans, F.col("row") == F.col("_row"), "left").join(named.withColumnRenamed("row", "_named"), F.col("row") == F.col("_named"), "left")
    runs = F.coalesce("spans", F.expr("cast(array() as array<struct<start: int, end: int>>)"))
    n_hit = F.aggregate(runs, F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]).cast("long"))
    return wide.select(F.col("id").alias(id_col), "n_words", runs.alias("spans"), n_hit.alias("n_hit"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"))


ORACLE = f"""
with recursive base as (select row_number() over () as rid, doc_id, list_transform(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x) as w from documents),
items as (select item_id::varchar as item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark),
windows as (
  select distinct item, array_to_string(w[s : s + {WINDOW - 1}], ' ') as words, least(len(w), {WINDOW}) as n
  from items, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) u(s) where len(w) > 0),
sizes as (select distinct n from windows),
places as (
  select rid, s, n, array_to_string(w[s : s + n - 1], ' ') as words from base, sizes, unnest(range(1, greatest(len(w) - n + 2, 1))) u(s)),
hits as (select rid, s, p.n, item from places p join windows using (words, n)),
covered as (select rid, count(distinct k) as n_hit from (select rid, unnest(range(s, s + n)) as k from hits) group by rid),
named as (
  select rid, count(*) as n_items, sha256(string_agg(item, ',' order by item)) as items_sha256 from (select distinct rid, item from hits) group by rid)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  coalesce(items_sha256, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from base left join covered using (rid) left join named using (rid)"""


@query("op13_benchmark_decontamination", ORACLE)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return judged.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
