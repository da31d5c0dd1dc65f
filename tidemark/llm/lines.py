"""Substring deduplication by hashed units: every unit but its earliest occurrence goes, with its place kept."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import units as cutting
from tidemark.llm.common import keep, query, table
from tidemark.llm.urls import LOWER, UPPER

LEAST_WORDS = 8
"""Shorter whole lines are left out of ``units`` unless a caller asks for them; ``repeats`` leaves nothing out."""

FOLD = str.maketrans(UPPER, LOWER)
BLANKS = " \t\n\v\f\r"
ONE_BLANK = str.maketrans(BLANKS, " " * len(BLANKS))
FLAT = FOLD | {k: v for k, v in ONE_BLANK.items() if k != ord("\n")}
UNITS = "id long, unit int, start int, end int, digest binary"


def units(text: str, least_words: int = LEAST_WORDS) -> Iterator[tuple[int, int, int, bytes]]:
    """(number, start, end, digest) of the lines with enough words; offsets in code points, without the line break.

    Normalised: A-Z in lower case, runs of blanks as one blank, none at the ends.
    """
    at = 0
    for number, line in enumerate(text.split("\n")):
        words = [w for w in line.translate(ONE_BLANK).split(" ") if w]
        if len(words) >= least_words:
            yield number, at, at + len(line), hashlib.md5(" ".join(words).translate(FOLD).encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()
        at += len(line) + 1


def sentences(text: str, least_words: int = LEAST_WORDS) -> Iterator[tuple[int, int, int, bytes]]:
    """``units`` with lines cut further, after each . ! ? that a blank follows; the blanks go with what is behind them.

    These pieces tile a line, so a repeated line is found by its sentences, and so is a passage inside a longer line.
    """
    at = number = 0
    for line in text.translate(FLAT).split("\n"):
        for piece in line.replace(". ", ".\n ").replace("! ", "!\n ").replace("? ", "?\n ").split("\n"):
            words = [w for w in piece.split(" ") if w]
            if words and len(words) >= least_words:
                yield number, at, at + len(piece), hashlib.md5(" ".join(words).encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()
            number += 1
            at += len(piece)
        at += 1


def repeated_units(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS, cut: Callable = units) -> DataFrame:
    """One row per unit to remove: its document, number, offsets, and the document and unit that keep the text.

    ``cut`` tells the units of a text: ``units`` (whole lines) or ``sentences``.

    The earliest occurrence (smallest id, then first in the text) is kept, also within one document. Rows with
    a null id come last and are told apart by nothing, so of them only units that a row with an id holds go.
    Null and empty texts have no units. Rows that repeat an id are one document for ranking: a unit number
    that both hold is kept in both. Texts are scanned once; digests are grouped with partial aggregation, and
    the winners are a table of their own, so a line that a third of all documents hold is split like any
    skewed join.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: tuple[list, ...] = ([], [], [], [], [])
            for i, value in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for unit in cut(value or "", least_words):
                    for column, v in zip(columns, (i, *unit), strict=True):
                        column.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["id", "unit", "start", "end", "digest"])

    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    found = keep(narrow.mapInArrow(split, UNITS), "units")
    winners = found.where("id is not null").groupBy("digest").agg(F.min(F.struct("id", "unit")).alias("kept"), F.count("*").alias("copies"))
    nameless = found.where("id is null").groupBy("digest").agg(F.count("*").alias("loose"))
    winners = keep(winners.join(nameless, "digest", "left").where("copies > 1 or loose > 0").select("digest", "kept"), "winners")
    gone = found.join(winners, "digest").where("id is null or struct(id, unit) > kept")
    return gone.select(
        F.col("id").alias(id_col), "unit", "start", "end", F.col("kept.id").alias("kept_in"), F.col("kept.unit").alias("kept_unit")
    )


def without_units(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the given units (whole lines) cut out of their texts; the other lines keep their order."""
    by_doc = keep(gone.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.sort_array(F.collect_set("unit")).alias("_gone")), "gone")
    wide = docs.alias("d").join(by_doc, F.col(f"d.`{id_col}`") == F.col("_id"), "left")
    lines = F.filter(F.split(F.col(f"d.`{text}`"), "\n", -1), lambda line, i: ~F.array_contains(F.col("_gone"), i))
    cut = F.when(F.col("_gone").isNull(), F.col(f"d.`{text}`")).otherwise(F.array_join(lines, "\n"))
    return wide.select(*(cut.alias(c) if c == text else F.col(f"d.`{c}`") for c in docs.columns))


def without_sentences(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the given sentences cut out of their texts; line breaks stay. In rows that repeat an id, only what is a unit there too."""
    by_doc = keep(gone.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.collect_set(F.struct("start", "end")).alias("_gone")), "gone")
    wide = docs.alias("d").join(by_doc, F.col(f"d.`{id_col}`") == F.col("_id"), "left").select("d.*", "_gone")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for value, spans in zip(batch.column(text).to_pylist(), batch.column("_gone").to_pylist(), strict=True):
                if value and spans:
                    out, at, own = [], 0, {(s["start"], s["end"]) for s in spans}
                    for _, start, end, _ in sentences(value, 1):
                        if (start, end) in own:
                            out.append(value[at:start])
                            at = end
                    value = "".join([*out, value[at:]])
                texts.append(value)
            at = batch.schema.get_field_index(text)
            yield batch.set_column(at, text, pa.array(texts, batch.schema.field(text).type)).drop_columns(["_gone"])

    return wide.mapInArrow(apply, docs.schema)


ORACLE = f"""
with lines as (
  select doc_id, unnest(range(len(l))) as unit, unnest(l) as line
  from (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents)),
placed as (
  select doc_id, unit, line, sum(length(line) + 1) over (partition by doc_id order by unit) - length(line) - 1 as start,
    list_filter(regexp_split_to_array(line, '[ \\t\\v\\f\\r]+'), lambda x: x <> '') as words from lines),
units as (
  select doc_id, unit, start, start + length(line) as stop,
    md5(translate(array_to_string(words, ' '), '{UPPER}', '{LOWER}')) as digest
  from placed where len(words) >= {LEAST_WORDS}),
ranked as (
  select *, first_value(doc_id) over w as kept_in, first_value(unit) over w as kept_unit, row_number() over w as n
  from units window w as (partition by digest order by doc_id, unit))
select doc_id, unit::int as unit, start::int as start, stop::int as "end", kept_in, kept_unit::int as kept_unit from ranked where n > 1"""


CUT = "id {id}, tie long, units array<struct<start: int, end: int, digest: binary>>"


def repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", reach: int = cutting.REACH) -> DataFrame:
    """One row per row of ``docs``: id, ``n_units``, ``removed`` (start and end of the units to remove, code points, in order) and ``kept`` (digests of the others).

    Units are lines and sentences, cut where the words around decide it: a cut is the strongest of the ``reach`` gaps
    between words on either side, ends of lines before ends of sentences before others. So short lines and sentences are joined to units of
    more than ``reach`` words (a text that short is one unit), long ones are cut, and a passage within a longer
    line makes the same units wherever it stands. Units tile all words; nothing is left out.

    The earliest unit of a digest is kept: smallest id (null last), within an id by the text's MD5, then the first in the text, also
    within one document. Of rows equal in id and text one comes first. Null and empty texts have no units. Extra columns
    are not looked at, and the names of the result are fixed. An empty table gives no rows.

    Texts are scanned once; a digest that a third of all documents hold is counted where it is read before it travels.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in cutting.by_bytes(whole, "text")):
            texts = batch.column("text")
            owner, starts, ends, digests = cutting.units(texts, reach)
            ties = [int.from_bytes(hashlib.md5(t or b"", usedforsecurity=False).digest()[:7], "big") for t in texts.cast(pa.binary()).to_pylist()]
            structs = pa.StructArray.from_arrays(
                [pa.array(starts.astype("i4")), pa.array(ends.astype("i4")), pa.array(digests, pa.binary())], names=["start", "end", "digest"]
            )
            places = pa.array(np.searchsorted(owner, np.arange(len(texts) + 1)).astype("i4"))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(ties, pa.int64()), pa.ListArray.from_arrays(places, structs)], names=["id", "tie", "units"])

    narrow = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text"))
    scanned = narrow.mapInArrow(scan, CUT.format(id=narrow.schema["id"].dataType.simpleString()))
    scanned = keep(scanned.withColumn("row", F.monotonically_increasing_id()), "units")
    place = F.struct(F.isnull("id").alias("nameless"), "id", "tie", "row", "unit")
    spread = scanned.select("id", "tie", "row", F.posexplode("units").alias("unit", "u")).select(F.col("u.digest").alias("digest"), place.alias("place"))
    winners = keep(spread.groupBy("digest").agg(F.min("place").alias("kept"), F.count("*").alias("copies")).where("copies > 1").drop("copies"), "winners")
    gone = spread.join(winners, "digest").where("place > kept")
    by_row = gone.groupBy(F.col("place.row").alias("_row")).agg(F.sort_array(F.collect_list("place.unit")).alias("_gone"))
    wide = scanned.join(by_row, F.col("row") == F.col("_row"), "left")
    none = F.expr("cast(array() as array<int>)")
    all_units = F.when(F.size("units") > 0, F.sequence(F.lit(0), F.size("units") - 1)).otherwise(none)
    cut = F.coalesce("_gone", none)
    unit = lambda i: F.get(F.col("units"), i)
    return wide.select(
        F.col("id").alias(id_col), F.size("units").cast("long").alias("n_units"),
        F.transform(cut, lambda i: F.struct(unit(i)["start"].alias("start"), unit(i)["end"].alias("end"))).alias("removed"),
        F.transform(F.array_except(all_units, cut), lambda i: unit(i)["digest"]).alias("kept"),
    )


def without(docs: DataFrame, removed: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the spans of ``repeats`` cut out of their texts, for tables with one row per id; rows without an id stay as they are."""
    spans = removed.where(f"`{id_col}` is not null and size(removed) > 0").select(F.col(f"`{id_col}`").alias("_id"), F.col("removed").alias("_removed"))
    wide = docs.alias("d").join(spans, F.col(f"d.`{id_col}`") == F.col("_id"), "left")
    old = F.col(f"d.`{text}`")
    ends = F.concat(F.array(F.lit(0)), F.transform("_removed", lambda s: s["end"]))
    starts = F.concat(F.transform("_removed", lambda s: s["start"]), F.array(F.length(old)))
    new = F.array_join(F.zip_with(ends, starts, lambda a, b: F.substr(old, a + 1, b - a)), "")
    return wide.select(*(F.when(F.col("_removed").isNull(), old).otherwise(new).alias(c) if c == text else F.col(f"d.`{c}`") for c in docs.columns))


UNIT_ORACLE = rf"""
with rows as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
lines as (select rid, unnest(range(len(l))) as ln, unnest(l) as line from (select rid, string_split(text, chr(10)) as l from rows)),
placed as (select *, sum(length(line) + 1) over (partition by rid order by ln) - length(line) - 1 as "at" from lines),
pieces as (
  select rid, ln, "at", unnest(range(len(p))) as k, unnest(p) as piece
  from (select *, string_split(translate(line, chr(9) || chr(11) || chr(12) || chr(13), '    '), ' ') as p from placed)),
words as (
  select rid, ln, lower_w as w, "at" + before as s, "at" + before + length(piece) as e, row_number() over (partition by rid order by ln, k) as i, count(*) over (partition by rid) as n,
    ('0x' || right('00000000' || hex(encode(lower_w)), 8))::bigint as tail, ('0x' || left(hex(encode(lower_w)) || '00000000', 8))::bigint as head
  from (select *, sum(length(piece) + 1) over (partition by rid, ln order by k) - length(piece) - 1 as before,
    translate(piece, '{UPPER}', '{LOWER}') as lower_w from pieces) where piece <> ''),
gaps as (
  select *, (case when ln > lag(ln) over o then {cutting.LINE} when lag(right(w, 1)) over o in ('.', '!', '?') then {cutting.SENTENCE} else {cutting.WITHIN} end::bigint << {cutting.RANK_BITS})
    + (lag(tail) over o * {cutting.BEFORE} + head * {cutting.BEHIND}) % {cutting.PRIME} as v
  from words window o as (partition by rid order by i)),
marked as (
  select *, i > {cutting.REACH + 1} and i + {cutting.REACH} <= n
    and v > max(v) over (partition by rid order by i rows between {cutting.REACH} preceding and 1 preceding)
    and v >= max(v) over (partition by rid order by i rows between 1 following and {cutting.REACH} following) as cut from gaps),
numbered as (select *, count(*) filter (cut) over (partition by rid order by i) as u from marked),
sized as (select *, row_number() over (partition by rid, u order by i) - 1 as p, count(*) over (partition by rid, u) as size from numbered),
units as (
  select rid, u, sub, min(s) as s, max(e) as e, md5(string_agg(w, ' ' order by i)) as digest
  from (select *, case when size > {4 * cutting.REACH} then least(p // {2 * cutting.REACH}, size // {2 * cutting.REACH} - 1) else 0 end as sub from sized) group by rid, u, sub),
ranked as (
  select r.rid, s, e, digest, row_number() over (partition by digest order by doc_id nulls last, md5(text), r.rid, u, sub) > 1 as gone from units join rows r using (rid))
select doc_id, count(digest) as n_units, count(*) filter (gone) as n_removed,
  coalesce(string_agg(s::bigint || ':' || e::bigint, ',' order by s) filter (gone), '') as removed,
  md5(coalesce(string_agg(digest, '' order by s) filter (not gone), '')) as kept_md5
from rows left join ranked using (rid) group by rid, doc_id"""


@query("op6_substring_dedup", UNIT_ORACLE)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats(table(spark, sf_dir, "documents"))
    spans = F.transform("removed", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string")))
    kept = F.array_join(F.transform("kept", lambda d: F.lower(F.hex(d))), "")
    return found.select(
        "doc_id", "n_units", F.size("removed").cast("long").alias("n_removed"), F.array_join(spans, ",").alias("removed"), F.md5(kept.cast("binary")).alias("kept_md5")
    )


@query("op6_line_dedup", ORACLE)
def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The removed units themselves where only whole lines of ``LEAST_WORDS`` words or more are units."""
    return repeated_units(table(spark, sf_dir, "documents"))


@query("op6_sentence_dedup")
def op6_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The removed units themselves where every sentence is a unit, of one word too."""
    return repeated_units(table(spark, sf_dir, "documents"), least_words=1, cut=sentences)
