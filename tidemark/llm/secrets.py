"""Secrets in texts: fixed kinds, further candidates judged by who owns them across the corpus, and redaction."""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import keep, query, table

# The kinds of the contract, each with the least length of what it must hold.
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 8, "access": 16, "hex": 32}
KINDS = ("assign", "access", "hex", "pem", "jwt", "random")

HEX_RUNS = re.compile(r"[0-9a-f]{32,}")
PEM = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*-----END [A-Z ]*PRIVATE KEY-----")
JWT = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
RANDOM = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
DIGIT, LETTER = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]")
BITS = 3.2
"""A run of 20 characters or more with a digit and a letter is a candidate from this entropy a character on."""

Span = tuple[int, int, str]


def entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values())


def base_spans(text: str) -> list[Span]:
    """(start, end, kind), by start and then kind. A match that is too short is dropped, but still used up its characters."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [(m.start(), m.end(), "hex") for m in HEX_RUNS.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def more_spans(text: str, base: list[Span]) -> list[Span]:
    """Further candidates: key blocks, signed tokens, random-looking runs. They may overlap other spans; those wholly inside one are left out."""
    taken, found = sorted(base), []
    for kind, pattern in (("pem", PEM), ("jwt", JWT), ("random", RANDOM)):
        # Spans of one pattern do not overlap, so only earlier ones can hold a match: the farthest end among those that start before.
        starts, farthest = [s[0] for s in taken], list(itertools.accumulate((s[1] for s in taken), max))
        mine = []
        for m in pattern.finditer(text):
            run = m.group()
            if kind == "random" and not (DIGIT.search(run) and LETTER.search(run) and entropy(run) >= BITS):
                continue
            before = bisect.bisect_right(starts, m.start())
            if not before or farthest[before - 1] < m.end():
                mine.append((m.start(), m.end(), kind))
        found += mine
        taken = sorted(taken + mine)
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def joined(spans: Iterable[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def value_of(text: str, span: Span) -> bytes:
    """The digest by which a candidate is counted: of the value alone, without the name in front of it."""
    start, end, kind = span
    value = ASSIGN.match(text, start).group(2) if kind == "assign" else text[start:end]
    return hashlib.blake2b(value.encode("utf-8", "replace"), digest_size=16).digest()


SPAN_TYPE = "array<struct<start:int,end:int,kind:string,digest:binary>>"
SCANNED = f"id long, content string, repository string, owner string, n_assign long, n_access long, n_hex long, base_sha256 string, base {SPAN_TYPE}, more {SPAN_TYPE}"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("digest", pa.binary())]))
    for batch in batches:
        counts, shas, bases, mores = {k: [] for k in LEAST}, [], [], []
        for text in batch.column("text").to_pylist():
            text = text or ""
            base = base_spans(text)
            more = more_spans(text, base)
            kinds = Counter(kind for _, _, kind in base)
            for kind, column in counts.items():
                column.append(kinds[kind])
            shas.append(hashlib.sha256(joined(base).encode()).hexdigest())
            for spans, column in ((base, bases), (more, mores)):
                column.append([{"start": s[0], "end": s[1], "kind": s[2], "digest": value_of(text, s)} for s in spans])
        yield pa.RecordBatch.from_arrays(
            [batch.column(c) for c in ("id", "content", "repository", "owner")]
            + [pa.array(c, pa.int64()) for c in counts.values()]
            + [pa.array(shas, pa.string()), pa.array(bases, span), pa.array(mores, span)],
            names=["id", "content", "repository", "owner", "n_assign", "n_access", "n_hex", "base_sha256", "base", "more"],
        )


GROUP = "concat('group', cast(try_cast(regexp_extract(source, '([0-9]+)', 1) as int) % 4 as string))"
"""The owner of a source: documents name none, so sources of one group count as repositories of one owner."""

MAX_OWNERS, MAX_REPOSITORIES = 1, 2


def digests(base: str = "base", more: str = "more") -> Column:
    """The distinct values of a row."""
    return F.array_distinct(F.transform(F.concat(base, more), lambda s: s["digest"]))


def ownership(scanned: DataFrame, max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """(digest, n_documents, n_repositories, n_owners, live) of every candidate of the corpus.

    ``live``: at most ``max_owners`` owners hold it, in however many repositories of theirs, or at most
    ``max_repositories`` repositories; what is held more widely is a copied example. Counts are
    exact and pre-aggregated per (digest, repository, owner), so one example that a third of all documents
    hold reaches no task in full. A null owner or repository counts as one of the name ''.
    """
    each = scanned.select("owner", "repository", F.explode(digests()).alias("digest"))
    each = each.select(F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce("repository", F.lit("")).alias("repository"), "digest")
    pairs = each.groupBy("digest", "repository", "owner").agg(F.count("*").alias("n"))
    counted = pairs.groupBy("digest").agg(
        F.sum("n").alias("n_documents"), F.countDistinct("repository").alias("n_repositories"), F.countDistinct("owner").alias("n_owners")
    )
    return counted.withColumn("live", (F.col("n_owners") <= max_owners) | (F.col("n_repositories") <= max_repositories))


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", repository: str = "source", owner: Column | None = None, max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """One row per row of ``docs``: id, base counts and digest, and ``spans`` as text and as array.

    Base spans always stay. A further candidate is added where its value is live (``ownership``) in the whole
    corpus. ``owner`` is the repository itself where none is given. ``n_live`` and ``n_examples`` count all spans of the
    row by that verdict. Null and empty texts have no spans; rows with a null or repeated id each keep their row, and their
    verdicts: these reach a row by its place in the written scan, not by its id. ``content`` names the text. Extra
    columns are not looked at, and the names of the result are fixed. The texts are read once; only spans move.
    """
    value = F.col(f"`{text}`")
    narrow = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), value.alias("text"), F.md5(value.cast("binary")).alias("content"),
        F.col(f"`{repository}`").cast("string").alias("repository"), (F.col(f"`{repository}`") if owner is None else owner).cast("string").alias("owner"),
    )
    scanned = keep(narrow.mapInArrow(_scan, SCANNED).withColumn("row", F.monotonically_increasing_id()), "scanned")
    owned = keep(ownership(scanned, max_owners, max_repositories), "owned")
    each = scanned.where(F.size("base") + F.size("more") > 0).select("row", F.explode(digests()).alias("digest"))
    live = each.join(owned.where("live").select("digest"), "digest").groupBy("row").agg(F.collect_set("digest").alias("live"))
    live = keep(live, "live")
    wide = scanned.alias("s").join(live.alias("l"), F.col("s.row") == F.col("l.row"), "left").select("s.*", F.coalesce("l.live", F.array().cast("array<binary>")).alias("live"))
    all_spans = F.array_sort(
        F.transform(
            F.concat("base", F.filter("more", lambda s: F.array_contains("live", s["digest"]))),
            lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")),
        )
    )
    return wide.withColumn("found", all_spans).select(
        F.col("id").alias(id_col),
        "content",
        "n_assign",
        "n_access",
        "n_hex",
        "base_sha256",
        F.array_join(F.transform("found", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",").alias("spans"),
        F.size(F.filter(F.concat("base", "more"), lambda s: F.array_contains("live", s["digest"]))).cast("long").alias("n_live"),
        F.size(F.filter(F.concat("base", "more"), lambda s: ~F.array_contains("live", s["digest"]))).cast("long").alias("n_examples"),
        F.transform("found", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("found"),
    )


def masked(text: str, spans: Iterable[tuple[int, int]], mask: str = "[SECRET]") -> str:
    """Every maximal run of covered characters becomes one mask."""
    out, at = [], 0
    for start, end in sorted(spans):
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, scanned: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the base spans of every text masked, and with the live spans of ``scan`` masked too.

    Spans hang on the text and verdicts on values, so live spans reach a row by its text: rows with null or repeated ids are
    masked as all others, each at its own places. Columns of any name stay as they are; null and empty texts too.
    """
    more = keep(scanned.where("n_live > 0").groupBy(F.col("content").alias("_content_")).agg(F.first("found").alias("_found_")), "found")
    wide = docs.alias("d").join(more, F.md5(F.col(f"d.`{text}`").cast("binary")) == F.col("_content_"), "left").select("d.*", "_found_")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for value, found in zip(batch.column(text).to_pylist(), batch.column("_found_").to_pylist(), strict=True):
                if value:
                    spans = {(s[0], s[1]) for s in base_spans(value)} | {(s["start"], s["end"]) for s in found or ()}
                    value = masked(value, spans) if spans else value
                texts.append(value)
            at = batch.schema.get_field_index(text)
            yield batch.set_column(at, text, pa.array(texts, batch.schema.field(text).type)).drop_columns(["_found_"])

    return wide.mapInArrow(apply, docs.schema)


@query("op5_secret_scans")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), owner=F.expr(GROUP)).drop("found", "content")
