"""Repair of broken conversations at least cost, by depth-first branch and bound over edits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import keep, query, table
from tidemark.llm.order import positions

SEGMENT = 512
"""Turns that one search handles; longer conversations are put together from the tables of their segments."""

BLANKS = " \t\n\v\f\r"
INITIALS = "suao"
"""Initials of roles; ``o`` stands for all that no legal conversation holds."""

LEGAL, SHORT, GONE = "suao", "SUAO", "1234"
"""Letters of rows by initial: in order, truncated, and blank or duplicate (to be deleted)."""

DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
#: States of ``(s?(ua)+)?``: nothing yet, after a system turn, after a user turn, after an assistant turn.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
WANTED = ("u", "u", "a", "u")
"""What may be inserted, or a turn be given as its role, in each state."""

ENDS = (0, 3)
NAMES = {"u": "user", "a": "assistant"}

Best = tuple[int, str]


def edits(letter: str | None, state: int) -> list[tuple[str, int, int, int]]:
    """(initial, cost, next state, rows consumed) of the edits at a row, or behind the last one, in ASCII order."""
    insert = ("I", INSERT, NEXT[state][WANTED[state]], 0)
    if letter is None:
        return [insert]
    out = [("D", DELETE, state, 1), insert]
    if letter not in GONE:
        own, extra = letter.lower(), TRUNCATED if letter in SHORT else 0
        if own in NEXT[state]:
            out.append(("K", extra, NEXT[state][own], 1))
        out.append(("R", REROLE + extra, NEXT[state][WANTED[state]], 1))
    return out


def bounds(letters: str, ends: tuple[int, ...]) -> list[list[float]]:
    """For each row and state the least cost of the rest when audits do not count: no completion is cheaper."""
    n, never = len(letters), float("inf")
    out = [[never] * 4 for _ in range(n + 1)]
    for i in range(n, -1, -1):
        letter = letters[i] if i < n else None
        here = out[i]
        for state in range(4):
            here[state] = 0 if letter is None and state in ends else min((c + out[i + 1][to] for _, c, to, k in edits(letter, state) if k), default=never)
        # Two insertions at one place suffice: a third leads back to a state that was there.
        for _ in range(2):
            for state in range(4):
                here[state] = min(here[state], INSERT + here[NEXT[state][WANTED[state]]])
    return out


@lru_cache(maxsize=4096)
def search(letters: str, start: int, ends: tuple[int, ...]) -> Best | None:
    """The cheapest edits of a segment from a state to one of ``ends``, among equals the ASCII-least audit; None where there are none.

    Nodes are (row, state) and open prefixes lie on a stack. A prefix goes if its cost and the suffix bound exceed the
    incumbent, if they equal it and its audit comes behind, or if another prefix of its node is at least as good: of
    two prefixes with equal cost at one node neither continues the other, as that would take insertions, so their order
    stays whatever follows.
    """
    suffix, n = bounds(letters, ends), len(letters)
    incumbent: Best | None = None
    best: dict[tuple[int, int], Best] = {}
    stack: list[tuple[int, int, int, str]] = [(0, start, 0, "")]
    while stack:
        row, state, cost, audit = stack.pop()
        least = cost + suffix[row][state]
        if least == float("inf"):
            continue
        if incumbent and (least > incumbent[0] or (least == incumbent[0] and audit > incumbent[1][: len(audit)])):
            continue
        known = best.get((row, state))
        if known and known <= (cost, audit):
            continue
        best[row, state] = (cost, audit)
        if row == n and state in ends and (not incumbent or (cost, audit) < incumbent):
            incumbent = (cost, audit)
        for name, price, to, taken in reversed(edits(letters[row] if row < n else None, state)):
            stack.append((row + taken, to, cost + price, audit + name))
    return incumbent


def illegal(left: str, right: str) -> bool:
    return left + right not in ("su", "ua", "au")


ROLE_OF = {c: INITIALS[i] for kind in (LEGAL, SHORT, GONE) for i, c in enumerate(kind)}
PART = "key string, segment long, last boolean, first string, final string, illegal long, entries array<struct<start: int, end: int, cost: long, audit: string>>"
KINDS = pa.schema(
    [("key", pa.string()), ("segment", pa.int64()), ("last", pa.bool_()), ("first", pa.string()), ("final", pa.string()), ("illegal", pa.int64()),
     ("entries", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])))]
)


def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tables of segments: for each state before and behind the best edits between. A first segment starts in state 0, a last one ends legally (-1)."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            letters = row["letters"]
            roles = [ROLE_OF[c] for c in letters]
            entries = []
            for start in (0,) if row["segment"] == 0 else range(4):
                for end, ends in ((-1, ENDS),) if row["last"] else [(e, (e,)) for e in range(4)]:
                    if best := search(letters, start, ends):
                        entries.append({"start": start, "end": end, "cost": best[0], "audit": best[1]})
            wrong = sum(illegal(a, b) for a, b in zip(roles, roles[1:], strict=False))
            out.append({"key": row["key"], "segment": row["segment"], "last": row["last"], "first": roles[0], "final": roles[-1], "illegal": wrong, "entries": entries})
        yield pa.RecordBatch.from_pylist(out, KINDS)


def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring segments become one: the best way over every state between them."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            parts = row["parts"]
            whole = parts[0]
            if len(parts) == 2:
                behind = parts[1]
                best: dict[tuple[int, int], Best] = {}
                for a in whole["entries"]:
                    for b in behind["entries"]:
                        if a["end"] == b["start"]:
                            way, at = (a["cost"] + b["cost"], a["audit"] + b["audit"]), (a["start"], b["end"])
                            best[at] = min(best.get(at, way), way)
                whole = {
                    "last": behind["last"], "first": whole["first"], "final": behind["final"],
                    "illegal": whole["illegal"] + behind["illegal"] + illegal(whole["final"], behind["first"]),
                    "entries": [{"start": s, "end": e, "cost": c, "audit": t} for (s, e), (c, t) in best.items()],
                }
            out.append(whole | {"key": row["key"], "segment": row["pair"]})
        yield pa.RecordBatch.from_pylist(out, KINDS)


def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, sha256) from sorted rows, each conversation's audit before its turns; nothing but the digest of one conversation is held."""
    key, audit, at, state, digest, any_turn = None, "", 0, 0, None, False

    def say(role: bytes, text: bytes) -> None:
        nonlocal any_turn
        digest.update((b"\n" if any_turn else b"") + role + b":" + text)
        any_turn = True

    def insertions() -> None:
        nonlocal at, state
        while audit[at : at + 1] == "I":
            say(NAMES[WANTED[state]].encode(), b"")
            state, at = NEXT[state][WANTED[state]], at + 1

    for batch in batches:
        keys, shas = [], []
        for row in batch.to_pylist():
            if row["head"]:
                if digest:
                    insertions()
                    keys.append(key)
                    shas.append(digest.hexdigest())
                key, audit, at, state, digest, any_turn = row["key"], row["audit"], 0, 0, hashlib.sha256(), False
                continue
            insertions()
            edit, at = audit[at], at + 1
            if edit == "K":
                state = NEXT[state][row["role"][:1].decode()]
                say(row["role"], row["text"])
            elif edit == "R":
                say(NAMES[WANTED[state]].encode(), row["text"])
                state = NEXT[state][WANTED[state]]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(shas, pa.string())], names=["key", "repaired_sha256"])
    if digest:
        insertions()
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([digest.hexdigest()])], names=["key", "repaired_sha256"])


def key_of(conv: Column) -> Column:
    """A name for every conversation; those without an id are one, too."""
    return F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit(""))


def repair(turns: DataFrame, conversations: DataFrame | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: faults, the cheapest edits to a legal order of roles, and the digest of what they leave.

    Columns: conv, ``gaps`` (turn numbers missing between the smallest and the largest), ``blank``, ``duplicate``,
    ``truncated`` (rows by their first fault), ``illegal`` (neighbouring roles), ``cost``, ``audit``, ``repaired_sha256``.
    ``conversations`` lists further ids to report: those without a row have zeros and an empty audit.

    Rows are taken by turn, null first, ties by role and then by the digest of the text, so rows equal in all make no difference. Null
    roles and texts count as one blank. A null conversation id is a conversation. A role goes by its first character;
    what begins otherwise than with s, u or a can only be given another role or be deleted. Extra columns are not looked
    at, and the names of the result are fixed. Empty tables give no rows.

    A conversation may hold a third of all rows. Its turns get their numbers and its duplicates are found without a group of
    it in one task; segments of ``SEGMENT`` turns are searched apart, for every state before and behind, and neighbours are
    joined pair by pair. Only two things follow a whole conversation: its audit, which is one value of the result, and its
    SHA-256, which is sequential; one task streams the turns through it.
    """
    value = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    rows = turns.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").alias("turn"), value(role).alias("role"), value(text).alias("text"))
    rows = rows.withColumn("key", key_of(F.col("conv"))).withColumn("digest", F.md5(F.col("text").cast("binary")))
    stripped = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = F.when(stripped == "", "blank").when(~F.right(stripped, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("")
    narrow = rows.select("key", "turn", "role", "digest", fault.alias("fault"))
    placed = keep(positions(narrow, "key", [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")], "turns"), "placed")
    firsts = placed.groupBy("key", "role", "digest").agg(F.min("position").alias("position")).select("key", "position", F.lit(True).alias("is_first"))
    judged = placed.join(firsts, ["key", "position"], "left")
    fault = F.when(F.col("fault") == "blank", "blank").when(F.col("is_first").isNull(), "duplicate").otherwise(F.col("fault"))
    initial = F.left(F.col("role"), F.lit(1))
    place = F.when(initial.isin("s", "u", "a"), F.locate(INITIALS[0], initial) * 1 + F.locate(INITIALS[1], initial) * 2 + F.locate(INITIALS[2], initial) * 3).otherwise(4)
    kinds = F.when(fault.isin("blank", "duplicate"), F.lit(GONE)).when(fault == "truncated", F.lit(SHORT)).otherwise(F.lit(LEGAL))
    judged = keep(judged.select("key", "turn", "position", "total", fault.alias("fault"), F.substr(kinds, place, F.lit(1)).alias("letter")), "judged")
    counts = judged.groupBy("key").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"),
        *(F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")),
    )
    segment = F.floor(F.col("position") / SEGMENT)
    gathered = judged.groupBy("key", segment.alias("segment")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "letter"))), lambda r: r["letter"]), "").alias("letters"),
        (F.max("position") + 1 == F.max("total")).alias("last"),
    )
    parts = keep(gathered.mapInArrow(solved, PART), "segments")
    while not parts.where("segment > 0").isEmpty():
        # The earlier of two segments sorts first.
        members = F.sort_array(F.collect_list(F.struct(*parts.columns[1:])))
        pairs = parts.groupBy("key", F.floor(F.col("segment") / 2).alias("pair")).agg(members.alias("parts"))
        parts = keep(pairs.mapInArrow(paired, PART), "segments")
    best = parts.select("key", "illegal", F.element_at("entries", 1)["cost"].alias("cost"), F.element_at("entries", 1)["audit"].alias("audit"))
    ids = rows.select("conv") if conversations is None else rows.select("conv").union(conversations.select(F.col(f"`{conv}`")))
    longs = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    heads = ids.distinct().withColumn("key", key_of(F.col("conv"))).join(counts, "key", "left").join(best, "key", "left")
    heads = keep(heads.select("key", "conv", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in longs), F.coalesce("audit", F.lit("")).alias("audit")), "heads")
    spoken = rows.select("key", F.lit(False).alias("head"), "turn", F.col("role").cast("binary").alias("role"), "digest", F.col("text").cast("binary").alias("text"), F.lit(None).cast("string").alias("audit"))
    told = heads.select("key", F.lit(True).alias("head"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), *(F.lit(None).cast(t).alias(c) for c, t in (("role", "binary"), ("digest", "string"), ("text", "binary"))), "audit")
    streamed = spoken.unionByName(told).repartition("key").sortWithinPartitions("key", F.col("head").desc(), F.col("turn").asc_nulls_first(), "role", "digest")
    digests = streamed.select("key", "head", "role", "text", "audit").mapInArrow(repaired, "key string, repaired_sha256 string")
    return heads.join(digests, "key").select(F.col("conv").alias(conv), *longs, "audit", "repaired_sha256")


def damaged(turns: DataFrame) -> DataFrame:
    """Rows broken by the checksum of their place: lost, emptied, without full stops, repeated, or given the role user."""
    place = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind = F.crc32(place.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    broken = turns.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), kind.alias("_kind"),
    )
    copies = F.when(F.col("_kind") == 0, 0).when(F.col("_kind") == 3, 2).otherwise(1)
    return broken.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), copies))).drop("_kind", "_copy")


def _candidate(when: str, cost: str, edit: str, after: str, line: str | None) -> str:
    told = f"list_prepend({line}, {after}.t)" if line else f"{after}.t"
    return f"case when {when} and {after} is not null then {{'k': printf('%09d', ({after}.k[1:9])::int + {cost}) || '{edit}' || {after}.k[10:], 't': {told}}} end"


def _least(*candidates: str) -> str:
    return f"list_sort(list_filter([{', '.join(candidates)}], lambda x: x is not null))[1]"


def _row_edits(state: int) -> str:
    wanted = WANTED[state]
    to = NEXT[state][wanted]
    keeps = [_candidate(f"not gone and initial = '{i}'", "short", "K", f"b{after}", "role || ':' || text") for i, after in NEXT[state].items()]
    return _least(
        _candidate("true", str(DELETE), "D", f"b{state}", None), *keeps, _candidate("not gone", f"{REROLE} + short", "R", f"b{to}", f"'{NAMES[wanted]}:' || text")
    )


def _insert(state: int, after: str) -> str:
    return _candidate("true", str(INSERT), "I", after, f"'{NAMES[WANTED[state]]}:'")


ORACLE = rf"""
with recursive bits(i, k, v) as (
  select i, 0, i from range(256) t(i) union all
  select i, k + 1, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end from bits where k < 8),
crc as (select list(v order by i) as t from bits where k = 8),
kinds as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda c: ascii(c)::bigint)),
      lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8)), 4294967295) % 20 as kind from conversations, crc),
broken as (
  select conv_id, turn, case when kind = 4 then 'user' else role end as role,
    case when kind = 1 then '' when kind = 2 then translate(text, '.!?', '') else text end as text
  from kinds, unnest(range(case when kind = 0 then 0 when kind = 3 then 2 else 1 end))),
placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, md5(text)) as p, count(*) over (partition by conv_id) as n,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as body from broken),
faults as (
  select *, case when body = '' then 'blank' when p > min(p) over (partition by conv_id, role, md5(text)) then 'duplicate'
    when right(body, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault,
    left(role, 1) as initial, lag(left(role, 1)) over (partition by conv_id order by p) as before from placed),
counts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps, count(*) filter (fault = 'blank') as blank,
    count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
    count(*) filter (p > 1 and before || initial not in ('su', 'ua', 'au')) as illegal from faults group by conv_id),
best(conv_id, p, b0, b1, b2, b3) as (
  select conv_id, max(n), {{'k': '000000000', 't': []::varchar[]}}, {{'k': '000000010II', 't': ['user:', 'assistant:']}},
    {{'k': '000000005I', 't': ['assistant:']}}, {{'k': '000000000', 't': []::varchar[]}} from faults group by conv_id
  union all
  select conv_id, p - 1, {_least('r0', _insert(0, 's2'))}, {_least('r1', _insert(1, 's2'))}, s2, s3 from (
    select *, {_least('r2', _insert(2, 'r3'))} as s2, {_least('r3', _insert(3, 'r2'))} as s3 from (
      select b.conv_id, b.p, {', '.join(f'{_row_edits(s)} as r{s}' for s in range(4))}
      from best b join (select *, fault in ('blank', 'duplicate') as gone, case when fault = 'truncated' then {TRUNCATED} else 0 end as short from faults) f
        on b.conv_id is not distinct from f.conv_id and b.p = f.p)))
select i.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
  coalesce(illegal, 0) as illegal, coalesce((b0.k[1:9])::bigint, 0) as cost, coalesce(b0.k[10:], '') as audit,
  sha256(coalesce(array_to_string(b0.t, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) i left join counts c on i.conv_id is not distinct from c.conv_id
left join best b on i.conv_id is not distinct from b.conv_id and b.p = 0"""


@query("op12_conversation_repair", ORACLE)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return repair(damaged(turns), turns)
