"""A Merkle manifest of a dataset: a tree of digests for every source, and one over the sources' roots.

A level of an aligned block of nodes is one string of hexadecimal digests. Fixed-width substrings of it hash to the
parents, which are the next level's string, and the substrings to the left and right of a node are its siblings.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import keep, query, table
from tidemark.llm.order import positions

ARITY, HEIGHT, WIDTH = 3, 5, 64
"""Children of a node, levels climbed within a block, and characters of a digest."""

BLOCK = ARITY**HEIGHT
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sealed(*columns: Column) -> Column:
    """The digest of values: each as its bytes' count, a colon and itself; a null as ``-``."""
    strings = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in strings)), 256)


def cut(level: Column, start: Column, n: Column | int) -> Column:
    """``n`` digests of a level from ``start`` on, as far as there are any."""
    return F.substr(level, (start * WIDTH + 1).cast("int"), (n * F.lit(WIDTH)).cast("int"))


def parents(level: Column) -> Column:
    runs = F.sequence(F.lit(0), F.floor((F.octet_length(level) - 1) / (ARITY * WIDTH)).cast("int"))
    return F.array_join(F.transform(runs, lambda i: F.sha2(cut(level, i * ARITY, ARITY), 256)), "").cast("binary")


def climb(nodes: DataFrame, group: str, extra: Sequence[str], name: str) -> list[DataFrame]:
    """Blocks of every round, from the given nodes (group, position, total, hash) up to one block per group.

    Columns: group, ``block``, ``total`` (nodes of the group in this round), ``members`` (position, hash and the extra
    columns of at most ``BLOCK`` nodes), ``levels`` and ``top``. A round has a ``BLOCK``-th of the rows of the one before.
    """
    rounds = []
    while True:
        gathered = nodes.groupBy(group, F.floor(F.col("position") / BLOCK).alias("block")).agg(
            F.max("total").alias("total"), F.sort_array(F.collect_list(F.struct("position", "hash", *extra))).alias("members")
        )
        # A block of a larger tree climbs all levels, a lone one until a single node is left.
        height = F.size(F.filter(F.array(*(F.lit(ARITY**k) for k in range(HEIGHT))), lambda n: n < F.col("total")))
        bottom = F.array_join(F.transform("members", lambda m: m["hash"]), "").cast("binary")
        steps = F.slice(F.array(*(F.lit(k) for k in range(HEIGHT))), 1, height)
        levels = F.aggregate(steps, F.array(bottom), lambda done, _: F.concat(done, F.array(parents(F.element_at(done, -1)))))
        tall = gathered.withColumn("levels", levels).withColumn("top", F.element_at("levels", -1).cast("string"))
        rounds.append(keep(tall, name))
        if (rounds[-1].agg(F.max("total")).first()[0] or 0) <= BLOCK:
            return rounds
        nodes = rounds[-1].select(group, F.col("block").alias("position"), F.ceil(F.col("total") / BLOCK).alias("total"), F.col("top").alias("hash"))
        extra = ()


def path(levels: Column, position: Column) -> Column:
    """What stands to the left and right of a node and its ancestors in their runs, from the lowest level of the block on."""

    def step(level: Column, k: Column) -> Column:
        at = F.floor(position / F.pow(F.lit(ARITY), k)).cast("long")
        run = at - at % ARITY
        return F.struct(cut(level, run, at - run).cast("string").alias("left"), cut(level, at + 1, run + ARITY - 1 - at).cast("string").alias("right"))

    return F.transform(F.slice(levels, 1, F.size(levels) - 1), step)


def descend(rounds: list[DataFrame], group: str, above: DataFrame, told: Sequence[str]) -> DataFrame:
    """Every node of the first round with its whole ``path``. ``above``: group, ``block``, ``path`` and the ``told`` columns of the last round's blocks.

    Blocks meet the path above them one to one, before their nodes are spread.
    """
    for blocks in reversed(rounds):
        up = above.select(F.col(group).alias("_group"), F.col("block").alias("_block"), F.col("path").alias("_up"), *told)
        wide = blocks.join(up, F.col(group).eqNullSafe(F.col("_group")) & (F.col("block") == F.col("_block")))
        nodes = F.transform(
            "members", lambda m: F.struct(m.alias("node"), F.concat(path(F.col("levels"), m["position"] - F.col("block") * BLOCK), F.col("_up")).alias("path"))
        )
        spread = wide.select(group, *told, F.inline(nodes))
        above = spread.select(group, *told, "path", "node.*", F.col("node.position").alias("block"))
    return above.drop("block")


def fold(start: Column, steps: Column) -> Column:
    """The root that follows from a leaf and its siblings."""
    return F.aggregate(steps, start, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def altered(key: Column, text: Column) -> Column:
    """The text after the tampering that the manifest is tried against: for even checksums of the id, line breaks go."""
    return F.when(F.crc32(key.cast("string").cast("binary")) % 2 == 0, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)


def manifest(docs: DataFrame, id_col: str = "doc_id", group: str = "source", fields: Sequence[str] = FIELDS, text: str = "text") -> DataFrame:
    """One row per row of ``docs``: its ``leaf``, the ``subroot`` of its group, the ``root``, ``path`` and ``tampered``.

    ``path`` lists the siblings to the left and right on every level up to the root, with which anybody can fold a
    leaf again (``fold``); ``tampered`` is the leaf after ``altered``. Leaves ascend by id (null first); rows that
    repeat an id ascend by leaf, and rows equal in all fields share it, so their order changes nothing. Null groups
    are one group, the first. Null and empty texts have different leaves. A null id is never tampered with. Extra
    columns are not looked at, and the names of the result are fixed. An empty table has an empty manifest.

    Texts are hashed where they are read; only digests travel, and nothing but blocks of ``BLOCK`` of them is gathered.
    """
    column = lambda c: F.col(f"`{c}`")
    leaf = sealed(*map(column, fields))
    changed = sealed(*(altered(column(id_col), column(c)) if c == text else column(c) for c in fields))
    narrow = docs.select(column(id_col).alias("id"), column(group).cast("string").alias("tree"), leaf.alias("hash"), changed.alias("tampered"))
    ranked = positions(narrow, "tree", [F.col("id").asc_nulls_first(), F.col("hash")], "leaves")
    rounds = climb(ranked, "tree", ("id", "tampered"), "blocks")
    subroots = rounds[-1].select("tree", F.col("top").alias("hash"), F.lit(0).alias("all"))
    trees = climb(positions(subroots, "all", [F.col("tree").asc_nulls_first()], "subroots"), "all", ("tree",), "trees")
    root = trees[-1].select("all", "block", F.expr("cast(array() as array<struct<left: string, right: string>>)").alias("path"), F.col("top").alias("root"))
    above = descend(trees, "all", root, ["root"]).select("tree", F.lit(0).alias("block"), "path", F.col("hash").alias("subroot"), "root")
    found = descend(rounds, "tree", above, ["subroot", "root"])
    return found.select(F.col("id").alias("doc_id"), F.col("hash").alias("leaf"), "subroot", "root", "path", "tampered")


ORACLE = r"""
with recursive bits(i, k, v) as (
  select i, 0, i from range(256) t(i) union all
  select i, k + 1, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end from bits where k < 8),
crc as (select list(v order by i) as t from bits where k = 8),
sums as (
  select d.*, xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)),
    lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8)), 4294967295) as checksum from documents d, crc),
tampering as (
  select *, case when checksum % 2 = 0 then replace(text, chr(10), '') else text end as changed,
    coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') as head from sums),
sealed as (
  select doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) as leaf,
    sha256(head || coalesce(strlen(changed) || ':' || changed, '-')) as tampered from tampering),
leaves as (
  select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as pos,
    count(*) over (partition by source) as n, row_number() over () as rid from sealed),
nodes(level, source, pos, hash, n) as (
  select 0, source, pos, leaf, n from leaves union all
  select level + 1, source, pos // 3, sha256(string_agg(hash, '' order by pos)), any_value((n + 2) // 3) from nodes where n > 1 group by level, source, pos // 3),
subroots as (
  select source, hash as subroot, row_number() over (order by source nulls first) - 1 as pos, count(*) over () as n from nodes where n = 1),
trunk(level, pos, hash, n) as (
  select 0, pos, subroot, n from subroots union all
  select level + 1, pos // 3, sha256(string_agg(hash, '' order by pos)), any_value((n + 2) // 3) from trunk where n > 1 group by level, pos // 3),
steps as (
  select rid, level as step, coalesce(string_agg(hash, '' order by o.pos) filter (o.pos < l.pos // (3 ** level)::bigint), '') as l,
    coalesce(string_agg(hash, '' order by o.pos) filter (o.pos > l.pos // (3 ** level)::bigint), '') as r
  from leaves l join nodes o on l.source is not distinct from o.source and o.n > 1 and o.pos // 3 = (l.pos // (3 ** level)::bigint) // 3 group by rid, level
  union all
  select rid, 1000 + level, coalesce(string_agg(hash, '' order by o.pos) filter (o.pos < s.pos // (3 ** level)::bigint), ''),
    coalesce(string_agg(hash, '' order by o.pos) filter (o.pos > s.pos // (3 ** level)::bigint), '')
  from leaves l join subroots s on l.source is not distinct from s.source join trunk o on o.n > 1 and o.pos // 3 = (s.pos // (3 ** level)::bigint) // 3 group by rid, level),
proofs as (select rid, list(l || '|' || r order by step) as path, string_agg(l || r, '' order by step) as told from steps group by rid),
folded as (
  select l.doc_id, l.leaf, s.subroot, (select hash from trunk where n = 1) as root, sha256(coalesce(told, '')) as proof_sha256,
    list_reduce(list_concat([tampered], coalesce(path, [])), lambda h, x: sha256(split_part(x, '|', 1) || h || split_part(x, '|', 2))) as folded_root
  from leaves l join subroots s on l.source is not distinct from s.source left join proofs p using (rid))
select *, folded_root = root as verified from folded"""


@query("op11_merkle_manifest", ORACLE)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = manifest(table(spark, sf_dir, "documents"))
    told = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    return found.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(told, 256).alias("proof_sha256"), fold(F.col("tampered"), F.col("path")).alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
