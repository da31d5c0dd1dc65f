"""Mixing sources to target weights through a tree of domains, languages and sources. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import keep, query, table

LEVELS = ("domain", "language", "leaf_source")
EPOCHS = 2
BUCKET_DIGITS = 3
"""Documents of a leaf are first placed by this many hexadecimal digits of their draw; only the one bucket that the
budget cuts through is ordered document by document."""

SEED = 11


def n_tokens(text: Column) -> Column:
    """Pieces between single blanks; null and empty texts have none."""
    t = F.coalesce(text, F.lit(""))
    return F.when(t == "", 0).otherwise(F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1).cast("long")


def draw(seed: int, epoch: Column, identity: Column) -> Column:
    """The place of a document in an epoch's order: a digest, so lost tasks repeat it and SQL can too."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), identity))


def budgets(leaves: DataFrame, weights: dict[str, dict[str, float]], total: Column, epochs: int = EPOCHS) -> DataFrame:
    """Tokens for every leaf: (domain, language, leaf_source, tokens) gets ``budget``.

    ``weights`` has a table for each level, name to weight; names it lacks weigh 1. A node's capacity is the
    tokens below it times ``epochs``. From the root down each node's budget is split among its children by
    weight, no child beyond its capacity: what one cannot take goes to its siblings by weight, and, as the
    capacities of whole subtrees are known, only what all siblings lack reaches the level above. The split is
    the exact water level: with children ordered by capacity per weight, those up to some place are full, and
    the rest share what is left by weight. All of it are windows over the table of nodes, never over documents.
    """
    leaves = leaves.withColumn("capacity", (F.col("tokens") * epochs).cast("double"))
    # Decimals keep sums independent of their order.
    budget = keep(leaves.groupBy().agg(F.sum("tokens").alias("all")).select(total.cast("double").alias("budget"), F.lit(1).alias("root")), "root")
    above: list[str] = ["root"]
    for level in LEVELS:
        own = [*above, level]
        nodes = leaves.withColumn("root", F.lit(1)).groupBy(*own).agg(F.sum("capacity").alias("capacity")).where("capacity > 0")
        given = weights.get(level, {})
        weight = F.coalesce(F.create_map(*(F.lit(x) for kv in given.items() for x in kv))[F.col(level)], F.lit(1.0)) if given else F.lit(1.0)
        nodes = nodes.join(budget, above).withColumn("weight", weight.cast("double")).where("weight > 0")
        ranked = Window.partitionBy(*above).orderBy(F.col("capacity") / F.col("weight"), level)
        before = ranked.rowsBetween(Window.unboundedPreceding, -1)
        after = ranked.rowsBetween(Window.currentRow, Window.unboundedFollowing)
        nodes = nodes.withColumn("taken", F.coalesce(F.sum("capacity").over(before), F.lit(0.0))).withColumn("share", F.sum("weight").over(after))
        # The level that results if this child and all behind it share what those before it leave.
        nodes = nodes.withColumn("water", (F.col("budget") - F.col("taken")) / F.col("share"))
        full = F.col("water") * F.col("weight") >= F.col("capacity")
        line = F.first(F.when(~full, F.col("water")), True).over(Window.partitionBy(*above).orderBy(F.col("capacity") / F.col("weight"), level).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        nodes = nodes.withColumn("line", line)
        got = F.when(full, F.col("capacity")).otherwise(F.least("capacity", F.col("line") * F.col("weight")))
        budget = keep(nodes.select(*own, got.alias("budget")), f"budget-{level}")
        above = own
    return leaves.join(budget.drop("root"), list(LEVELS)).select(*LEVELS, "tokens", F.floor(F.col("budget") + 1e-6).cast("long").alias("budget"))


def cuts(docs: DataFrame, leaves: DataFrame, seed: int = SEED) -> DataFrame:
    """For every leaf how many ``whole`` epochs its budget buys, and the last draw (``cutoff``) of the next epoch's prefix.

    ``docs`` has the levels, ``identity`` and ``n_tokens``. The prefix is the longest, in the order of the
    draws, whose tokens fit; rows with equal draws count as one step. The running total of a leaf is not one
    window: draws fall into buckets, sums of buckets are small and windowed, and only the documents of the
    bucket where the budget ends are ordered, so a leaf with a third of all documents is no task's burden.
    """
    plan = keep(leaves.where("tokens > 0").select(*LEVELS, F.expr("budget div tokens").alias("whole"), F.expr("budget % tokens").alias("rest")), "plan")
    placed = docs.where("n_tokens > 0").join(plan, list(LEVELS)).select(*LEVELS, "n_tokens", "rest", draw(seed, F.col("whole"), F.col("identity")).alias("draw"))
    placed = keep(placed.withColumn("bucket", F.substring("draw", 1, BUCKET_DIGITS)), "placed")
    sums = placed.groupBy(*LEVELS, "rest", "bucket").agg(F.sum("n_tokens").alias("in_bucket"))
    run = Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("in_bucket").over(run), F.lit(0)))
    edges = keep(sums.where("before <= rest and before + in_bucket > rest").select(*LEVELS, "bucket", "before"), "edges")
    order = Window.partitionBy(*LEVELS).orderBy("draw").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    on_edge = placed.join(edges, [*LEVELS, "bucket"]).withColumn("upto", F.col("before") + F.sum("n_tokens").over(order))
    last = on_edge.where("upto <= rest").groupBy(*LEVELS).agg(F.max("draw").alias("last"))
    # A bucket's own digits sort before all of its draws: the cutoff where none of them fits.
    ends = keep(edges.select(*LEVELS, "bucket").join(keep(last, "last"), list(LEVELS), "left").select(*LEVELS, F.coalesce("last", "bucket").alias("cutoff")), "ends")
    return keep(plan.join(ends, list(LEVELS)).select(*LEVELS, "whole", "cutoff"), "cuts")


def marked(docs: DataFrame, domain: Column, weights: dict[str, dict[str, float]], share: float, epochs: int = EPOCHS, seed: int = SEED, id_col: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``docs`` with ``_mix_domain``, ``_mix_language``, ``_mix_leaf_source``, ``_mix_tokens`` and ``_mix_copies``: how often each row is taken.

    Columns of any name that does not begin with ``_mix_`` stay beside them as they are.

    ``share`` of all tokens is the total budget. A null name is the name ''. Rows without tokens cost nothing
    and are never taken (0 copies). Rows with a null id take part as the identity ''; rows that repeat an id
    within a leaf share a draw and stand or fall together. Empty tables give empty results. Texts never move:
    the plan is one row per leaf, joined to the rows where they are read.
    """
    named = docs.withColumns(
        {
            "_mix_domain": F.coalesce(domain.cast("string"), F.lit("")),
            "_mix_language": F.coalesce(F.col(lang).cast("string"), F.lit("")),
            "_mix_leaf_source": F.coalesce(F.col(source).cast("string"), F.lit("")),
            "_mix_tokens": n_tokens(F.col(text)),
            "_mix_identity": F.coalesce(F.col(id_col).cast("string"), F.lit("")),
        }
    )
    own = [F.col(f"_mix_{level}").alias(level) for level in LEVELS]
    small = keep(named.select(*own, F.col("_mix_identity").alias("identity"), F.col("_mix_tokens").alias("n_tokens")), "named")
    leaves = keep(small.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")), "leaves")
    plan = cuts(small, keep(budgets(leaves, weights, F.floor(F.col("all") * share), epochs), "budgets"), seed)
    plan = plan.select(*(F.col(c).alias(f"_mix_{c}") for c in plan.columns))
    prefix = (draw(seed, F.col("_mix_whole"), F.col("_mix_identity")) <= F.col("_mix_cutoff")).cast("int")
    copies = F.when((F.col("_mix_tokens") > 0) & F.col("_mix_whole").isNotNull(), F.col("_mix_whole").cast("int") + prefix).otherwise(0)
    joined = named.join(plan, [f"_mix_{level}" for level in LEVELS], "left")
    return joined.select(*(F.col(f"`{c}`") for c in docs.columns), *(F.col(f"_mix_{level}") for level in LEVELS), "_mix_tokens", copies.alias("_mix_copies"))


def mix(docs: DataFrame, *args, **options) -> DataFrame:
    """``marked`` with the added columns as ``domain``, ``language``, ``leaf_source``, ``mix_tokens`` and ``copies``; columns of ``docs`` that are called so make way."""
    mixed = marked(docs, *args, **options)
    added = {**{f"_mix_{level}": level for level in LEVELS}, "_mix_tokens": "mix_tokens", "_mix_copies": "copies"}
    own = [F.col(f"`{c}`") for c in mixed.columns if c not in added and c not in added.values()]
    return mixed.select(*own, *(F.col(c).alias(name) for c, name in added.items()))


def taken(mixed: DataFrame) -> DataFrame:
    """Of ``marked``: the documents as they came, each as often as it is taken."""
    copies = F.explode(F.array_repeat(F.lit(0), F.col("_mix_copies"))).alias("_mix_copy")
    own = [F.col(f"`{c}`") for c in mixed.columns if not c.startswith("_mix_")]
    return mixed.where("_mix_copies > 0").select(*own, copies).drop("_mix_copy")


DOMAIN = "concat('group', cast(try_cast(regexp_extract(source, '([0-9]+)', 1) as int) % 4 as string))"
# Fixed values of the registered query: weights by level, and the share of all tokens that is wanted.
WEIGHTS = {
    "domain": {"group0": 1.0, "group1": 2.0, "group2": 3.0, "group3": 4.0},
    "language": {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 1.0},
}
SHARE = 0.9


def oracle(share: float = SHARE, epochs: int = EPOCHS, seed: int = SEED, docs: str = "documents", tail: str | None = None) -> str:
    """The same selection in DuckDB's SQL, with plain windows over all documents."""
    domain = "coalesce('group' || (try_cast(regexp_extract(source, '([0-9]+)', 1) as int) % 4), '')"
    steps, above = [], ["root"]
    steps.append(f"""
named as (select *, {domain} as domain, coalesce(lang, '') as language, coalesce(source, '') as leaf_source,
    case when coalesce(text, '') = '' then 0 else length(text) - length(replace(text, ' ', '')) + 1 end as mix_tokens from {docs}),
leaves as (select 1 as root, domain, language, leaf_source, sum(mix_tokens)::bigint as tokens,
    sum(mix_tokens)::double * {epochs} as capacity from named group by all),
b_root as (select 1 as root, floor(sum(tokens) * {share})::double as budget from leaves)""")
    for level in LEVELS:
        given = " ".join(f"when '{k}' then {v}::double" for k, v in WEIGHTS.get(level, {}).items())
        weight = f"case {level} {given} else 1::double end" if given else "1::double"
        keys, part = ", ".join([*above, level]), ", ".join(above)
        order = f"partition by {part} order by capacity / weight, {level}"
        steps.append(f"""
n_{level} as (select n.*, budget, {weight} as weight from (select {keys}, sum(capacity) as capacity from leaves group by all having sum(capacity) > 0) n
    join b_{above[-1]} using ({part})),
w_{level} as (select *, (budget - coalesce(sum(capacity) over ({order} rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over ({order} rows between current row and unbounded following) as water from n_{level}),
l_{level} as (select *, first_value(case when water * weight < capacity then water end ignore nulls) over ({order} rows between unbounded preceding and unbounded following) as line from w_{level}),
b_{level} as (select {keys}, case when water * weight >= capacity then capacity else least(capacity, line * weight) end as budget from l_{level})""")
        above.append(level)
    steps.append(f"""
plan as (select domain, language, leaf_source, floor(budget + 1e-6)::bigint // tokens as whole, floor(budget + 1e-6)::bigint % tokens as rest
    from leaves join b_leaf_source using (root, domain, language, leaf_source) where tokens > 0),
drawn as (select n.*, whole, rest, md5(concat_ws(':', '{seed}', whole::varchar, coalesce(doc_id::varchar, ''))) as draw
    from named n left join plan using (domain, language, leaf_source)),
mixed as (select *, case when mix_tokens > 0 and whole is not null then whole::int
    + (sum(mix_tokens) over (partition by domain, language, leaf_source order by draw range between unbounded preceding and current row) <= rest)::int else 0 end as copies from drawn)""")
    return "with " + ",".join(steps) + (tail or "\nselect doc_id, domain, language, leaf_source, mix_tokens::bigint as mix_tokens, copies from mixed")


@query("op7_source_mixing", oracle())
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mix(docs, F.expr(DOMAIN), WEIGHTS, SHARE).select("doc_id", *LEVELS, "mix_tokens", "copies")
