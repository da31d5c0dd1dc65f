"""What kind of work an agent does, from tool names and from behaviour, and the weights it implies."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import constants as K

# Order of the use cases; earlier ones win ties.
ORDER = [*K.PRESETS]


def presets(spark: SparkSession) -> DataFrame:
    """Preset weights: use_case, dim, preset (168 rows)."""
    rows = [(uc, d, float(w)) for uc, ws in K.PRESETS.items() for d, w in zip(K.PRESET_DIMS, ws, strict=True)]
    return spark.createDataFrame(rows, "use_case string, dim string, preset double")


def effect_sizes(spark: SparkSession) -> DataFrame:
    rows = [(uc, K.EFFECT_SIZES.get(uc, K.DEFAULT_EFFECT_SIZE)) for uc in K.PRESETS]
    return spark.createDataFrame(rows, "use_case string, effect_size double")


def word_parts(tool: Column) -> Column:
    """Words of a tool name: split at ``_``, ``-`` and camel case, three letters or more, abbreviations spelled out."""
    snake = F.lower(F.regexp_replace(F.replace(F.trim(tool), F.lit("-"), F.lit("_")), "([a-z])([A-Z])", "$1_$2"))
    words = F.filter(F.split(snake, "_"), lambda w: F.length(w) >= 3)
    spelled = F.create_map(*[F.lit(x) for kv in K.ABBREVIATIONS.items() for x in kv])
    return F.transform(words, lambda w: F.coalesce(F.element_at(spelled, w), w))


def tool_words(tools: DataFrame) -> DataFrame:
    """(…, tool, position, word): the whole phrase at position 0, then its words."""
    words = word_parts(F.col("tool"))
    variants = F.when(F.size(words) > 0, F.concat(F.array(F.array_join(words, " ")), words)).otherwise(
        F.array().cast("array<string>")
    )
    return tools.select("*", F.posexplode(variants).alias("position", "word"))


def first_owner(keywords: DataFrame, order: Sequence[str] = tuple(ORDER)) -> DataFrame:
    """One row per keyword: the first use case that lists it, its stronger signal first."""
    place = F.array_position(F.array(*[F.lit(u) for u in order]), F.col("use_case"))
    place = F.when(place == 0, F.lit(len(order) + 1)).otherwise(place)
    best = F.min(F.struct(place.alias("place"), F.col("use_case"), (-F.col("points")).alias("minus")))
    return (
        keywords.groupBy("keyword")
        .agg(best.alias("o"))
        .select("keyword", F.col("o.use_case").alias("use_case"), (-F.col("o.minus")).alias("points"))
    )


def keyword_matches(words: DataFrame, keywords: DataFrame) -> DataFrame:
    """Which keyword occurs in which tool word.

    Containment as an equi-join: every distinct word gives its substrings, which meet the keywords by
    equality. Neither side has to fit in memory and no word is compared with every keyword.
    """
    distinct = words.select("word").distinct()
    size = F.length("word")
    starts = distinct.select("word", F.explode(F.sequence(F.lit(1), size)).alias("start")).where(size > 0)
    pieces = starts.select("word", "start", F.explode(F.sequence(F.lit(1), size - F.col("start") + 1)).alias("len"))
    parts = pieces.select("word", F.col("word").substr(F.col("start"), F.col("len")).alias("keyword"))
    found = parts.join(keywords, "keyword").select("word", *keywords.columns).distinct()
    return words.join(found, "word").select(*words.columns, *keywords.columns)


def affix_points(tools: DataFrame, by: Sequence[str] = ("session_id",)) -> DataFrame:
    """One point per matching prefix or suffix of the tool's snake-case phrase.

    An affix is the first or last word with its underscore, so both lookups are equi-joins with the
    fixed affix tables.
    """
    spark = tools.sparkSession
    prefixes = spark.createDataFrame(K.PREFIX_POINTS, "affix string, use_case string")
    suffixes = spark.createDataFrame(K.SUFFIX_POINTS, "affix string, use_case string")
    worded = tools.select(*by, word_parts(F.col("tool")).alias("words")).where(F.size("words") > 1)
    ends = worded.select(
        *by,
        F.concat(F.element_at("words", 1), F.lit("_")).alias("head"),
        F.concat(F.lit("_"), F.element_at("words", -1)).alias("tail"),
    )
    hit = lambda table, end: ends.select(*by, F.col(end).alias("affix")).join(F.broadcast(table), "affix").select(*by, "use_case")
    hits = hit(prefixes, "head").unionByName(hit(suffixes, "tail"))
    return hits.groupBy(*by, "use_case").agg(F.count("*").cast("double").alias("points"))


def _winner(scores: DataFrame, by: Sequence[str], order: Sequence[str], least: float) -> DataFrame:
    """Best and second-best use case per group; a handful of rows per group."""
    place = F.array_position(F.array(*[F.lit(u) for u in order]), F.col("use_case"))
    w = Window.partitionBy(*by).orderBy(F.col("points").desc(), place)
    ranked = scores.withColumn("r", F.row_number().over(w)).where(F.col("r") <= 2)
    top = ranked.groupBy(*by).agg(
        F.max(F.when(F.col("r") == 1, F.col("use_case"))).alias("best"),
        F.max(F.when(F.col("r") == 1, F.col("points"))).alias("first"),
        F.coalesce(F.max(F.when(F.col("r") == 2, F.col("points"))), F.lit(0.0)).alias("second"),
    )
    won = F.col("first") >= least
    return top.select(
        *by,
        F.when(won, F.col("best")).otherwise("GENERAL").alias("use_case"),
        F.when(won, F.col("first") / (F.col("first") + F.col("second"))).otherwise(0.0).alias("confidence"),
    )


def keyword_scores(tools: DataFrame, keywords: DataFrame, by: Sequence[str] = ("session_id",)) -> DataFrame:
    """Points per group and use case. ``tools``: by, tool (distinct). ``keywords``: use_case, keyword, points.

    A keyword found in any word of any tool counts once. Tools without a hit score by affix.
    """
    by = list(by)
    words = tool_words(tools.select(*by, "tool").distinct())
    matched = keyword_matches(words, first_owner(keywords))
    found = matched.groupBy(*by, "use_case", "keyword").agg(F.max("points").alias("points"))
    plain = found.groupBy(*by, "use_case").agg(F.sum("points").cast("double").alias("points"))
    # The first word that holds a keyword is the one marked as scored; its tool is no longer unmatched.
    first_word = F.min(F.struct("tool", "position", "word"))["word"]
    scored_words = matched.groupBy(*by, "keyword").agg(first_word.alias("word")).select(*by, "word").distinct()
    scored_tools = words.join(scored_words, [*by, "word"], "left_semi").select(*by, "tool").distinct()
    unmatched = words.select(*by, "tool").distinct().join(scored_tools, [*by, "tool"], "left_anti")
    return plain.unionByName(affix_points(unmatched, by)).groupBy(*by, "use_case").agg(F.sum("points").alias("points"))


def keyword_use_case(tools: DataFrame, keywords: DataFrame, by: Sequence[str] = ("session_id",)) -> DataFrame:
    """Use case per group from its tool names: needs three points; only generic words means GENERAL."""
    by = list(by)
    distinct = tools.select(*by, "tool").distinct()
    generic = F.forall(word_parts(F.col("tool")), lambda w: w.isin(K.GENERIC_WORDS))
    all_generic = distinct.groupBy(*by).agg(F.every(generic).alias("generic"))
    won = _winner(keyword_scores(distinct, keywords, by), by, ORDER, 3.0)
    use = F.when(F.col("generic"), F.lit("GENERAL")).otherwise(F.coalesce("use_case", F.lit("GENERAL")))
    conf = F.when(F.col("generic"), F.lit(0.0)).otherwise(F.coalesce("confidence", F.lit(0.0)))
    return all_generic.join(won, by, "left").select(*by, use.alias("use_case"), conf.alias("confidence"))


# ---- behaviour ---------------------------------------------------------------------------------
RULE_ORDER = list(dict.fromkeys(r[0] for r in K.BEHAVIOUR_RULES)) + ["GENERAL", "FINANCIAL", "DEVOPS_SRE", "HEALTHCARE"]
SIGNALS = sorted({r[1] for r in K.BEHAVIOUR_RULES})


def _quiet_agent_rules() -> dict[str, Column]:
    """Extra rules for agents no ordinary rule describes, three points each."""
    c = F.col
    between = lambda lo, hi: c("avg_tool_count").between(lo, hi)
    return {
        "FINANCIAL": (c("error_rate") < 0.02) & (c("escalation_rate") < 0.10) & between(3, 8),
        "CONTENT_GENERATION": (c("avg_output_length") > 400) & (c("avg_tool_count") < 4) & (c("error_rate") < 0.05),
        "DATA_ANALYSIS": (c("avg_tool_count") > 5) & (c("escalation_rate") < 0.05) & (c("avg_output_length") > 300),
        "DEVOPS_SRE": (c("avg_tool_count") > 5) & (c("avg_latency_p95") > 4000) & (c("escalation_rate") < 0.05),
        "HEALTHCARE": (c("error_rate") < 0.01) & between(2, 6) & (c("avg_time_to_first_tool") > 800),
    }


def behaviour_scores(signals: DataFrame, by: Sequence[str] = ("session_id",), rules: DataFrame | None = None) -> DataFrame:
    """Points per group and use case: signals unpivoted and joined to the rule table."""
    by = list(by)
    spark = signals.sparkSession
    if rules is None:
        rules = spark.createDataFrame(K.BEHAVIOUR_RULES, "use_case string, signal string, op string, cut double, points int")
    long = F.array(*[F.struct(F.lit(s).alias("signal"), F.col(s).cast("double").alias("value")) for s in SIGNALS])
    flat = signals.where(F.col("n") >= 5).select(*by, F.explode(long).alias("s")).select(*by, "s.signal", "s.value")
    hit = F.when(F.col("op") == ">", F.col("value") > F.col("cut")).otherwise(F.col("value") < F.col("cut"))
    base = (
        flat.join(F.broadcast(rules), "signal")
        .groupBy(*by, "use_case")
        .agg(F.sum(F.when(hit, F.col("points")).otherwise(0)).cast("double").alias("points"))
    )
    quiet = base.groupBy(*by).agg(F.max("points").alias("best")).where(F.col("best") < 2).select(*by)
    extra_rows = F.array(
        *[F.struct(F.lit(u).alias("use_case"), F.when(t, 3.0).otherwise(0.0).alias("points")) for u, t in _quiet_agent_rules().items()]
    )
    extra = (
        signals.join(quiet, by, "left_semi")
        .select(*by, F.explode(extra_rows).alias("e"))
        .select(*by, "e.use_case", "e.points")
        .where(F.col("points") > 0)
    )
    general = signals.where(F.col("n") >= 5).select(*by, F.lit("GENERAL").alias("use_case"), F.lit(1.0).alias("points"))
    union = reduce(DataFrame.unionByName, [base, extra, general])
    return union.groupBy(*by, "use_case").agg(F.sum("points").alias("points"))


def behaviour_use_case(signals: DataFrame, by: Sequence[str] = ("session_id",)) -> DataFrame:
    """Use case per group from its behaviour signals; groups under five runs are GENERAL."""
    by = list(by)
    won = _winner(behaviour_scores(signals, by), by, RULE_ORDER, 2.0)
    return signals.select(*by).join(won, by, "left").select(
        *by,
        F.coalesce("use_case", F.lit("GENERAL")).alias("use_case"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
    )


# ---- blending ----------------------------------------------------------------------------------
def _compatible(a: Column, b: Column) -> Column:
    listed = [f"{x}|{y}" for x, y in K.COMPATIBLE_USE_CASES] + [f"{y}|{x}" for x, y in K.COMPATIBLE_USE_CASES]
    return (a == "GENERAL") | (b == "GENERAL") | (a == b) | F.concat_ws("|", a, b).isin(listed)


def blend_use_case(keyword: DataFrame, behaviour: DataFrame, by: Sequence[str] = ("session_id",)) -> DataFrame:
    """Both guesses in one: use case, method and the shares of keyword, behaviour and GENERAL weights."""
    by = list(by)
    named = lambda df, p: df.select(*by, F.col("use_case").alias(f"{p}_case"), F.col("confidence").alias(f"{p}_raw"))
    both = named(keyword, "kw").join(named(behaviour, "beh"), by, "full_outer")
    for p in ("kw", "beh"):
        both = both.withColumn(f"{p}_case", F.coalesce(f"{p}_case", F.lit("GENERAL"))).withColumn(
            f"{p}_raw", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(f"{p}_raw", F.lit(0.0))))
        )
    agree = (F.col("kw_case") != "GENERAL") & (F.col("kw_case") == F.col("beh_case"))
    lifted = F.when(agree & (F.col("kw_raw") > 0) & (F.col("beh_raw") >= 0.3), F.greatest(F.col("kw_raw"), F.lit(0.5)))
    both = both.withColumn("kw", F.coalesce(lifted, F.col("kw_raw"))).withColumn("beh", F.col("beh_raw"))
    nothing = (F.col("kw_case") == "GENERAL") & (F.col("beh_case") == "GENERAL") & (F.col("kw") == 0) & (F.col("beh") == 0)
    conflict = ~_compatible(F.col("kw_case"), F.col("beh_case"))
    kw_leads = F.col("kw") >= F.col("beh")
    leader = F.when(kw_leads, F.col("kw_case")).otherwise(F.col("beh_case"))
    total = F.col("kw") + F.col("beh")
    method = (
        F.when(nothing, "general_fallback")
        .when(conflict, "conflict_resolved")
        .when(F.col("kw") > F.col("beh") * 1.5, "keyword_dominant")
        .when(F.col("beh") > F.col("kw") * 1.5, "behavioral_dominant")
        .when((F.col("kw") > 0.1) | (F.col("beh") > 0.1), "blended")
        .otherwise("general_fallback")
    )
    final = (
        F.when(F.col("method") == "general_fallback", "GENERAL")
        .when(F.col("method") == "keyword_dominant", F.col("kw_case"))
        .when(F.col("method") == "behavioral_dominant", F.col("beh_case"))
        .otherwise(leader)
    )
    share = lambda c, leads: (
        F.when(nothing, 0.0)
        .when(conflict, F.when(leads, F.col(c)).otherwise(0.0))
        .when(total > 0, F.col(c) / total)
        .otherwise(0.0)
    )
    return (
        both.withColumn("method", method)
        .withColumn("use_case", final)
        .withColumn("kw_share", share("kw", kw_leads))
        .withColumn("beh_share", share("beh", ~kw_leads))
        .withColumn("general_share", 1.0 - F.col("kw_share") - F.col("beh_share"))
        .select(*by, "use_case", "method", "kw_case", "beh_case", "kw_share", "beh_share", "general_share")
    )


def blended_weights(blend: DataFrame, by: Sequence[str] = ("session_id",)) -> DataFrame:
    """Weights per group and dimension; use cases without a preset row fall back to GENERAL."""
    by = list(by)
    table = presets(blend.sparkSession)
    known = F.array(*[F.lit(u) for u in K.PRESETS])
    parts = F.array(
        F.struct(F.col("kw_case").alias("use_case"), F.col("kw_share").alias("share")),
        F.struct(F.col("beh_case").alias("use_case"), F.col("beh_share").alias("share")),
        F.struct(F.lit("GENERAL").alias("use_case"), F.col("general_share").alias("share")),
    )
    flat = blend.select(*by, F.explode(parts).alias("p")).select(
        *by, F.when(F.array_contains(known, F.col("p.use_case")), F.col("p.use_case")).otherwise("GENERAL").alias("use_case"), "p.share"
    )
    raw = flat.join(F.broadcast(table), "use_case").groupBy(*by, "dim").agg(F.sum(F.col("share") * F.col("preset")).alias("raw"))
    totals = raw.groupBy(*by).agg(F.sum("raw").alias("total"))
    return raw.join(totals, by).select(*by, "dim", (F.col("raw") / F.col("total")).alias("weight"))
