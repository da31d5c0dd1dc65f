"""URL verdicts by pattern rules that are indexed by their rarest literal token."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import keep, query, table

# The site rules of the contract (site, verdict) and patterns over the whole lower-case url
# (name, verdict, pattern, tokens). Listed are only literal tokens that the pattern bounds by non-word characters on both
# sides: what it leaves open at an end may be part of a longer token of the url.
SITES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
PATTERNS = (
    ("session", "block", r"[?&;]sessionid=", ("sessionid",)),
    ("php-session", "block", r"[?&;]phpsessid=", ("phpsessid",)),
    ("reply", "block", r"[?&]replytocom=[0-9]+", ("replytocom",)),
    ("login", "block", r"/wp-login\.php", ("wp", "login")),
    ("scripts", "block", r"/cgi-bin/", ("cgi", "bin")),
    ("archive", "block", r"/tag/[^/?#]+/page/[0-9]+", ("tag", "page")),
    ("adverts", "block", r"[./]ads-track\.", ("ads", "track")),
    ("casino", "block", r"[./]casino-win\.", ("casino", "win")),
    ("bets", "block", r"[./]free-bets\.", ("free", "bets")),
)
BROADCAST_RULES = 20_000
"""Up to this many rules (under 10 MB) the index is broadcast; beyond, it is joined by a shuffle."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def tokens(column: Column) -> Column:
    return F.array_distinct(F.split(lower(column), "[^a-z0-9]+"))


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty without ``://``."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    return lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_rows(sites=SITES, patterns=PATTERNS) -> list[tuple]:
    """(name, verdict, is_site, pattern, tokens, length) of each rule."""
    rows = []
    for site, verdict in sites:
        host, _, path = site.partition("/")
        split = re.split(r"[^a-z0-9]+", site.lower())
        if path:
            split.pop()  # '' behind a last slash; else the start of a token that the path may go on with
        literal = [t for t in split if t]
        rows.append((site, verdict, True, rf"^(?:[^/]*\.)?{re.escape(host)}/{re.escape(path)}", literal, len(site)))
    rows += [(name, verdict, False, pattern, list(literal), len(pattern)) for name, verdict, pattern, literal in patterns]
    return rows


def judge(pages: DataFrame, sites=SITES, patterns=PATTERNS, url: str = "url", default: str = "allow") -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` and ``verdict`` to every row (columns of these names are replaced).

    The longest site rule that fits decides; without one, the longest pattern that fits; else ``default``.
    Each rule waits under the one of its literal tokens that is rarest in all urls, a url fetches only the
    rules under its own tokens, and only those run their regular expression. Rules without tokens are a list
    that every url fetches. Equal urls are judged once.
    A null url has an empty host and path and gets ``default``. Rows, repeated ones too, all stay.
    """
    spark = pages.sparkSession
    rows = rule_rows(sites, patterns)
    rules = spark.createDataFrame(
        rows, "name string, verdict string, is_site boolean, pattern string, tokens array<string>, size int"
    )
    small = F.broadcast if len(sites) + len(patterns) <= BROADCAST_RULES else (lambda df: df)
    host, path = parts(F.col(url))
    distinct = pages.select(F.col(url).alias("u")).where("u is not null").distinct()
    distinct = distinct.select("u", tokens(F.col("u")).alias("tokens"))
    asked = rules.select(F.explode("tokens").alias("token")).distinct()
    seen = distinct.select(F.explode("tokens").alias("token")).join(small(asked), "token").groupBy("token").agg(F.count("*").alias("n"))
    ranked = rules.select("*", F.explode("tokens").alias("token")).join(seen, "token", "left")
    index = ranked.groupBy("name", "verdict", "is_site", "pattern", "size").agg(
        F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token")
    )
    index = keep(index, "rules")
    fetched = distinct.select("u", F.explode("tokens").alias("token")).join(small(index), "token").drop("token")
    if loose := [r for r in rows if not r[4]]:
        kinds = ("name", "verdict", "is_site", "pattern", "size")
        listed = F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in zip(kinds, (*r[:4], r[5]), strict=True))) for r in loose))
        fetched = fetched.unionByName(distinct.select("u", F.inline(listed)))
    h, p = parts(F.col("u"))
    subject = F.when(F.col("is_site"), F.concat(h, p)).otherwise(lower(F.col("u")))
    fits = fetched.where(F.regexp_like(subject, F.col("pattern")))
    won = fits.groupBy("u").agg(F.max(F.struct("is_site", "size", "name", "verdict")).alias("won"))
    won = keep(won.select("u", F.when(F.col("won.is_site"), F.col("won.name")).alias("w_rule"), F.col("won.verdict").alias("w_verdict")), "verdicts")
    rest = [F.col(f"p.`{c}`") for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    joined = pages.alias("p").join(won.alias("w"), F.col(f"p.`{url}`") == F.col("w.u"), "left")
    host, path = parts(F.col(f"p.`{url}`"))
    return joined.select(
        *rest, host.alias("host"), path.alias("path"), F.col("w_rule").alias("rule"), F.coalesce("w_verdict", F.lit(default)).alias("verdict")
    )


def _oracle() -> str:
    rest = "substr(url, strpos(url, '://') + 3)"
    split = f"case when strpos(url, '://') > 0 then {rest} else '' end"
    up = f"'{UPPER}', '{LOWER}'"
    sites = " ".join(
        f"when (host = '{s.partition('/')[0]}' or ends_with(host, '.{s.partition('/')[0]}')) and starts_with(path, '/{s.partition('/')[2]}') then '{s}'"
        for s, _ in sorted(SITES, key=lambda r: (-len(r[0]), r[0]))
    )
    verdicts = " ".join(f"when rule = '{s}' then '{v}'" for s, v in SITES)
    patterns = " ".join(f"when regexp_matches(low, '{p}') then '{v}'" for _, v, p, _ in sorted(PATTERNS, key=lambda r: -len(r[2])))
    return f"""
with a as (select page_id, coalesce({split}, '') as rest, coalesce(translate(url, {up}), '') as low from pages),
b as (select page_id, low, translate(regexp_extract(rest, '^([^/?#]*)', 1), {up}) as host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from a),
c as (select *, case {sites} end as rule from b)
select page_id, host, path, rule, case {verdicts} {patterns} else 'allow' end as verdict from c"""


@query("op9_url_filters", _oracle())
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")
