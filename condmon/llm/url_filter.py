"""URL filter with rules indexed by their rarest literal token, in DataFrame functions only.

A rule is a regular expression over ``host + path`` plus the literal tokens that any URL it fits
must hold. The tokens' counts over all URLs decide under which one token a rule is filed; the
distinct tokens of a URL fetch the rules filed under them, and only those run their expression.
The longest fitting host/path rule decides; pattern rules decide where none fits.

Each distinct URL is judged once, so a hot URL costs one judgement. Rules are a tuple or a table
of any length. They are broadcast only while their number is at most ``BROADCAST_RULES``; beyond it the fetch is
a shuffle join in which each token is dealt over ``SALTS`` parts, so a common token is no single task's.

Defined cases: a null url or one without ``://`` has an empty host and path, fits no rule and is
allowed; null urls take no part in any join; urls of any length are judged whole; repeated rows give equal
rows; further columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, require

BROADCAST_RULES, SALTS = 50_000, 16
RULE = "name string, verdict string, regex string, host_rule boolean, literals array<string>"
TOKENS = r"[^0-9A-Za-z]+"


@dataclass(frozen=True)
class Rule:
    """``name`` is host + path for a host rule; a pattern rule has its own name and comes after all host rules."""

    name: str
    verdict: str
    regex: str
    literals: tuple[str, ...]
    host_rule: bool


def host_rule(host: str, path: str, verdict: str) -> Rule:
    regex = rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}"
    cut = [t for t in re.split(TOKENS, host) if t]
    # The path's last token may go on in the URL (a prefix), so it is literal only before a separator.
    inner = re.split(TOKENS, path)[:-1]
    return Rule(host + path, verdict, regex, tuple(dict.fromkeys([*cut, *filter(None, inner)])), True)


def pattern_rule(name: str, verdict: str, regex: str, literals: tuple[str, ...]) -> Rule:
    return Rule(name, verdict, regex, literals, False)


#: The given host rules.
HOST_RULES = (
    host_rule("com", "/", "allow"),
    host_rule("example.com", "/en/", "block"),
    host_rule("www.example.com", "/en/", "allow"),
    host_rule("net", "/es/", "block"),
    host_rule("net", "/fr/", "block"),
)
PATTERN_RULES = (
    pattern_rule("farm", "block", r"(?:^|[.-])spam-farm\.", ("spam", "farm")),
    pattern_rule("pills", "block", r"(?:^|[.-])cheap-pills\.", ("cheap", "pills")),
    pattern_rule("casino", "block", r"(?:^|[./-])online-casino(?:[./-]|$)", ("online", "casino")),
    pattern_rule("adult", "block", r"^[^/]*(?:^|[.-])xxx[.-]", ("xxx",)),
    pattern_rule("login", "block", r"/login(?:[./]|$)", ("login",)),
    pattern_rule("signin", "block", r"/signin(?:[./]|$)", ("signin",)),
)


def parts(url: Column) -> tuple[Column, Column]:
    found = lambda g: F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)([^?#]*)", g), F.lit(""))
    return ascii_lower(found(1)), found(2)


def rule_table(spark: SparkSession, rules: Iterable[Rule]) -> DataFrame:
    return spark.createDataFrame([(r.name, r.verdict, r.regex, r.host_rule, list(r.literals)) for r in rules], RULE)


def indexed(rules: DataFrame, counts: DataFrame) -> DataFrame:
    """Rules (as of RULE) with the literal token that is rarest in ``counts`` (token, n); one without literals is filed under ''."""
    literals = F.when(F.size("literals") > 0, F.col("literals")).otherwise(F.array(F.lit("")))
    each = rules.withColumn("token", F.explode(literals)).join(counts, "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = each.groupBy("name", "verdict", "regex", "host_rule").agg(F.min(F.struct("n", "token")).alias("at"))
    return rarest.select("name", "verdict", "regex", "host_rule", "at.token")


def judge(pages: DataFrame, rules: tuple[Rule, ...] | DataFrame = HOST_RULES + PATTERN_RULES, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (the host rule that decides), verdict, pattern (the pattern rule that decides)."""
    require(pages, "page_id", "url")
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = rule_table(spark, rules)
    require(rules, "name", "verdict", "regex", "host_rule", "literals")
    small = rules.count() <= BROADCAST_RULES
    hint = F.broadcast if small else (lambda x: x)
    host, path = parts(F.col("url"))
    urls = pages.select("url").where("url is not null").distinct().select("url", F.concat(host, path).alias("key"))
    tokens = urls.select("url", "key", F.explode(F.array_distinct(F.concat(F.split("key", TOKENS), F.array(F.lit(""))))).alias("token"))
    literals = rules.select(F.explode("literals").alias("token")).distinct()
    counts = tokens.join(hint(literals), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    filed = indexed(rules, counts)
    if small:
        fetched = tokens.join(F.broadcast(filed), "token")
    else:
        dealt = tokens.withColumn("salt", F.pmod(F.xxhash64("url"), F.lit(SALTS)).cast("int"))
        fetched = dealt.join(filed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["token", "salt"])
    rank = F.struct("host_rule", F.length("name").alias("size"), F.col("verdict") == "block", "name")
    best = fetched.where(F.expr("key rlike regex")).groupBy("url").agg(F.max_by(F.struct("name", "verdict", "host_rule"), rank).alias("best"))
    given = pages.select("page_id", "url")
    # A left join would deal all null urls to one task.
    none = given.where("url is null").withColumn("best", F.lit(None).cast(best.schema["best"].dataType))
    out = given.where("url is not null").join(best, "url", "left").select("page_id", "url", "best").unionByName(none.select("page_id", "url", "best"))
    return out.select(
        "page_id",
        host.alias("host"),
        path.alias("path"),
        F.when(F.col("best.host_rule"), F.col("best.name")).alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
        F.when(~F.col("best.host_rule"), F.col("best.name")).alias("pattern"),
    )
