"""URL filters by a Bloom filter cascade.

A rule lists a host and the beginning of a path; it fits the host and all its
subdomains.  The keys of a url are its host's last 1, 2, ... labels followed by
the first characters of its path, for the label counts and path lengths that
occur in the rules, so a fitting rule is one of the keys.

Whether a key is listed is answered by a cascade, not by a join: level 1 is a
Bloom filter of the listed keys, level 2 of the corpus keys that level 1 lets
through wrongly, level 3 of the listed keys that level 2 lets through, and so
on until a level has no false positives.  Because the levels are built over the
complete set of the corpus's keys, the answer is exact for each of them.  A
level's bits are proportional to the keys it holds: all levels together need
some 20 bits a listed key, whatever the corpus.

Only built-in functions run here.  A null url, or one without ``://``, has an
empty host and path.  Rows that repeat are judged one by one; an empty table
gives an empty result, an empty rule list the default verdict.
"""

from __future__ import annotations

import json
import math
import string
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import lower_az, table, written

_LOWER_AZ = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
DEFAULT = "allow"  # the verdict where no rule fits

# op10's rules, fixed by its contract: (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return lower_az(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def url_keys(host: Column, path: Column, rules: Iterable[tuple[str, str, str]]) -> list[Column]:
    """The keys of a url that a rule could list; null where it has too few labels
    or too short a path."""
    rules = list(rules)
    labels = F.length(host) - F.length(F.replace(host, F.lit("."))) + 1
    return [
        F.when((labels >= n) & (F.length(path) >= m), F.concat(F.substring_index(host, ".", -n), F.substring(path, 1, m)))
        for n in sorted({r[1].count(".") + 1 for r in rules}) for m in sorted({len(r[2]) for r in rules})
    ]


# ---- the cascade -------------------------------------------------------------------------

@dataclass
class Level:
    number: int
    bits: int
    hashes: int
    words: DataFrame  # one row, one column: the bits as an array of longs

    def place(self, key: Column, i: int) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(self.number), F.lit(i)), F.lit(self.bits))

    def holds(self, key: Column) -> Column:
        words = self.words.scalar()
        places = [self.place(key, i) for i in range(self.hashes)]
        return reduce(Column.__and__, [F.getbit(F.get(words, F.floor(p / 64).cast("int")), (p % 64).cast("int")) == 1
                                       for p in places])


def build_level(keys: DataFrame, number: int, n_keys: int, error: float) -> Level:
    """A Bloom filter of ``keys`` (key) with about this error rate."""
    hashes = max(1, round(-math.log2(error)))
    level = Level(number, 64 * math.ceil(n_keys * hashes / math.log(2) / 64), hashes, keys)
    ones = keys.select(F.explode(F.array(*[level.place(F.col("key"), i) for i in range(hashes)])).alias("place"))
    words = ones.groupBy(F.floor(F.col("place") / 64).alias("id")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("place") % 64).cast("int"))).alias("word"))
    every = keys.sparkSession.range(level.bits // 64).join(words, "id", "left")
    ordered = F.array_sort(F.collect_list(F.struct("id", F.coalesce("word", F.lit(0).cast("long")).alias("word"))))
    level.words = written(every.agg(ordered.alias("w")).select(F.col("w.word").alias("words")), "bloom")
    return level


@dataclass
class Cascade:
    levels: list[Level]

    def member(self, key: Column) -> Column:
        """Whether a listed key or a key of the corpus is listed: the first level
        that refuses the key decides."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for i, level in reversed(list(enumerate(self.levels))):
            answer = F.when(level.holds(key), answer).otherwise(F.lit(i % 2 == 1))
        return answer


def build_cascade(listed: DataFrame, universe: DataFrame) -> Cascade:
    """``listed`` and ``universe`` have distinct keys (key)."""
    n_listed, levels = listed.count(), []
    inside, outside = listed, universe.join(listed, "key", "left_anti")
    n_inside, n_outside = n_listed, None
    while n_inside:
        if not levels:  # so few false positives that the next levels are small
            error = min(0.5, math.sqrt(0.5) * n_listed / max(1, universe.count()))
        else:
            error = 0.5
        level = build_level(inside, len(levels), n_inside, error)
        levels.append(level)
        passed = written(outside.where(level.holds(F.col("key"))), "passed")
        inside, outside = passed, inside
        n_inside = passed.count()
    return Cascade(levels)


# ---- the operator ------------------------------------------------------------------------

def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]], default: str = DEFAULT) -> DataFrame:
    """``pages`` (all columns) with host, path, rule (the longest that fits, else
    null) and verdict.  Of the same rule with two verdicts, block holds."""
    rules, spark = [(v, h.translate(_LOWER_AZ), p) for v, h, p in rules], pages.sparkSession
    host, path = host_and_path(F.col("url"))
    placed = pages.withColumn("host", host).withColumn("path", path)
    keys = url_keys(F.col("host"), F.col("path"), rules)
    if not rules:
        return placed.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(default))
    universe = written(placed.select(F.explode(F.array(*keys)).alias("key")).where("key IS NOT NULL").distinct(), "keys")
    found = []
    for verdict in sorted({r[0] for r in rules}):
        literal = json.dumps(sorted({h + p for v, h, p in rules if v == verdict}))  # one literal, however many
        listed = spark.range(1).select(F.explode(F.from_json(F.lit(literal), "array<string>")).alias("key"))
        cascade = build_cascade(listed, universe)
        found += [F.when(k.isNotNull() & cascade.member(k), F.struct(
            F.length(k).alias("length"), k.alias("rule"), F.lit(verdict).alias("verdict"))) for k in keys]
    best = F.greatest(*found) if len(found) > 1 else found[0]
    return (placed.withColumn("_best", best).withColumn("rule", F.col("_best.rule"))
            .withColumn("verdict", F.coalesce("_best.verdict", F.lit(default))).drop("_best"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


OP10_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                            'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut),
rules(verdict, rule_host, rule_path) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
         ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
fits AS (
  SELECT host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         arg_max(verdict, length(rule_host || rule_path)) AS verdict
  FROM (SELECT DISTINCT host, path FROM parts)
  JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY host, path)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON p.host = f.host AND p.path = f.path
"""
