"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a shuffled order (by a hash of the
id, the text and a number among equals), repeated as often as its target needs.  An entry's virtual finish time is
the words its source has sent up to and with it, divided by the source's
target.  All entries are range-sorted by finish time and cut at the total
budget: at finish time 1 every source has sent its target.

Sources are ordered by code point, a null source last, and weigh 5, 2, 1,
repeating.  They share the words of all documents by weight; a target stops at
``MOST_REPEATS`` times its source's words and the excess is shared anew.

Only built-in functions run here.  Running totals go over three levels of
buckets (rows, buckets, coarse buckets), so a hot source is spread like any
other and no window holds more than a bucket.

A null or blank text has size 0 and takes nothing; a null doc_id is a value
like any other.  Equal rows are numbered and stand in the queue one by one, so
targets are met to within a document whatever repeats.  An empty table gives an empty result, a table without words gets targets of 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.llm.common import BLANK_WORD, row_key, table, written

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
BUCKET_ROWS = 512  # rows of a bucket, on average
COARSE = 1024  # buckets of a coarse bucket
_HASH_BITS = 60


def shuffle_order(doc_id: Column, text: Column, copy: Column) -> Column:
    """A number below 2**60 from the id, the text's digest and which of equal rows
    it is: reruns shuffle alike, and rows that share an id, or all they have, lie
    apart."""
    name = F.concat(F.lit("mix:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), text, F.lit(":"), copy.cast("string"))
    return F.conv(F.substring(F.md5(name), 1, _HASH_BITS // 4), 16, 10).cast("long")


def _sum_before(rows: DataFrame, group: list[str], order: str, value: str) -> Column:
    window = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(window), F.lit(0).cast("long"))


def with_running_total(rows: DataFrame, group: list[str], bucket: Column, order: list[Column], value: str) -> DataFrame:
    """``rows`` with ``running``: the sum of ``value`` up to and with the row and
    its ties, in ``order`` within ``group``.  ``bucket`` (long) must ascend with
    the order and be one for ties."""
    rows = rows.withColumn("_b", bucket).withColumn("_c", F.floor(F.col("_b") / COARSE))
    fine = rows.groupBy(*group, "_c", "_b").agg(F.sum(value).alias("_v"))
    coarse = fine.groupBy(*group, "_c").agg(F.sum("_v").alias("_v"))
    coarse = coarse.withColumn("_before_c", _sum_before(coarse, group, "_c", "_v")).drop("_v")
    fine = (fine.withColumn("_before_b", _sum_before(fine, [*group, "_c"], "_b", "_v"))
            .join(coarse, [*group, "_c"])
            .select(*group, "_c", "_b", (F.col("_before_b") + F.col("_before_c")).alias("_before")))
    window = Window.partitionBy(*group, "_c", "_b").orderBy(*order)  # up to the row, ties included
    return (rows.join(fine, [*group, "_c", "_b"])
            .withColumn("running", F.col("_before") + F.sum(value).over(window))
            .drop("_b", "_c", "_before"))


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` with ``position`` (0, 1, ...) in the order of distinct keys."""
    dealt = written(rows.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ranges")
    starts = dealt.groupBy("_p").agg(F.count("*").alias("_n"))  # one row a partition
    starts = starts.withColumn("_start", _sum_before(starts, [], "_p", "_n")).drop("_n")
    nth = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return dealt.join(starts, "_p").withColumn("position", F.col("_start") + nth - 1).drop("_p", "_start")


def _level(sources: DataFrame, budget: int) -> float:
    """Words a unit of weight gets once no target is above its cap."""
    cap, level, capped = F.col("source_size") * MOST_REPEATS, None, -1
    while True:
        over = F.lit(False) if level is None else cap <= F.lit(level) * F.col("weight")
        row = sources.agg(F.sum(F.when(over, cap).otherwise(0)).alias("full"), F.count(F.when(over, 1)).alias("n"),
                          F.sum(F.when(over, 0).otherwise(F.col("weight"))).alias("open")).first()
        if row["n"] == capped or not row["open"]:
            return level or 0.0
        capped, level = row["n"], (budget - row["full"]) / row["open"]


def source_targets(sized: DataFrame) -> DataFrame:
    """One row a source: key, position, source_size, target, repeats."""
    sources = sized.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    sources = numbered(sources, F.col("source").isNull(), F.col("source"))
    weights = F.array(*map(F.lit, WEIGHTS))
    sources = written(sources.withColumn("weight", F.get(weights, (F.col("position") % len(WEIGHTS)).cast("int"))),
                      "sources")
    budget = sources.agg(F.sum("source_size")).first()[0] or 0
    target = F.least((F.col("source_size") * MOST_REPEATS).cast("double"), F.lit(_level(sources, budget)) * F.col("weight"))
    repeats = F.when(F.col("source_size") > 0, F.least(F.ceil(target / F.col("source_size")), F.lit(MOST_REPEATS)))
    return sources.select("key", "position", "source_size", target.alias("target"),
                          F.coalesce(repeats, F.lit(0)).cast("int").alias("repeats"))


def _size() -> Column:
    return F.regexp_count(F.coalesce("text", F.lit("")), F.lit(BLANK_WORD)).cast("long")


def _key() -> Column:
    return F.when(F.col("source").isNull(), "null").otherwise(F.concat(F.lit("="), "source"))


def _digest() -> Column:
    return F.md5(F.coalesce("text", F.lit("")))


def _queues(docs: DataFrame) -> DataFrame:
    """All rows in light form, each with a place of its own in its source's queue.
    Equal rows are counted and numbered, so none waits for another."""
    equal = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", _size().alias("size"), _key().alias("key"), _digest().alias("text"))
    equal = equal.groupBy(*equal.columns).agg(F.count(F.lit(1)).alias("copies"))
    rows = equal.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return rows.withColumn("h", shuffle_order(F.col("doc_id"), F.col("text"), F.col("copy"))).drop("copy", "copies")


def weighted_fair_mix(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, times (how
    often the mix takes the document) and taken (words, repeats counted)."""
    return _mixed(written(_queues(docs), "sizes")).drop("text")


def _mixed(sized: DataFrame) -> DataFrame:
    count = sized.count()
    budget = sized.agg(F.sum("size")).first()[0] or 0
    buckets = max(1, math.ceil(count / BUCKET_ROWS))
    targets = written(source_targets(sized), "targets")
    span = (1 << _HASH_BITS) // buckets + 1
    order = [F.col("h"), F.col("doc_id"), F.col("size")]
    sent = with_running_total(sized, ["key"], F.floor(F.col("h") / F.lit(span)).cast("long"), order, "size")
    sent = written(sent.join(targets, "key").withColumn("_id", F.coalesce("doc_id", F.lit(-(1 << 63)))), "queues")

    def place(turn: Column) -> Column:
        """Where an entry stands in the mix; finish time first."""
        finish = (turn * F.col("source_size") + F.col("running")) / F.col("target")
        return F.struct(finish.alias("finish"), "position", "h", "_id", "size", turn.alias("turn"))

    turns = F.sequence(F.lit(0), F.col("repeats") - 1)
    entries = (sent.where("size > 0 AND target > 0")
               .select("size", "position", "h", "_id", "source_size", "running", "target", F.explode(turns).alias("turn"))
               .select(F.col("size").alias("words"), place(F.col("turn").cast("long")).alias("place")))
    bucket = F.floor(F.col("place.finish") * buckets).cast("long")
    cut = (with_running_total(entries, [], bucket, [F.col("place")], "words")
           .where(F.col("running") <= budget).agg(F.max("place").alias("cut")).first()["cut"])
    times = F.lit(0)
    if cut is not None:
        kinds = {"finish": "double"}  # the others are long
        last = F.struct(*[F.lit(cut[f]).cast(kinds.get(f, "long")).alias(f) for f in cut.__fields__])
        for turn in range(MOST_REPEATS):
            in_mix = (F.col("repeats") > turn) & (F.col("size") > 0) & (place(F.lit(turn).cast("long")) <= last)
            times = times + F.when(in_mix, 1).otherwise(0)
    return sent.withColumn("times", times).select(
        "doc_id", "source", "size", "text", "source_size", "target", "times", (F.col("times") * F.col("size")).alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """The documents as the mix takes them, with all their columns: a row for
    each time.  Documents without words are never taken.  Rows that agree in id,
    source and text share the times of all of them evenly, in the order of their
    other columns."""
    def key(text: Column) -> Column:
        return row_key(F.col("doc_id").cast("long"), F.concat_ws(":", text, _key()))

    mixed = _mixed(written(_queues(docs), "sizes")).groupBy(key(F.col("text")).alias("__llm_key")).agg(
        F.count(F.lit(1)).alias("__llm_rows"), F.sum("times").alias("__llm_times")).where("__llm_times > 0")
    rows = docs.withColumn("__llm_key", key(_digest())).join(written(mixed, "mix-times"), "__llm_key")
    alone, several = rows.where("__llm_rows = 1"), rows.where("__llm_rows > 1")
    # equal rows are counted first, so that the window has a row for each different one
    several = several.groupBy(*several.columns).agg(F.count(F.lit(1)).alias("__llm_equal"))
    before = F.sum("__llm_equal").over(Window.partitionBy("__llm_key").orderBy(*docs.columns).rowsBetween(Window.unboundedPreceding, -1))
    share, rest = F.floor(F.col("__llm_times") / F.col("__llm_rows")), F.col("__llm_times") % F.col("__llm_rows")
    left = F.greatest(F.least(F.col("__llm_equal"), rest - F.coalesce("__llm_before", F.lit(0))), F.lit(0))
    several = several.withColumn("__llm_before", before).withColumn("__llm_times", F.col("__llm_equal") * share + left)
    taken = alone.unionByName(several.select(*alone.columns)).where("__llm_times > 0")
    turns = F.explode(F.sequence(F.lit(1).cast("long"), F.col("__llm_times").cast("long")))
    return taken.withColumn("__llm_turn", turns).select(*docs.columns)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = weighted_fair_mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = r"""
WITH told AS (  -- equal rows are numbered
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(text, '')) AS digest,
         row_number() OVER (PARTITION BY doc_id, source, md5(coalesce(text, ''))) - 1 AS copy FROM documents),
sized AS (
  SELECT doc_id, source, size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || digest || ':' || copy), 1, 15))::BIGINT AS h FROM told),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size, (3 * sum(size))::BIGINT AS cap,
         row_number() OVER (ORDER BY source IS NULL, source) - 1 AS position
  FROM sized GROUP BY source),
weighed AS (SELECT *, [5, 2, 1][position % 3 + 1] AS weight FROM src),
ranked AS (  -- sources in the order in which they reach their cap
  SELECT *, row_number() OVER (ORDER BY cap / weight::DOUBLE, position) AS nth FROM weighed),
levels AS (  -- words a unit of weight if the first k sources are at their cap
  SELECT k, ((SELECT sum(source_size) FROM src) - coalesce((SELECT sum(cap) FROM ranked r WHERE r.nth <= k), 0))::DOUBLE
            / (SELECT sum(weight) FROM ranked r WHERE r.nth > k)::DOUBLE AS level
  FROM range((SELECT count(*) FROM src)) t(k)),
chosen AS (
  SELECT level FROM levels l
  WHERE NOT EXISTS (SELECT 1 FROM ranked r WHERE r.nth > l.k AND r.cap <= l.level * r.weight) ORDER BY k LIMIT 1),
targets AS (
  SELECT source, position, source_size, least(cap::DOUBLE, (SELECT level FROM chosen) * weight) AS target FROM weighed),
queues AS (
  SELECT s.doc_id, s.size, s.h, t.position, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN least(ceil(t.target / t.source_size), 3) ELSE 0 END AS repeats,
         sum(s.size) OVER (PARTITION BY t.position ORDER BY s.h, s.doc_id, s.size)::BIGINT AS running
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
entries AS (
  SELECT *, (turn * source_size + running) / target AS finish
  FROM queues, range(3) r(turn) WHERE turn < repeats AND size > 0),
served AS (
  SELECT *, sum(size) OVER (ORDER BY finish, position, h, doc_id, size, turn) AS total FROM entries),
taken AS (
  SELECT h, position, sum(size)::BIGINT AS taken FROM served
  WHERE total <= (SELECT sum(source_size) FROM src) GROUP BY h, position)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(t.taken, 0)::BIGINT AS taken
FROM queues q LEFT JOIN taken t ON q.h = t.h AND q.position = t.position
"""
