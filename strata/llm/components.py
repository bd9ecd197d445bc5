"""Connected components of a link table, by alternating large and small stars.

Every round is written to the shared folder, so neither lineage nor memory
grows with the rounds, and a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import written


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(links: DataFrame) -> DataFrame:
    near = _both_ways(links)
    low = near.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    return near.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    lower = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return lower.union(low.select("a", F.col("m").alias("b")))


def _tidy(links: DataFrame) -> DataFrame:
    return links.where("a != b").distinct()


def _mark(links: DataFrame):
    return links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b, both long) but the roots:
    root is the smallest node of the component."""
    links = written(_tidy(links), "links")
    mark = _mark(links)
    while True:
        links = written(_tidy(_small_star(_tidy(_large_star(links)))), "links")
        last, mark = mark, _mark(links)
        if mark == last:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
