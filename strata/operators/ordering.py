"""Exact running totals and positions over a whole table's order.

No window spans the table and nothing is collected: the rows are range-
partitioned by Spark and written, each partition's totals (one row a
partition) give its start, and a row needs only the rows of its partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.session import scratch_path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: its partitions are then facts,
    which a retried task or a lost executor can't deal out anew."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running_totals(rows: DataFrame, order: list[str], totals: dict[str, str], partitions: int | None = None) -> DataFrame:
    """``rows`` with, for each value -> name of ``totals``, the value's sum over all
    rows before (``name``) and over the table (``name_all``).

    ``order`` must be a key of the rows: equal ones would lie in one partition
    whatever their number, so count them first.  NULLs come first.  Names that
    begin with ``_rt`` are taken."""
    keys = [F.col(c) for c in order]
    dealt = rows.repartitionByRange(partitions, *keys) if partitions else rows.repartitionByRange(*keys)
    dealt = written(dealt.withColumn("_rt", F.spark_partition_id()), "in-order")
    sums = dealt.groupBy("_rt").agg(*[F.sum(v).alias(f"_rt_{n}") for v, n in totals.items()])
    before = Window.orderBy("_rt").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def zero(c: Column) -> Column:
        return F.coalesce(c, F.lit(0).cast("long"))

    starts = sums.select("_rt", *[zero(F.sum(f"_rt_{n}").over(before)).alias(f"_rt_{n}") for n in totals.values()],
                         *[zero(F.sum(f"_rt_{n}").over(everything)).alias(f"{n}_all") for n in totals.values()])
    earlier = Window.partitionBy("_rt").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    return dealt.join(starts, "_rt").select(
        *rows.columns, *[(F.col(f"_rt_{n}") + zero(F.sum(v).over(earlier))).alias(n) for v, n in totals.items()],
        *[f"{n}_all" for n in totals.values()])


def numbered(rows: DataFrame, order: list[str], name: str = "position", partitions: int | None = None) -> DataFrame:
    """All rows with their position (0, 1, ...) in the order of their columns,
    ``order`` first.  Equal rows are counted before they are sorted and
    expanded after, so they follow each other and any number may be equal."""
    rest = [c for c in rows.columns if c not in order]
    counted = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_rt_n"))
    placed = running_totals(counted, [*order, *rest], {"_rt_n": "_rt_first"}, partitions)
    placed = placed.withColumn("_rt_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_rt_n") - 1)))
    return placed.select(*rows.columns, (F.col("_rt_first") + F.col("_rt_i")).alias(name))
