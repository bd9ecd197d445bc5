"""Small helpers that the training-data operators share."""

from __future__ import annotations

import os
import string

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.session import scratch_path

ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20

# Words of a text for sizes and shingles: runs of anything but these blanks.
BLANK_WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def for_workers(docs: DataFrame) -> DataFrame:
    """``docs``, with the session made ready for tasks that read whole texts.

    Unless the session has a limit of its own, an Arrow batch holds ``BATCH_BYTES``
    at most: ten thousand very long texts at once would not fit a worker.  The
    folder of this package goes on the Python path of the tasks to come, so local
    workers find it from any working directory; on a cluster the package is
    shipped with the job, and a folder that isn't there does no harm.
    """
    conf = docs.sparkSession.conf
    if ARROW_BYTES not in conf.getAll:
        conf.set(ARROW_BYTES, BATCH_BYTES)
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    try:
        environment = docs.sparkSession.sparkContext.environment
    except PySparkException:  # a remote session has no context
        return docs
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, root])
    return docs


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, read many
    times, and still there when an executor is lost."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lower_az(text: Column) -> Column:
    """Lower-cases A-Z only; every other character stays."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def crc_mod(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor`` (a null id counts as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % divisor


def row_key(doc_id: Column, content: Column) -> Column:
    """A never-null join key of a row: its id and a digest of its content."""
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), content)


def keep_rows(docs: DataFrame, key: Column, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose key is in ``kept`` (its one column), one row a
    key.  Repeats are reduced to one before the shuffle, so a task receives a row
    of each other task at most; the join uses the same partitioning and order, so
    the texts move once.  Rows that share a key but differ in other columns are
    told apart by a hash of those."""
    name, row, rank = "__llm_key", "__llm_row", "__llm_rank"  # apart from any column of the documents
    plain = [F.col(f"`{c}`") for c, kind in docs.dtypes if not any(k in kind for k in ("map<", "variant"))]
    one = (docs.select(key.alias(name), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row),
                       F.xxhash64(*plain).alias(rank))
           .groupBy(name).agg(F.min_by(row, rank).alias(row)))
    return one.join(kept.toDF(name), name, "left_semi").select(f"{row}.*")


def hash_sample(rows: DataFrame, group: str, size: int) -> list:
    """At most ``size`` rows (collected) of each value of ``group``: those whose
    doc_id hashes lowest.  Rows above a group's share of the hash range are
    dropped where they are read, so no group is gathered or shuffled."""
    top = 1 << 31
    counts = {r[0]: r[1] for r in rows.groupBy(group).count().collect()}  # one row a group
    if not counts:
        return []
    # a fifth more than wanted and some: fewer than wanted would pass only rarely, and that is no harm
    limits = F.coalesce(*[F.when(F.col(group).eqNullSafe(F.lit(g)), F.lit(min(top, int(top * (1.2 * size + 50) / n))))
                          for g, n in counts.items()])
    hashed = rows.withColumn("_h", F.pmod(F.xxhash64("doc_id"), F.lit(top))).where(F.col("_h") < limits)
    kept, taken = [], {g: 0 for g in counts}
    for row in sorted(hashed.collect(), key=lambda r: (r["_h"], *map(str, r))):
        if taken[row[group]] < size:
            taken[row[group]] += 1
            kept.append(row)
    return kept


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the crc32 of an ASCII text: eight shifts a byte from all
    ones, by the reversed polynomial, and all bits turned at the end."""
    shift = "lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    byte = f"xor(crc, ascii(substr({text}, place::INT, 1))::BIGINT)"
    return (f"xor(4294967295, list_reduce(range(1, length({text}) + 1), "
            f"lambda crc, place: list_reduce(range(8), {shift}, {byte}), 4294967295::BIGINT))")
