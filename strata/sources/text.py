"""Lines of text files (definition files), from files or from a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LINE_BREAK = r"\r\n|\r|\n"


def scan_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line_no, line`` for every line of every file below ``path``.

    The splittable line reader, so one big file spreads over many tasks.
    ``line_no`` is an order key, not a count: ``struct(block start, row id)``
    sorts the lines of a file in file order, which is all ``kv_parse`` (last
    line wins) needs.  LF, CRLF and a lone CR all end a line; a final line
    break does not start an extra empty line; an empty file has no lines.
    """
    order = F.struct(F.col("_metadata.file_block_start").alias("block"),
                     F.monotonically_increasing_id().alias("row"))
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), order.alias("line_no"),
                                        F.col("value").alias("line"))


def explode_lines(df: DataFrame, file: Column, text: Column) -> DataFrame:
    """``file, line_no, line`` for every line of files whose whole text is in a
    column, by the line rules of ``scan_lines``; ``line_no`` counts from 0.  A
    null or empty text has no lines, a null file name stays null."""
    pieces = F.split(text, LINE_BREAK, -1)
    # the piece after a final line break is no line
    lines = F.transform(F.array(pieces), lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p))[0]
    return df.select(file.alias("file"), F.posexplode(lines).alias("line_no", "line"))
