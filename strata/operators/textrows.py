"""Key/value parameters from definition-file lines.

A line is a parameter when it contains ``=`` and does not start with ``WEB``
(any case).  One trailing ``=`` is ignored (so ``E=`` is not a pair and
``T=x=`` gives ``x``); the key is the text before the first ``=`` and the
value everything after it (so ``a==b`` gives ``=b``), both trimmed of blanks,
tabs and line breaks.  Empty keys are skipped.  When a key repeats in a file
the last line wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Line classes and the characters trimmed around keys/values.
WEB_LINE = "(?i)^WEB"
URL_LINE = "(?i)^http"
TRIM_CHARS = " \t\r\n"


def classify_lines(lines: DataFrame) -> DataFrame:
    return lines.withColumns({"is_web": F.col("line").rlike(WEB_LINE), "is_url": F.col("line").rlike(URL_LINE)})


def kv_pairs(lines: DataFrame) -> DataFrame:
    """Every parameter line as ``file, line_no, key, value``."""
    line = F.col("line")
    body = F.when(line.endswith("="), line.substr(F.lit(1), F.length(line) - 1)).otherwise(line)
    parts = F.split(body, "=", 2)
    trim = F.lit(TRIM_CHARS)
    key = F.trim(F.element_at(parts, 1), trim)
    value = F.trim(F.element_at(parts, 2), trim)
    cand = lines.where(line.contains("=") & ~line.rlike(WEB_LINE))
    pairs = cand.select("file", "line_no", body.contains("=").alias("_has"), key.alias("key"), value.alias("value"))
    return pairs.where(F.col("_has") & (F.col("key") != "")).drop("_has")


def kv_parse(lines: DataFrame) -> DataFrame:
    """``file, key, value`` -- one row per key and file, last line wins."""
    return kv_pairs(lines).groupBy("file", "key").agg(F.max_by("value", "line_no").alias("value"))


def kv_map(lines: DataFrame) -> DataFrame:
    """``file, parameters`` as a map; for files of bounded key count."""
    return kv_parse(lines).groupBy("file").agg(
        F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("parameters"))


def ragged_union(*frames: DataFrame) -> DataFrame:
    """Row-bind frames by column name; columns missing in a frame are NULL."""
    if not frames:
        raise ValueError("need at least one frame")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
