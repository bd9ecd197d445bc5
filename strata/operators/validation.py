"""Validation results: per-process summary, non-passing rows, notices.

Input rows: ``process, test_name, status, detail`` (status ``pass``,
``fail`` or ``review``).  A notice is produced for each process where some
test did not pass.  Its HTML is returned in parts (``process, part, html``):
part 0 opens the notice with the summary table, parts 1..P list the
non-passing rows, exactly ``rows_per_part`` each but the last, and part P+1
closes it.  Joining a process's parts in order gives the whole notice, its rows
in the order of the test names, and no part ever holds an unbounded list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.strings import html_escape

# Status names and notice texts.
PASS, FAIL, REVIEW = "pass", "fail", "review"
STATUSES = (PASS, FAIL, REVIEW)
NOTICE_STYLE = ("<style>.fail { color: red; font-weight: bold; } "
                ".review { color: orange; font-weight: bold; }</style>")
NOTICE_OPEN = f"<html><head>{NOTICE_STYLE}</head><body><p>Validation tests did not all pass for process <b>"
NOTICE_CLOSE = "</table><p>Please review the validation results and take appropriate action.</p></body></html>"


def validation_summary(df: DataFrame) -> DataFrame:
    """Per process: number of results per status, other statuses and total."""
    st = F.col("status")
    counts = [F.count(F.when(st == s, 1)).alias(s) for s in STATUSES]
    other = F.count(F.when(~st.isin(*STATUSES) | st.isNull(), 1)).alias("other")
    return df.groupBy("process").agg(*counts, other, F.count(F.lit(1)).alias("total"))


def non_passing(df: DataFrame) -> DataFrame:
    return df.where(~F.col("status").eqNullSafe(PASS))


def _cell(c: Column) -> Column:
    return F.concat(F.lit("<td>"), F.coalesce(html_escape(c.cast("string")), F.lit("")), F.lit("</td>"))


BUCKET_ROWS = 10_000  # different rows of a bucket of one test, on average
_HASH_BITS = 60


def _row_order() -> Column:
    """A number below 2**60 that spreads a test's different rows evenly."""
    text = F.concat_ws("|", F.coalesce(F.col("_key"), F.lit("")), "status", "detail")
    return F.conv(F.substring(F.md5(text), 1, _HASH_BITS // 4), 16, 10).cast("long")


def _numbered(bad: DataFrame) -> DataFrame:
    """The different non-passing rows with ``_n`` (how many are equal) and
    ``_before`` (rows of the process ahead of them), in the order of test name,
    then row order.

    Equal rows are counted map-side first.  A test's rows are numbered in
    buckets of the row order, as many as the test needs, and the totals of
    buckets and tests add up to the offsets: a process or a test that holds most
    rows is spread like any other.
    """
    rows = (bad.groupBy("process", "test_name", "status", "detail", "_key").agg(F.count(F.lit(1)).alias("_n"))
            .withColumn("_h", _row_order()))
    test = [F.coalesce(F.col(c), F.lit("")) for c in ("process", "test_name")]
    # one never-null key a test; the NULL process and the NULL test are their own
    rows = rows.withColumns({"_p": F.concat(F.col("process").isNull().cast("string"), F.lit(":"), test[0]),
                             "_t": F.concat(F.col("test_name").isNotNull().cast("string"), F.lit(":"), test[1])})
    tests = rows.groupBy("_p", "_t").agg(F.sum("_n").alias("_tn"), F.count(F.lit(1)).alias("_different"))
    earlier = Window.partitionBy("_p").orderBy("_t").rowsBetween(Window.unboundedPreceding, -1)
    tests = tests.select("_p", "_t", F.coalesce(F.sum("_tn").over(earlier), F.lit(0)).alias("_t0"),
                         F.ceil(F.col("_different") / BUCKET_ROWS).alias("_buckets"))
    span = F.lit(1 << _HASH_BITS).cast("double") / F.col("_buckets")
    placed = rows.join(tests, ["_p", "_t"]).withColumn("_b", F.floor(F.col("_h") / span))
    buckets = placed.groupBy("_p", "_t", "_b").agg(F.sum("_n").alias("_bn"))
    earlier = Window.partitionBy("_p", "_t").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select("_p", "_t", "_b", F.coalesce(F.sum("_bn").over(earlier), F.lit(0)).alias("_b0"))
    order = Window.partitionBy("_p", "_t", "_b").orderBy("_h", "_key", "status", "detail")
    inside = F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.join(buckets, ["_p", "_t", "_b"]).withColumn("_before", F.col("_t0") + F.col("_b0") + inside)


def validation_notice(df: DataFrame, rows_per_part: int = 1000, row_key: str | None = None) -> DataFrame:
    """``process, part, html`` for processes with non-passing results.

    ``row_key``: a column that tells otherwise equal rows apart in the order of
    the rows of one test; it may be NULL or the same on every row.
    """
    key = F.col(row_key).cast("string") if row_key else F.lit(None).cast("string")
    # One struct-valued summary read by both branches, so the plans under its
    # exchange are identical and AQE reuses the aggregate instead of redoing it.
    st = F.col("status")
    summary = df.groupBy("process").agg(F.struct(
        *[F.count(F.when(st == s, 1)).alias(s) for s in STATUSES],
        F.count(F.when(~st.isin(*STATUSES) | st.isNull(), 1)).alias("other"),
        F.count(F.lit(1)).alias("total")).alias("_s"))
    bad_count = F.col("_s.total") - F.col(f"_s.{PASS}")
    summary = summary.where(bad_count > 0).withColumn(
        "_parts", F.ceil(bad_count / F.lit(float(rows_per_part))).cast("long"))

    row_html = F.concat(
        F.lit("<tr class=\""), html_escape(F.coalesce(st, F.lit(""))), F.lit("\">"),
        _cell(F.col("test_name")), _cell(st), _cell(F.col("detail")), F.lit("</tr>"))
    rows = _numbered(non_passing(df).withColumn("_key", key))
    last = F.col("_before") + F.col("_n") - 1
    first_part, last_part = F.floor(F.col("_before") / rows_per_part), F.floor(last / rows_per_part)
    # equal rows that reach over several parts give one piece to each
    pieces = rows.withColumn("_part", F.explode(F.sequence(first_part, last_part)))
    start = F.greatest("_before", F.col("_part") * rows_per_part)
    end = F.least(last, (F.col("_part") + 1) * rows_per_part - 1)
    piece = F.struct(start.alias("at"), F.repeat(row_html, (end - start + 1).cast("int")).alias("h"))
    body = pieces.groupBy("process", (F.col("_part") + 1).alias("part")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda r: r["h"]), "").alias("html"))

    head_html = F.concat(
        F.lit(NOTICE_OPEN), html_escape(F.coalesce(F.col("process").cast("string"), F.lit(""))),
        F.lit("</b></p><h3>Summary:</h3>"),
        F.lit("<table><tr><th>status</th><th>count</th></tr>"),
        *[F.concat(F.lit(f"<tr><td>{s}</td><td>"), F.col(f"_s.{s}").cast("string"), F.lit("</td></tr>"))
          for s in (*STATUSES, "other")],
        F.lit("</table><table><tr><th>test_name</th><th>status</th><th>detail</th></tr>"))
    # head (part 0) and tail (part P+1) of each notice from one pass over the summary
    ends = summary.select("process", F.explode(F.array(
        F.struct(F.lit(0).cast("long").alias("part"), head_html.alias("html")),
        F.struct((F.col("_parts") + 1).alias("part"), F.lit(NOTICE_CLOSE).alias("html")))).alias("_e"))
    return ends.select("process", "_e.part", "_e.html").unionByName(
        body.withColumn("part", F.col("part").cast("long")))
