"""Payment-history (PHP) correction over a reversal extract.

Input: one row per reversal with at least ``ln_no``, ``rev_month_snapshot``,
``rev_ss_month``, ``pymt_ss_month``, ``otod``, ``account_status``,
``rev_aftr_30_days`` and the three yearly history strings
``pymt_hist_previous_2_yr``, ``pymt_hist_previous_1_yr``,
``pymt_hist_current_yr`` (12 characters each, one per month, oldest first).

Plan shape: the per-loan facts (first payment month, last snapshot month, any
late reversal) are one ``groupBy('ln_no')`` with map-side partial aggregation,
joined back to the rows on ``ln_no``.  The per-loan table has one row per loan,
so AQE broadcasts it when it is small and otherwise sort-merges with skew
splitting of hot loans; no window ever holds a whole loan in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions.dates import (
    as_date, is_sentinel, month_diff, snapshot_month, year_start,
)
from strata.functions.strings import concat_skip_null, mask_except, substring_neg

# Account status code -> one-character history code.
STATUS_BYTE = {"11": "0", "71": "1", "78": "2", "80": "3", "82": "4", "83": "5", "84": "6"}
# History length in months, and the code marking a corrected month.
HISTORY_MONTHS = 36
CORRECTED = "D"
BANKRUPTCY = "B"

_STATS_KEY = "_loan_key"
_TO_END = 1 << 30


def php_periods(df: DataFrame) -> DataFrame:
    """Per loan: earliest payment month and latest snapshot month.

    The NULL loan number forms its own group, like SQL GROUP BY.
    """
    return df.groupBy("ln_no").agg(
        F.min("pymt_ss_month").alias("start_month_php"),
        F.max("rev_ss_month").alias("end_month_php"),
    )


def _loan_stats(df: DataFrame) -> DataFrame:
    # One struct column, so that every consumer reads the same aggregate and
    # Spark can reuse its exchange instead of re-aggregating per branch.
    # Grouped by ln_no, not by the null-safe join keys: the per-loan side then
    # reaches the join through a shuffle of its own (small: one row per loan),
    # and only a join of two shuffles lets AQE split a hot loan's partition
    # of the row side.  Grouping on the join keys would save that small
    # shuffle but leave a loan with a third of the rows in one task.
    return df.groupBy(F.col("ln_no").alias(_STATS_KEY)).agg(F.struct(
        F.min("pymt_ss_month").alias("start_month_php"),
        F.max("rev_ss_month").alias("end_month_php"),
        F.max(F.col("rev_aftr_30_days").cast("boolean")).alias("has_late_reversal"),
    ).alias("_loan"))


def with_loan_stats(df: DataFrame) -> DataFrame:
    """Attach ``start_month_php``, ``end_month_php`` and ``has_late_reversal``.

    The late flag is a whole-loan maximum where NULL loan numbers count as one
    loan; the two periods come from an equi-join, which never matches a NULL
    loan number, so they are NULL there.
    """
    stats = _loan_stats(df)
    joined = df.join(stats, F.col("ln_no").eqNullSafe(F.col(_STATS_KEY)), "left").drop(_STATS_KEY)
    known = F.col("ln_no").isNotNull()
    return joined.withColumns({
        "start_month_php": F.when(known, F.col("_loan.start_month_php")),
        "end_month_php": F.when(known, F.col("_loan.end_month_php")),
        "has_late_reversal": F.col("_loan.has_late_reversal"),
    }).drop("_loan")


with_periods = with_loan_stats


def with_late_flag(df: DataFrame) -> DataFrame:
    """Per row, whether any reversal of the same loan came more than 30 days late."""
    stats = df.groupBy(F.col("ln_no").alias(_STATS_KEY)).agg(
        F.max(F.col("rev_aftr_30_days").cast("boolean")).alias("has_late_reversal"))
    return df.join(stats, F.col("ln_no").eqNullSafe(F.col(_STATS_KEY)), "left").drop(_STATS_KEY)


def status_byte(status) -> Column:
    s = F.col(status) if isinstance(status, str) else status
    expr = None
    for code, byte in STATUS_BYTE.items():
        expr = F.when(s == code, F.lit(byte)) if expr is None else expr.when(s == code, F.lit(byte))
    return expr


def padded_loan_number(ln) -> Column:
    """Loan number as text, left-padded with zeros to 10 (longer ones are cut)."""
    c = F.col(ln) if isinstance(ln, str) else ln
    return F.lpad(c.cast("string"), 10, "0")


def with_status_byte(df: DataFrame) -> DataFrame:
    return df.withColumn("account_status_php_byte", status_byte("account_status"))


def with_positions(df: DataFrame, as_of=None) -> DataFrame:
    """Derived positions of the 36-month history; needs the loan stats columns.

    ``as_of`` replaces the clock (date, ISO text or Column; None = today).
    """
    as_of = as_date(as_of)
    start_year = F.when(is_sentinel("otod"), as_of).otherwise(F.col("otod"))
    df = df.withColumns({
        "snapshot_month": snapshot_month("rev_month_snapshot"),
        "php_36_original": concat_skip_null("pymt_hist_previous_2_yr", "pymt_hist_previous_1_yr",
                                            "pymt_hist_current_yr"),
        "php_start_date": F.add_months(year_start(start_year), -24),
        "loan_number_padded": padded_loan_number("ln_no"),
        "account_status_php_byte": status_byte("account_status"),
    })
    in_period = F.col("snapshot_month").between(F.col("start_month_php"), F.col("end_month_php"))
    return df.withColumns({
        "update_start_pos": F.greatest(F.lit(1), month_diff("php_start_date", "start_month_php") + 1),
        "update_end_pos": F.least(F.lit(HISTORY_MONTHS), month_diff("php_start_date", "end_month_php") + 1),
        "snapshot_php_position": F.when(in_period, month_diff("php_start_date", "snapshot_month") + 1),
    })


def _updated_history() -> Column:
    h = F.col("php_36_original")
    s, e = F.col("update_start_pos"), F.col("update_end_pos")
    pos, byte = F.col("snapshot_php_position"), F.col("account_status_php_byte")
    n = HISTORY_MONTHS

    def mark(x: Column) -> Column:
        return mask_except(x, BANKRUPTCY, CORRECTED)

    late = (F.when((s > 1) & (e < n),
                   F.concat(h.substr(F.lit(1), s - 1), mark(substring_neg(h, s, e - s + 1)), _tail(h, e + 1)))
            .when((s == 1) & (e < n), F.concat(mark(h.substr(F.lit(1), e)), _tail(h, e + 1)))
            .when((s > 1) & (e == n), F.concat(h.substr(F.lit(1), s - 1), mark(_tail(h, s))))
            .otherwise(mark(h)))
    single = (F.when(pos == 1, F.concat(byte, _tail(h, F.lit(2))))
              .when(pos == n, F.concat(h.substr(F.lit(1), F.lit(n - 1)), byte))
              .otherwise(F.concat(h.substr(F.lit(1), pos - 1), byte, _tail(h, pos + 1))))
    flag = F.col("has_late_reversal")
    return (F.when(flag, late)
            .when(~flag & pos.isNotNull() & byte.isNotNull(), single)
            .otherwise(h))


def _tail(h: Column, start: Column) -> Column:
    """``substring(h, start)`` to the end; start 0 is the whole string and a
    negative start counts from the end."""
    return h.substr(start, F.lit(_TO_END))


def php_updates(df: DataFrame, as_of=None) -> DataFrame:
    """The corrected 36-month history per reversal row and its yearly pieces.

    Late loans (any reversal more than 30 days late) get every month from the
    loan's first payment month to its last snapshot month marked ``D``, except
    bankruptcy months ``B``.  Other rows get the account-status code written
    at the snapshot month's position.  The result is split back into three
    12-month strings with a Y/N change flag each.
    """
    df = with_positions(with_loan_stats(df), as_of)
    df = df.withColumn("php_36_updated", _updated_history())
    df = df.withColumns({
        "new_previous_2_yr": F.col("php_36_updated").substr(1, 12),
        "new_previous_1_yr": F.col("php_36_updated").substr(13, 12),
        "new_current_yr": F.col("php_36_updated").substr(25, 12),
    })

    def changed(new: str, old: str) -> Column:
        return F.when(F.col(new) != F.col(old), "Y").otherwise("N")

    return df.withColumns({
        "update_prev_2_yr": changed("new_previous_2_yr", "pymt_hist_previous_2_yr"),
        "update_prev_1_yr": changed("new_previous_1_yr", "pymt_hist_previous_1_yr"),
        "update_current_yr": changed("new_current_yr", "pymt_hist_current_yr"),
    })
