"""CX6 history corrections and the review report.

``final_report`` reproduces the report whose rows pair every reversal of a
loan with every CX6 correction of the same loan (a loan with k rows yields k*k
report rows).  Emitting those pairs one by one grows quadratically with a hot
loan, so the CX6 side is first reduced to ``(ln_no, cx6 string) -> count``
(map-side partial aggregation) and joined to the rows: the result has one row
per (reversal row, distinct CX6 string of its loan) with ``pair_count``, an
exact, expandable form of the paired report.  ``report_rows`` and
``report_cx6_strings`` give the fully factored form that holds no pair at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions.dates import as_date, fmt_mdy, fmt_mdy_short, is_sentinel, month_diff, month_start
from strata.functions.strings import concat_skip_null, mask_chars
from strata.operators.payment_history import BANKRUPTCY, CORRECTED, padded_loan_number

# History codes rewritten to ``D`` in the CX6 profile.
CX6_MARKED = "123456JKL0"
# Report column names, in report order.
REPORT_COLUMNS = [
    "CX6 Account Number", "PMT_TRANSACTION_DT", "Impacted_Snapshot", "Account Status",
    "What Account Status Should be In Current File", "Account Status Update Indicator",
    "account_sts_CX6", "What CX6 PHP string should be", "payment_history_profile",
    "CX6 PHP String Update Indicator", "CX6_Update_Indicator", "AFS Current Year String",
    "Updated AFS Current Year String", "AFS Current Year PHP String Update Indicator",
    "AFS Previous 1 Year String", "Updated AFS Previous 1 Year String",
    "AFS Previous 1 Year PHP String Update Indicator", "L_CB_1ST_DLQ_DATE", "DOFD Update Indicator",
    "Current Year Update", "Previous 1 Year Update", "DOFD Update", "Requires_Manual_Review",
]
# Manual-review outcomes.
REVIEW_DEFERRAL, REVIEW_DUE_DATE, REVIEW_SOR, REVIEW_CLOSED, REVIEW_NONE, REVIEW_MULTI = (
    "Y - Deferral", "Y - Due Date", "Y - SOR PHP", "Y - Date Closed", "N", "Y - Multi")
# Days after the month start that still count as that month.
GRACE_DAYS = 5
# Updates columns the row side of the report is computed from.
REPORT_INPUTS = [
    "pymt_tran_dt", "rev_month_snapshot", "rev_transaction_dt", "account_status", "cx6_account_status",
    "payment_history_profile", "pymt_hist_current_yr", "new_current_yr", "update_current_yr",
    "pymt_hist_previous_1_yr", "new_previous_1_yr", "update_prev_1_yr", "sor_dofd", "rev_aftr_30_days",
    "has_df_tran", "has_due_date_change", "date_closed",
]


def cx6_columns(as_of=None) -> dict[str, Column]:
    """CX6 corrections of one updates row (needs ``start_month_php``)."""
    as_of = as_date(as_of)
    php = F.col("payment_history_profile")
    mb = F.col("months_between")
    rewritten = F.concat(mask_chars(php.substr(F.lit(1), mb - 1), CX6_MARKED, CORRECTED),
                         php.substr(mb, F.lit(1 << 30)))
    cutoff = F.date_add(month_start(as_of), GRACE_DAYS)
    return {
        "payment_date": F.col("start_month_php"),
        "months_between": month_diff("start_month_php", "file_date"),
        "cx6_php_updated": F.when(php.isNull(), F.lit(None).cast("string"))
                            .when(mb <= 1, php).otherwise(rewritten),
        "cx6_accurate_php_updated": F.when(
            ~F.col("has_late_reversal") & php.isNotNull()
            & (F.col("rev_month_snapshot") <= cutoff) & (php.substr(1, 1) != BANKRUPTCY),
            F.concat(F.col("account_status_php_byte"), php.substr(F.lit(2), F.lit(1 << 30)))),
    }


def cx6_updates(updates: DataFrame, as_of=None) -> DataFrame:
    """Per updates row: months from first payment month to file date and the
    rewritten CX6 profile.  The period columns already on ``updates`` are the
    per-loan join result, so no second join is needed."""
    cols = cx6_columns(as_of)
    out = updates.withColumns({"payment_date": cols["payment_date"], "months_between": cols["months_between"]})
    out = out.withColumns({k: cols[k] for k in ("cx6_php_updated", "cx6_accurate_php_updated")})
    return out.select("ln_no", "payment_history_profile", "file_date", "payment_date", "months_between",
                      "cx6_php_updated", "cx6_accurate_php_updated")


def _review() -> Column:
    df_yes, df_no = F.col("has_df_tran") == "Yes", F.col("has_df_tran") == "No"
    dd_yes, dd_no = F.col("has_due_date_change") == "Yes", F.col("has_due_date_change") == "No"
    cur = F.col("pymt_hist_current_yr")
    closed = F.col("date_closed")
    txn_month = month_start("rev_transaction_dt")
    open_at_txn = closed.isNull() | (closed >= txn_month)
    closed_before = closed.isNotNull() & (closed < txn_month)
    return (F.when(df_yes & dd_no & cur.isNotNull() & open_at_txn, REVIEW_DEFERRAL)
            .when(df_no & dd_yes & cur.isNotNull() & open_at_txn, REVIEW_DUE_DATE)
            .when(df_no & dd_no & cur.isNull() & open_at_txn, REVIEW_SOR)
            .when(df_no & dd_no & cur.isNotNull() & closed_before, REVIEW_CLOSED)
            .when(df_no & dd_no & cur.isNotNull() & open_at_txn, REVIEW_NONE)
            .otherwise(REVIEW_MULTI))


def _update_string_columns() -> dict[str, Column]:
    pad = F.col("loan_number_padded")
    dofd = F.col("sor_dofd")
    dofd_real = dofd.isNotNull() & ~is_sentinel(dofd)
    return {
        "Current Year Update": F.when(
            F.col("update_current_yr") == "Y",
            concat_skip_null(pad, F.lit("////"), "pymt_hist_current_yr", F.lit("/"), "new_current_yr")),
        "Previous 1 Year Update": F.when(
            F.col("update_prev_1_yr") == "Y",
            concat_skip_null(pad, F.lit("////"), "pymt_hist_previous_1_yr", F.lit("/"), "new_previous_1_yr")),
        "DOFD Update": F.when(
            dofd_real & (F.col("account_status") == "11"),
            concat_skip_null(pad, F.lit("////"), fmt_mdy_short(dofd), F.lit("/"), F.lit("0"))),
    }


def update_strings(updates: DataFrame) -> DataFrame:
    """Slash-separated update instructions per updates row."""
    return updates.select("ln_no", *[c.alias(n) for n, c in _update_string_columns().items()])


def manual_review(df: DataFrame) -> DataFrame:
    """Manual-review outcome per row.  Reads extract columns only
    (has_df_tran, has_due_date_change, pymt_hist_current_yr, date_closed,
    rev_transaction_dt), so it runs on the extract or on the updates frame."""
    return df.select("ln_no", _review().alias("Requires_Manual_Review"))


def _row_side_columns() -> dict[str, Column]:
    """Report columns that depend only on the updates row."""
    php = F.col("payment_history_profile")
    status, cx6_status = F.col("account_status"), F.col("cx6_account_status")
    dofd = F.col("sor_dofd")
    status_changed = ((F.col("rev_month_snapshot") >= F.date_add(month_start("rev_transaction_dt"), GRACE_DAYS))
                      & (cx6_status != status))
    cols = {
        "CX6 Account Number": concat_skip_null(F.lit("51"), "loan_number_padded"),
        "PMT_TRANSACTION_DT": fmt_mdy("pymt_tran_dt"),
        "Impacted_Snapshot": fmt_mdy("rev_month_snapshot"),
        "Account Status": status,
        "What Account Status Should be In Current File": F.when(php.isNotNull(), status).otherwise(""),
        "Account Status Update Indicator": F.when(php.isNull(), "").when(status_changed, "Y").otherwise("N"),
        "account_sts_CX6": cx6_status,
        "payment_history_profile": php,
        "AFS Current Year String": F.col("pymt_hist_current_yr"),
        "Updated AFS Current Year String": F.col("new_current_yr"),
        "AFS Current Year PHP String Update Indicator": F.col("update_current_yr"),
        "AFS Previous 1 Year String": F.col("pymt_hist_previous_1_yr"),
        "Updated AFS Previous 1 Year String": F.col("new_previous_1_yr"),
        "AFS Previous 1 Year PHP String Update Indicator": F.col("update_prev_1_yr"),
        "L_CB_1ST_DLQ_DATE": fmt_mdy(dofd),
        "DOFD Update Indicator": F.when(
            dofd.isNotNull() & ~is_sentinel(dofd) & ((status == "11") | F.col("rev_aftr_30_days")), "Y"
        ).otherwise("N"),
    }
    cols.update(_update_string_columns())
    cols["Requires_Manual_Review"] = _review()
    return cols


def _indicators(df: DataFrame) -> DataFrame:
    php, target = F.col("payment_history_profile"), F.col("What CX6 PHP string should be")
    df = df.withColumn("CX6 PHP String Update Indicator",
                       F.when(php.isNull(), "").when(php != target, "Y").otherwise("N"))
    return df.withColumn(
        "CX6_Update_Indicator",
        F.when((F.col("Account Status Update Indicator") == "Y") | (F.col("CX6 PHP String Update Indicator") == "Y"),
               "Y").otherwise("N"))


def final_report(updates: DataFrame, as_of=None, pairing: str = "loan") -> DataFrame:
    """The 23-column review report.

    pairing="loan" (the reference rule): every row of a loan is paired with
    the CX6 string of every row of the same loan.  Returned as one row per
    (updates row, distinct CX6 string of its loan) with ``pair_count`` = the
    number of the loan's rows giving that string; repeating each row
    ``pair_count`` times gives the paired report exactly.  Rows with a NULL
    loan number match no CX6 row and appear once with a NULL CX6 string.
    The join output is the result: no shuffle after it, so AQE may split a
    hot loan's rows over many tasks.
    pairing="row": each row with its own CX6 string, one report row per
    updates row, no join at all.

    ``updates`` is the output of ``php_updates``.
    """
    cx6 = cx6_columns(as_of)
    should_be = F.coalesce(cx6["cx6_accurate_php_updated"], cx6["cx6_php_updated"])
    if pairing == "row":
        own = updates.withColumns({"payment_date": cx6["payment_date"], "months_between": cx6["months_between"]})
        own = own.select(*[c.alias(n) for n, c in _row_side_columns().items()],
                         F.when(F.col("ln_no").isNotNull(), should_be).alias("What CX6 PHP string should be"))
        return _indicators(own).select(*[F.col(f"`{c}`") for c in REPORT_COLUMNS])
    if pairing != "loan":
        raise ValueError("pairing must be 'loan' or 'row'")
    # Only the raw inputs of the report columns cross the join's shuffle
    # (dates, codes, 12-character strings); the formatted text is built after it.
    rows = updates.select("ln_no", *REPORT_INPUTS)
    per_loan = report_cx6_strings(updates, as_of).withColumnRenamed("ln_no", "_cx6_loan") \
        .withColumnRenamed("cx6_count", "_cx6_n")
    joined = rows.join(per_loan, F.col("ln_no") == F.col("_cx6_loan"), "left").withColumn(
        "loan_number_padded", padded_loan_number("ln_no"))
    paired = _indicators(joined.select(
        *[c.alias(n) for n, c in _row_side_columns().items()], "What CX6 PHP string should be", "_cx6_n"))
    return paired.select(*[F.col(f"`{c}`") for c in REPORT_COLUMNS],
                         F.coalesce(F.col("_cx6_n"), F.lit(1)).cast("long").alias("pair_count"))


def report_rows(updates: DataFrame) -> DataFrame:
    """Factored report, part 1: one row per updates row with the 20 report
    columns that do not depend on the paired CX6 row, plus ``ln_no``."""
    return updates.select("ln_no", *[c.alias(n) for n, c in _row_side_columns().items()])


def report_cx6_strings(updates: DataFrame, as_of=None) -> DataFrame:
    """Factored report, part 2: per loan, each distinct CX6 string with the
    number of the loan's rows producing it (``cx6_count``).

    ``report_rows`` joined to this on ``ln_no`` (left join; the three
    indicator columns follow from the pair) is exactly the paired report.
    Neither part ever holds a pair, so a loan with a third of all rows costs
    one row per row plus one row per distinct string."""
    cx6 = cx6_columns(as_of)
    should_be = F.coalesce(cx6["cx6_accurate_php_updated"], cx6["cx6_php_updated"])
    return (updates.where(F.col("ln_no").isNotNull())
            .withColumns({"payment_date": cx6["payment_date"], "months_between": cx6["months_between"]})
            .groupBy(F.col("ln_no"), should_be.alias("What CX6 PHP string should be"))
            .agg(F.count(F.lit(1)).alias("cx6_count")))


def report_label_frame(spark, label: str) -> DataFrame:
    return spark.createDataFrame([(label,)], "report_label string")
