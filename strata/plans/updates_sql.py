"""The payment-history updates as one Spark SQL text over published views.

The text form of ``php_updates``: lateral column aliases throughout, one of
them of a window (``has_late_reversal``), and a left join that never matches a
NULL loan number.  A loan's late flag is a window over the loan, as in the
original statement; for a loan with very many rows use ``php_updates``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Views: sor_with_cx6 (the extract) and php_periods.  Parameter: :as_of (date).
PHP_UPDATES_SQL = """
SELECT a.*, p.start_month_php, p.end_month_php,
  max(a.rev_aftr_30_days) OVER (PARTITION BY a.ln_no) AS has_late_reversal,
  trunc(date_sub(a.rev_month_snapshot, 5), 'MM') AS snapshot_month,
  concat_ws('', a.pymt_hist_previous_2_yr, a.pymt_hist_previous_1_yr, a.pymt_hist_current_yr) AS php_36_original,
  add_months(trunc(CASE WHEN year(a.otod) = 1899 THEN :as_of ELSE a.otod END, 'YEAR'), -24) AS php_start_date,
  lpad(CAST(a.ln_no AS STRING), 10, '0') AS loan_number_padded,
  map('11', '0', '71', '1', '78', '2', '80', '3', '82', '4', '83', '5', '84', '6')[a.account_status] AS account_status_php_byte,
  12 * year(php_start_date) + month(php_start_date) AS start_count,
  greatest(1, 12 * year(start_month_php) + month(start_month_php) - start_count + 1) AS update_start_pos,
  least(36, 12 * year(end_month_php) + month(end_month_php) - start_count + 1) AS update_end_pos,
  CASE WHEN snapshot_month BETWEEN start_month_php AND end_month_php
       THEN 12 * year(snapshot_month) + month(snapshot_month) - start_count + 1 END AS snapshot_php_position,
  update_end_pos - update_start_pos + 1 AS span,
  CASE WHEN span < 0 THEN substring(php_36_original, greatest(1, update_start_pos + span), least(-span, update_start_pos - 1))
       ELSE substring(php_36_original, update_start_pos, span) END AS middle,
  CASE WHEN has_late_reversal AND update_start_pos > 1 AND update_end_pos < 36
       THEN substring(php_36_original, 1, update_start_pos - 1) || regexp_replace(middle, '[^B]', 'D')
            || substring(php_36_original, update_end_pos + 1)
       WHEN has_late_reversal AND update_start_pos = 1 AND update_end_pos < 36
       THEN regexp_replace(substring(php_36_original, 1, update_end_pos), '[^B]', 'D') || substring(php_36_original, update_end_pos + 1)
       WHEN has_late_reversal AND update_start_pos > 1 AND update_end_pos = 36
       THEN substring(php_36_original, 1, update_start_pos - 1) || regexp_replace(substring(php_36_original, update_start_pos), '[^B]', 'D')
       WHEN has_late_reversal THEN regexp_replace(php_36_original, '[^B]', 'D')
       WHEN NOT has_late_reversal AND snapshot_php_position = 1 AND account_status_php_byte IS NOT NULL
       THEN account_status_php_byte || substring(php_36_original, 2)
       WHEN NOT has_late_reversal AND snapshot_php_position = 36 AND account_status_php_byte IS NOT NULL
       THEN substring(php_36_original, 1, 35) || account_status_php_byte
       WHEN NOT has_late_reversal AND snapshot_php_position IS NOT NULL AND account_status_php_byte IS NOT NULL
       THEN substring(php_36_original, 1, snapshot_php_position - 1) || account_status_php_byte
            || substring(php_36_original, snapshot_php_position + 1)
       ELSE php_36_original END AS php_36_updated,
  substring(php_36_updated, 1, 12) AS new_previous_2_yr,
  substring(php_36_updated, 13, 12) AS new_previous_1_yr,
  substring(php_36_updated, 25, 12) AS new_current_yr,
  CASE WHEN new_previous_2_yr <> a.pymt_hist_previous_2_yr THEN 'Y' ELSE 'N' END AS update_prev_2_yr,
  CASE WHEN new_previous_1_yr <> a.pymt_hist_previous_1_yr THEN 'Y' ELSE 'N' END AS update_prev_1_yr,
  CASE WHEN new_current_yr <> a.pymt_hist_current_yr THEN 'Y' ELSE 'N' END AS update_current_yr
FROM {extract} a LEFT JOIN {periods} p ON a.ln_no = p.ln_no
"""

# Steps of the text that are no columns of the result.
STEPS = ("start_count", "span", "middle")


def php_updates_sql(spark: SparkSession, extract: DataFrame, periods: DataFrame, as_of) -> DataFrame:
    """``PHP_UPDATES_SQL`` over two frames under the names they have in the text."""
    return spark.sql(PHP_UPDATES_SQL, args={"as_of": as_of}, extract=extract, periods=periods).drop(*STEPS)
