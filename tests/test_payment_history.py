"""Payment-history operators: hand rows, properties and branch coverage."""

import datetime as dt
from collections import Counter

from pyspark.sql import functions as F

from conftest import SF01
from strata.functions.dates import month_diff
from strata.operators.payment_history import php_periods, php_updates, with_loan_stats, with_positions
from strata.operators.report import REPORT_COLUMNS, final_report
from strata.plans import fixtures as fx

D = dt.date
COLS = ("ln_no bigint, rev_month_snapshot date, rev_ss_month date, rev_transaction_dt date, pymt_ss_month date, "
        "pymt_tran_dt date, otod date, account_status string, rev_aftr_30_days boolean, "
        "pymt_hist_previous_2_yr string, pymt_hist_previous_1_yr string, pymt_hist_current_yr string, "
        "payment_history_profile string, cx6_account_status string, file_date date, sor_dofd date, "
        "has_df_tran string, has_due_date_change string, date_closed date")


def row(ln, snap, late, status="80", otod=D(1997, 3, 1), h=("000000000000",) * 3, pay=D(1998, 2, 1),
        php="000000000000000000000000"):
    return (ln, snap, snap.replace(day=1), snap, pay, pay, otod, status, late, h[0], h[1], h[2], php, "11",
            D(1998, 9, 1), D(1998, 1, 1), "No", "No", None)


def hand(spark):
    rows = [
        row(None, D(1998, 6, 10), False),                      # NULL loan: no periods, own late group
        row(None, D(1998, 7, 10), None),
        row(7, D(1998, 6, 3), None, h=(None, None, None)),     # all three yearly strings NULL
        row(7, D(1998, 8, 20), None, h=(None, None, None)),
        row(123456789012, D(1998, 6, 10), True),              # above 10 digits: padded form is cut
        row(5, D(1998, 6, 10), False, otod=None),             # NULL otod -> NULL start date
        row(6, D(1998, 6, 10), False, otod=D(1899, 12, 30)),  # sentinel -> as-of year
    ]
    return spark.createDataFrame(rows, COLS)


def test_null_loan_and_edges(spark):
    up = {(r.ln_no, r.rev_month_snapshot): r for r in php_updates(hand(spark), fx.AS_OF).collect()}
    a = up[(None, D(1998, 6, 10))]
    assert a.start_month_php is None and a.end_month_php is None
    assert a.has_late_reversal is False          # NULL loans form one late-flag group: max(False, NULL)
    assert a.update_start_pos == 1 and a.update_end_pos == 36
    assert a.php_36_updated == a.php_36_original  # not late, no snapshot position
    b = up[(7, D(1998, 6, 3))]
    assert b.php_36_original == ""
    assert b.has_late_reversal is None and b.php_36_updated == ""
    assert b.update_prev_2_yr == "N" and b.update_current_yr == "N"
    c = up[(123456789012, D(1998, 6, 10))]
    assert c.loan_number_padded == "1234567890"
    assert c.has_late_reversal is True
    assert up[(5, D(1998, 6, 10))].php_start_date is None
    assert up[(6, D(1998, 6, 10))].php_start_date == D(1997, 1, 1)


def test_periods_group_null_loan(spark):
    got = {r.ln_no: r for r in php_periods(hand(spark)).collect()}
    assert None in got and got[None].end_month_php == D(1998, 7, 1)


def test_late_rewrite_properties(spark):
    up = php_updates(fx.reversal_extract(spark, SF01), fx.AS_OF)
    rows = up.select("has_late_reversal", "php_36_original", "php_36_updated", "new_previous_2_yr",
                     "new_previous_1_yr", "new_current_yr", "update_start_pos", "update_end_pos").collect()
    grown = 0
    for r in rows:
        if r.has_late_reversal and (r.update_end_pos < r.update_start_pos - 1 or r.update_end_pos < 0):
            # an inverted range: a negative middle length re-emits characters
            # before the start, a negative end keeps only a tail -- the rule
            # changes the length here (checked against the oracle)
            grown += len(r.php_36_updated) != len(r.php_36_original)
        elif r.has_late_reversal:
            assert len(r.php_36_updated) == len(r.php_36_original)
            assert [i for i, ch in enumerate(r.php_36_original) if ch == "B"] == \
                   [i for i, ch in enumerate(r.php_36_updated) if ch == "B"]
        assert r.new_previous_2_yr + r.new_previous_1_yr + r.new_current_yr == r.php_36_updated[:36]
    assert grown > 0


def test_branch_counts_match_fixture_notes(spark):
    up = php_updates(fx.reversal_extract(spark, SF01), fx.AS_OF)
    s, e, p = F.col("update_start_pos"), F.col("update_end_pos"), F.col("snapshot_php_position")
    late = F.col("has_late_reversal")
    counts = up.agg(
        F.count(F.when(late & (s > 1) & (e < 36), 1)).alias("inner"),
        F.count(F.when(late & (s > 1) & (e < 36) & (e < s - 1), 1)).alias("neg"),
        F.count(F.when(late & (s == 1) & (e < 36), 1)).alias("start1"),
        F.count(F.when(late & (s > 1) & (e == 36), 1)).alias("end36"),
        F.count(F.when(late.isNull(), 1)).alias("late_null"),
        F.count(F.when(~late & (p == 1), 1)).alias("pos1"),
        F.count(F.when(~late & (p > 36), 1)).alias("pos_gt36"),
        F.count(F.when(~late & (p < 1), 1)).alias("pos_lt1"),
    ).first()
    assert counts.asDict() == {"inner": 981, "neg": 108, "start1": 45, "end36": 5100, "late_null": 363,
                               "pos1": 3, "pos_gt36": 4956, "pos_lt1": 33}


def test_report_pair_counts(spark):
    src = fx.reversal_extract(spark, SF01)
    rep = final_report(php_updates(src, fx.AS_OF), fx.AS_OF)
    assert rep.columns == REPORT_COLUMNS + ["pair_count"]
    per_loan = Counter(r.ln_no for r in src.select("ln_no").collect())
    want = sum(k * k for ln, k in per_loan.items() if ln is not None) + per_loan.get(None, 0)
    assert rep.agg(F.sum("pair_count")).first()[0] == want == 3 * (15000 - 72) + 72


def test_report_hand_rows_pair_counts(spark):
    rep = final_report(php_updates(hand(spark), fx.AS_OF), fx.AS_OF)
    # NULL loans: 2 rows, one each; loan 7: 2x2; three single-row loans: 1 each
    assert rep.agg(F.sum("pair_count")).first()[0] == 2 + 4 + 3


def test_manual_review_counts(spark):
    from strata.operators.report import manual_review
    up = php_updates(fx.reversal_extract(spark, SF01), fx.AS_OF)
    got = dict(manual_review(up).groupBy("Requires_Manual_Review").count().collect())
    assert got == {"N": 5805, "Y - Deferral": 2904, "Y - Due Date": 1938, "Y - Multi": 2706,
                   "Y - Date Closed": 1452, "Y - SOR PHP": 195}


def test_cx6_month_difference_split(spark):
    up = with_loan_stats(fx.reversal_extract(spark, SF01))
    md = month_diff("start_month_php", "file_date")
    r = up.agg(F.count(F.when(md <= 1, 1)).alias("le1"), F.count(F.when(md >= 2, 1)).alias("ge2")).first()
    assert (r.le1, r.ge2) == (2883, 12045)


def test_positions_need_no_window(spark):
    df = with_positions(with_loan_stats(fx.reversal_extract(spark, SF01)), fx.AS_OF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_row_pairing_is_one_to_one(spark):
    src = fx.reversal_extract(spark, SF01)
    up = php_updates(src, fx.AS_OF)
    rows = final_report(up, fx.AS_OF, pairing="row")
    assert rows.columns == REPORT_COLUMNS and rows.count() == src.count()
    # every row-wise report row is one of the loan-paired rows
    paired = final_report(up, fx.AS_OF).drop("pair_count")
    assert rows.subtract(paired).count() == 0
