"""Randomised checks against small pure-Python models (one Spark job per batch)."""

import datetime as dt
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from strata.functions.dates import month_diff
from strata.functions.sizes import human_size
from strata.operators.textrows import kv_pairs

SETTINGS = dict(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def model_pair(line):
    """The rule as one pattern: a key without '=', the first '=', the value; one
    '=' at the very end does not belong to the line."""
    found = re.fullmatch(r"(?!web)([^=]*)=(.*)", re.sub("=$", "", line), re.IGNORECASE | re.DOTALL)
    if not found:
        return None
    key, value = (x.strip(" \t\r\n") for x in found.groups())
    return (key, value) if key else None


@settings(**SETTINGS)
@given(st.lists(st.text(alphabet="=ab \tWEBweb", min_size=0, max_size=8), min_size=1, max_size=60))
def test_kv_pairs_model(spark, lines):
    df = spark.createDataFrame([("f", i, l) for i, l in enumerate(lines)], "file string, line_no int, line string")
    got = {r.line_no: (r.key, r.value) for r in kv_pairs(df).collect()}
    want = {i: model_pair(l) for i, l in enumerate(lines) if model_pair(l) is not None}
    assert got == want


def power_of(size, past):
    """How often 1024 goes into the size: the least power at which what is left
    is below ``past`` (as an integer division or not)."""
    return next((i for i in range(6) if past(size, 1024 ** i)), 6)


def model_tight(size):
    i = power_of(size, lambda n, unit: n / unit < 1024)
    return format(size / 1024 ** i, ".1f") + ("B", "KB", "MB", "GB", "TB", "PB", "PB")[i]


def model_integer(size):
    i = power_of(size, lambda n, unit: n // unit <= 1024)
    return str(size // 1024 ** i) + ("B", "K", "M", "G", "T", "P", "")[i]


@settings(**SETTINGS)
@given(st.lists(st.one_of(st.integers(0, 5000), st.integers(0, 2 ** 62)), min_size=1, max_size=80))
def test_human_size_model(spark, sizes):
    df = spark.createDataFrame([(s,) for s in sizes], "b long")
    got = df.select(human_size("b", "tight").alias("t"), human_size("b", "integer").alias("i")).collect()
    assert [(r.t, r.i) for r in got] == [(model_tight(s), model_integer(s)) for s in sizes]


@settings(**SETTINGS)
@given(st.lists(st.tuples(st.dates(dt.date(1899, 1, 1), dt.date(2100, 12, 31)),
                          st.dates(dt.date(1899, 1, 1), dt.date(2100, 12, 31))), min_size=1, max_size=80))
def test_month_diff_model(spark, pairs):
    df = spark.createDataFrame(pairs, "a date, b date")
    got = [r[0] for r in df.select(month_diff("a", "b")).collect()]
    assert got == [(b.year - a.year) * 12 + b.month - a.month for a, b in pairs]


from strata.operators.hierarchy import clean_excludes, exclude_paths  # noqa: E402
from strata.sources.manifest import MANIFEST_SCHEMA  # noqa: E402
from test_hierarchy import brute_excluded  # noqa: E402

NAMES = ["a", "b", "src", "temp", ".git", "x"]


@settings(**SETTINGS)
@given(st.lists(st.tuples(st.lists(st.sampled_from(NAMES), min_size=1, max_size=4), st.sampled_from(["file", "dir"])),
                min_size=1, max_size=40),
       st.lists(st.one_of(st.sampled_from(NAMES),
                          st.lists(st.sampled_from(NAMES), min_size=2, max_size=3).map("/".join),
                          st.lists(st.sampled_from(NAMES), min_size=1, max_size=2).map(lambda p: "/root/" + "/".join(p))),
                max_size=4))
def test_exclusion_model(spark, entries, excludes):
    rows = [("/".join(parts), 1, False, kind) for parts, kind in entries]
    df = spark.createDataFrame(rows, MANIFEST_SCHEMA)
    import warnings
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        cleaned = clean_excludes(excludes, "/root")
        got = sorted(r.path for r in exclude_paths(df, excludes, "/root").collect())
    want = sorted(p for p, _, _, k in rows if not brute_excluded(p, k, cleaned))
    assert got == want


from strata.operators.hierarchy import size_rollup  # noqa: E402
from test_hierarchy import brute_rollup  # noqa: E402


@settings(**SETTINGS)
@given(st.lists(st.tuples(st.lists(st.sampled_from(["a", "b", ".h", "c", ".git"]), min_size=1, max_size=4),
                          st.integers(0, 1000), st.booleans(), st.sampled_from(["file", "file", "dir"])),
                min_size=1, max_size=30),
       st.sampled_from(["prune", "basename", "keep"]))
def test_rollup_model(spark, entries, hidden):
    rows = [("/".join(parts), size if kind == "file" else 0, link, kind) for parts, size, link, kind in entries]
    df = spark.createDataFrame(rows, MANIFEST_SCHEMA)
    got = {r.dir: (r.depth, r.bytes) for r in size_rollup(df, "root", hidden).collect()}
    assert got == brute_rollup(rows, "root", hidden)


from strata.operators.payment_history import _updated_history  # noqa: E402

HISTORY = 36


def rest_of(h, start):
    """From a position (counted from 1) to the end; 0 is the first, below it from the end."""
    return h[start - 1:] if start > 0 else h if start == 0 else h[start:]


def model_history(h, first, last, place, code, late):
    """Position by position: where the old characters stay, where they are marked."""
    if late:
        if last == HISTORY:
            return "".join(c if i < first or c == "B" else "D" for i, c in enumerate(h, 1))
        between = range(first, last + 1) if last >= first else range(max(1, last + 1), first)
        marked = "".join("B" if h[i - 1] == "B" else "D" for i in between if i <= len(h))
        return h[:first - 1] + marked + rest_of(h, last + 1)
    if late is False and place is not None and code is not None:
        return h[:max(0, place - 1)] + code + ("" if place == HISTORY else rest_of(h, place + 1))
    return h


@settings(**{**SETTINGS, "max_examples": 25})
@given(st.lists(st.tuples(st.text(alphabet="0123BDJKL", min_size=0, max_size=40), st.integers(1, 45),
                          st.integers(-5, 36), st.one_of(st.none(), st.integers(-5, 45)),
                          st.one_of(st.none(), st.sampled_from("0123456")), st.sampled_from([True, False, None])),
                min_size=1, max_size=60))
def test_history_rewrite_matches_model(spark, rows):
    data = [(i, h, s, e, p, b, late) for i, (h, s, e, p, b, late) in enumerate(rows)]
    df = spark.createDataFrame(data, "i int, php_36_original string, update_start_pos int, update_end_pos int, "
                                     "snapshot_php_position int, account_status_php_byte string, has_late_reversal boolean")
    got = {r.i: r.out for r in df.select("i", _updated_history().alias("out")).collect()}
    assert got == {i: model_history(*row) for i, row in enumerate(rows)}


from strata.operators.report import cx6_columns  # noqa: E402

def model_cx6(php, first, filed, snapshot, late, code):
    months = None if first is None else (filed.year - first.year) * 12 + filed.month - first.month
    marked = None
    if php is not None and months is not None:
        marked = "".join("D" if i < months and c in "0123456JKL" else c for i, c in enumerate(php, 1))
    exact = None
    if late is False and php is not None and code is not None and snapshot <= dt.date(1999, 6, 6) and not php.startswith("B"):
        exact = code + php[1:]
    return marked, exact


@settings(**{**SETTINGS, "max_examples": 20})
@given(st.lists(st.tuples(st.one_of(st.none(), st.text(alphabet="0123456BDJKL", min_size=0, max_size=30)),
                          st.one_of(st.none(), st.dates(dt.date(1995, 1, 1), dt.date(2001, 12, 1))),
                          st.dates(dt.date(1995, 1, 1), dt.date(2001, 12, 1)),
                          st.dates(dt.date(1999, 5, 1), dt.date(1999, 7, 1)),
                          st.sampled_from([True, False, None]), st.one_of(st.none(), st.sampled_from("0123456"))),
                min_size=1, max_size=60))
def test_cx6_rewrite_matches_model(spark, rows):
    data = [(i, php, st_, fd, snap, late, b) for i, (php, st_, fd, snap, late, b) in enumerate(rows)]
    df = spark.createDataFrame(data, "i int, payment_history_profile string, start_month_php date, file_date date, "
                                     "rev_month_snapshot date, has_late_reversal boolean, account_status_php_byte string")
    cols = cx6_columns(dt.date(1999, 6, 15))
    df = df.withColumn("months_between", cols["months_between"])
    got = {r.i: (r.upd, r.acc) for r in df.select("i", cols["cx6_php_updated"].alias("upd"),
                                                   cols["cx6_accurate_php_updated"].alias("acc")).collect()}
    assert got == {i: model_cx6(*row) for i, row in enumerate(rows)}


from strata.operators.report import manual_review  # noqa: E402
from strata.plans.oracle import REVIEW_SQL  # noqa: E402


@settings(**{**SETTINGS, "max_examples": 15})
@given(st.lists(st.tuples(st.sampled_from(["Yes", "No", "Maybe", None]), st.sampled_from(["Yes", "No", None]),
                          st.one_of(st.none(), st.just("000000000000")),
                          st.one_of(st.none(), st.dates(dt.date(1998, 1, 1), dt.date(1999, 12, 31))),
                          st.dates(dt.date(1998, 1, 1), dt.date(1999, 12, 31))),
                min_size=1, max_size=60))
def test_manual_review_matches_duckdb(spark, rows):
    import duckdb
    import pandas as pd
    data = [(i, a, b, c, d, e) for i, (a, b, c, d, e) in enumerate(rows)]
    df = spark.createDataFrame(data, "ln_no long, has_df_tran string, has_due_date_change string, "
                                     "pymt_hist_current_yr string, date_closed date, rev_transaction_dt date")
    got = {r.ln_no: r.Requires_Manual_Review for r in manual_review(df).collect()}
    pdf = pd.DataFrame(data, columns=["ln_no", "has_df_tran", "has_due_date_change", "pymt_hist_current_yr",
                                      "date_closed", "rev_transaction_dt"])
    for c in ("date_closed", "rev_transaction_dt"):
        pdf[c] = pd.to_datetime(pdf[c]).dt.date
    con = duckdb.connect()
    con.register("rows", pdf)
    want = dict(con.execute(f"SELECT ln_no, {REVIEW_SQL} FROM rows").fetchall())
    assert got == want
