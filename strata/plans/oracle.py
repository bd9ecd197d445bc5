"""SQL (DuckDB dialect) for each registered query, written from the rules.

The driver runs these on the same parquet tables (views ``orders``,
``lineitem`` ...) and compares them with the Spark results.  Nothing here
comes from the code under test: a history is a list of positions with ranges
to copy and to mark, the review is a table of outcomes looked up by its
inputs, and Student's t is found by bisection on Simpson sums.
"""

from __future__ import annotations

AS_OF_SQL = "DATE '1999-06-15'"

# Fixture F1 (one text for both engines); ``_k`` is the source order key.
F1_SQL = """
WITH fk AS (SELECT o_orderkey AS k, CAST(floor(o_orderkey/3) AS BIGINT) AS ln FROM orders),
fb AS (SELECT k, ln, DATE '1996-01-01' + CAST(ln*37 % 1500 AS INTEGER) AS base FROM fk)
SELECT k AS _k, CASE WHEN ln%211=5 THEN CAST(NULL AS BIGINT) WHEN ln%223=7 THEN ln + 10000000000 ELSE ln END AS ln_no,
 base + CAST(31*(k%3) AS INTEGER) AS rev_month_snapshot,
 CAST(date_trunc('month', base + CAST(31*(k%3) AS INTEGER)) AS DATE) AS rev_ss_month,
 base + CAST(45 AS INTEGER) AS rev_transaction_dt,
 CAST(date_trunc('month', base - CAST((ln%9-2)*60 AS INTEGER)) AS DATE) AS pymt_ss_month,
 base - CAST((ln%9-2)*60 AS INTEGER) AS pymt_tran_dt,
 CASE WHEN ln%53=0 THEN CAST(NULL AS DATE) WHEN ln%50=0 THEN DATE '1899-12-30' ELSE base - CAST(ln%700 AS INTEGER) END AS otod,
 CASE k%9 WHEN 0 THEN '11' WHEN 1 THEN '71' WHEN 2 THEN '78' WHEN 3 THEN '80' WHEN 4 THEN '82' WHEN 5 THEN '83' WHEN 6 THEN '84' WHEN 7 THEN '05' ELSE CAST(NULL AS VARCHAR) END AS account_status,
 CASE WHEN ln%41=0 THEN CAST(NULL AS BOOLEAN) WHEN k%7=0 THEN TRUE WHEN k%11=0 THEN CAST(NULL AS BOOLEAN) ELSE FALSE END AS rev_aftr_30_days,
 substring('00000B11234500B6JKLD0000', CAST(1+ln%12 AS INTEGER), 12) AS pymt_hist_previous_2_yr,
 CASE WHEN ln%37=0 THEN CAST(NULL AS VARCHAR) ELSE substring('0123450B0000D6JKL0000000', CAST(1+ln%11 AS INTEGER), 12) END AS pymt_hist_previous_1_yr,
 CASE WHEN ln%31=0 THEN CAST(NULL AS VARCHAR) ELSE substring('0000000B0000012000000000', CAST(1+ln%10 AS INTEGER), 12) END AS pymt_hist_current_yr,
 CASE WHEN ln%13=0 THEN CAST(NULL AS VARCHAR) ELSE substring('B000123456JKL0D0B00010203040506', CAST(1+ln%6 AS INTEGER), 24) END AS payment_history_profile,
 CASE ln%4 WHEN 0 THEN '11' WHEN 1 THEN '71' WHEN 2 THEN '80' ELSE CAST(NULL AS VARCHAR) END AS cx6_account_status,
 base + CAST(30*(ln%7) AS INTEGER) AS file_date,
 CASE k%8 WHEN 0 THEN CAST(NULL AS DATE) WHEN 1 THEN DATE '1899-12-30' ELSE base END AS sor_dofd,
 CASE WHEN ln%3=0 THEN 'Yes' ELSE 'No' END AS has_df_tran,
 CASE WHEN ln%4=0 THEN 'Yes' ELSE 'No' END AS has_due_date_change,
 CASE WHEN ln%5=0 THEN base - CAST(100 AS INTEGER) WHEN ln%5=1 THEN base + CAST(60 AS INTEGER) ELSE CAST(NULL AS DATE) END AS date_closed
FROM fb
"""

F1_COLUMNS = ("ln_no, rev_month_snapshot, rev_ss_month, rev_transaction_dt, pymt_ss_month, pymt_tran_dt, otod, "
              "account_status, rev_aftr_30_days, pymt_hist_previous_2_yr, pymt_hist_previous_1_yr, "
              "pymt_hist_current_yr, payment_history_profile, cx6_account_status, file_date, sor_dofd, "
              "has_df_tran, has_due_date_change, date_closed")


# Months since year 0, so that a difference counts month boundaries.
def _months(day: str) -> str:
    return f"(year({day}) * 12 + month({day}))"


def _between(a: str, b: str) -> str:
    return f"CAST({_months(b)} - {_months(a)} AS INTEGER)"


def _yn(condition: str) -> str:
    return f"(CASE WHEN {condition} THEN 'Y' ELSE 'N' END)"


# ---- histories as lists of positions ---------------------------------------------------
# A new history is: the old one's positions 1..keep, then either a new code or the
# positions mark_lo..mark_hi with everything but B marked D, then the old positions from
# ``rest`` on.  The rules only say which positions these are.

def splice_ctes(src: str, out: str, h: str) -> str:
    """CTEs that add ``spliced`` to ``src`` (columns: ``h``, late, s, e, pos, b)."""
    def at(start: str) -> str:  # from this position on; below 1 it counts from the end, 0 is the first
        return f"CASE WHEN {start} >= 1 THEN {start} WHEN {start} = 0 THEN 1 ELSE greatest(1, length({h}) + {start} + 1) END"

    def code(i: str) -> str:
        return f"substring({h}, CAST({i} AS INTEGER), 1)"

    return f"""
{out}_plan AS (
  SELECT *, CASE WHEN late THEN 'mark' WHEN late = false AND pos IS NOT NULL AND b IS NOT NULL THEN 'set' ELSE 'keep' END AS act,
    length({h}) + 1 AS beyond FROM {src}),
{out}_ranges AS (
  SELECT *,
    CASE act WHEN 'set' THEN pos - 1 WHEN 'mark' THEN s - 1 ELSE beyond - 1 END AS keep,
    CASE WHEN act <> 'mark' THEN 1 WHEN e >= s OR e = 36 THEN s ELSE greatest(e + 1, 1) END AS mark_lo,
    CASE WHEN act <> 'mark' THEN 0 WHEN e = 36 THEN beyond - 1 WHEN e >= s THEN e ELSE s - 1 END AS mark_hi,
    CASE WHEN act = 'keep' OR (act = 'mark' AND e = 36) OR (act = 'set' AND pos = 36) THEN beyond
         WHEN act = 'set' THEN {at('(pos + 1)')} ELSE {at('(e + 1)')} END AS rest
  FROM {out}_plan),
{out} AS (
  SELECT *,
    array_to_string(list_transform(range(1, keep + 1), lambda i: {code('i')}), '')
    || CASE WHEN act = 'set' THEN b ELSE '' END
    || array_to_string(list_transform(range(mark_lo, mark_hi + 1),
                                      lambda i: CASE WHEN {code('i')} IN ('', 'B') THEN {code('i')} ELSE 'D' END), '')
    || array_to_string(list_transform(range(rest, beyond), lambda i: {code('i')}), '') AS spliced
  FROM {out}_ranges)"""


def cx6_string_sql(php: str, months: str) -> str:
    """All but the last positions of a profile with a marked code become D."""
    code = f"substring({php}, CAST(i AS INTEGER), 1)"
    return (f"CASE WHEN {months} IS NOT NULL THEN array_to_string(list_transform(range(1, length({php}) + 1), lambda i: "
            f"CASE WHEN i < {months} AND strpos('123456JKL0', {code}) > 0 THEN 'D' ELSE {code} END), '') END")


def cx6_accurate_sql(php: str, late: str, snapshot: str, byte: str, as_of: str) -> str:
    return (f"CASE WHEN {late} = false AND substring({php}, 1, 1) <> 'B' "
            f"AND {snapshot} < CAST(date_trunc('month', {as_of}) AS DATE) + 6 THEN {byte} || substring({php}, 2) END")


# The whole payment-history chain as CTEs over ``src`` (F1 columns).
PHP_CTES = f"""
src_k AS ({F1_SQL}),
src AS (SELECT _k, {F1_COLUMNS} FROM src_k),
loans AS (
  SELECT ln_no AS loan, min(pymt_ss_month) AS start_month_php, max(rev_ss_month) AS end_month_php,
         bool_or(rev_aftr_30_days) AS has_late_reversal
  FROM src GROUP BY ln_no),
periods AS (SELECT loan AS ln_no, start_month_php, end_month_php FROM loans),
step1 AS (
  SELECT s.*, CASE WHEN ln_no IS NOT NULL THEN start_month_php END AS start_month_php,
    CASE WHEN ln_no IS NOT NULL THEN end_month_php END AS end_month_php, has_late_reversal,
    CAST(date_trunc('month', rev_month_snapshot - 5) AS DATE) AS snapshot_month,
    coalesce(pymt_hist_previous_2_yr, '') || coalesce(pymt_hist_previous_1_yr, '') || coalesce(pymt_hist_current_yr, '')
      AS php_36_original,
    make_date(CASE year(otod) WHEN 1899 THEN year({AS_OF_SQL}) ELSE year(otod) END - 2, 1, 1) AS php_start_date,
    CASE WHEN ln_no IS NOT NULL THEN left(CASE WHEN ln_no < 1000000000 THEN printf('%010d', ln_no)
                                               ELSE CAST(ln_no AS VARCHAR) END, 10) END AS loan_number_padded,
    CASE account_status WHEN '11' THEN '0' WHEN '71' THEN '1' WHEN '78' THEN '2' WHEN '80' THEN '3' WHEN '82' THEN '4' WHEN '83' THEN '5' WHEN '84' THEN '6' END
      AS account_status_php_byte
  FROM src s LEFT JOIN loans ON s.ln_no IS NOT DISTINCT FROM loan),
step2 AS (
  SELECT *,
    greatest(1, {_between('php_start_date', 'start_month_php')} + 1) AS update_start_pos,
    least(36, {_between('php_start_date', 'end_month_php')} + 1) AS update_end_pos,
    CASE WHEN snapshot_month BETWEEN start_month_php AND end_month_php
         THEN {_between('php_start_date', 'snapshot_month')} + 1 END AS snapshot_php_position
  FROM step1),
history AS (
  SELECT *, has_late_reversal AS late, update_start_pos AS s, update_end_pos AS e, snapshot_php_position AS pos,
         account_status_php_byte AS b FROM step2),
{splice_ctes('history', 'step3', 'php_36_original')},
updates AS (
  SELECT *, spliced AS php_36_updated,
    left(spliced, 12) AS new_previous_2_yr, left(substring(spliced, 13), 12) AS new_previous_1_yr,
    left(substring(spliced, 25), 12) AS new_current_yr,
    {_yn('left(spliced, 12) <> pymt_hist_previous_2_yr')} AS update_prev_2_yr,
    {_yn('left(substring(spliced, 13), 12) <> pymt_hist_previous_1_yr')} AS update_prev_1_yr,
    {_yn('left(substring(spliced, 25), 12) <> pymt_hist_current_yr')} AS update_current_yr
  FROM step3),
cx6 AS (
  SELECT ln_no, payment_history_profile, file_date, start_month_php AS payment_date,
    {_between('start_month_php', 'file_date')} AS months_between,
    {cx6_string_sql('payment_history_profile', _between('start_month_php', 'file_date'))} AS cx6_php_updated,
    {cx6_accurate_sql('payment_history_profile', 'has_late_reversal', 'rev_month_snapshot', 'account_status_php_byte', AS_OF_SQL)}
      AS cx6_accurate_php_updated
  FROM updates)
"""

UPDATE_COLUMNS = (F1_COLUMNS + ", start_month_php, end_month_php, snapshot_month, php_36_original, "
                  "php_start_date, loan_number_padded, account_status_php_byte, has_late_reversal, "
                  "update_start_pos, update_end_pos, snapshot_php_position, php_36_updated, new_previous_2_yr, "
                  "new_previous_1_yr, new_current_yr, update_prev_2_yr, update_prev_1_yr, update_current_yr")

# Outcomes by: deferral transaction, due date change, current history present, closed before
# the transaction's month.  Any other inputs need a review for several reasons.
REVIEW_TABLE = {
    "Yes|No|true|open": "Y - Deferral",
    "No|Yes|true|open": "Y - Due Date",
    "No|No|false|open": "Y - SOR PHP",
    "No|No|true|closed": "Y - Date Closed",
    "No|No|true|open": "N",
}
_WHEN_CLOSED = """CASE WHEN date_closed IS NULL THEN 'open'
  WHEN _months_closed < _months_transaction THEN 'closed' WHEN _months_closed >= _months_transaction THEN 'open' END""" \
    .replace("_months_closed", _months("date_closed")).replace("_months_transaction", _months("rev_transaction_dt"))
REVIEW_SQL = (
    "coalesce(map {" + ", ".join(f"'{k}': '{v}'" for k, v in REVIEW_TABLE.items()) + "}[concat_ws('|', "
    f"coalesce(has_df_tran, '?'), coalesce(has_due_date_change, '?'), pymt_hist_current_yr IS NOT NULL, {_WHEN_CLOSED})], "
    "'Y - Multi')")


def _instruction(old: str, new: str) -> str:
    return f"coalesce(loan_number_padded, '') || '////' || coalesce({old}, '') || '/' || coalesce({new}, '')"


_REAL_DELINQUENCY = "sor_dofd IS NOT NULL AND year(sor_dofd) <> 1899"
UPDATE_STRINGS = {
    "Current Year Update": f"CASE update_current_yr WHEN 'Y' THEN {_instruction('pymt_hist_current_yr', 'new_current_yr')} END",
    "Previous 1 Year Update": f"CASE update_prev_1_yr WHEN 'Y' THEN {_instruction('pymt_hist_previous_1_yr', 'new_previous_1_yr')} END",
    "DOFD Update": (f"CASE WHEN account_status = '11' AND {_REAL_DELINQUENCY} THEN "
                    + _instruction("strftime(sor_dofd, '%m%d%y')", "'0'") + " END"),
}


def _us_date(day: str) -> str:
    return f"strftime({day}, '%m/%d/%Y')"


# The report's columns that need one row only, by name.
ROW_COLUMNS = {
    "CX6 Account Number": "'51' || coalesce(loan_number_padded, '')",
    "PMT_TRANSACTION_DT": _us_date("pymt_tran_dt"),
    "Impacted_Snapshot": _us_date("rev_month_snapshot"),
    "Account Status": "account_status",
    "What Account Status Should be In Current File": "if(payment_history_profile IS NULL, '', account_status)",
    "Account Status Update Indicator": "if(payment_history_profile IS NULL, '', " + _yn(
        "cx6_account_status <> account_status AND rev_month_snapshot - 5 >= date_trunc('month', rev_transaction_dt)") + ")",
    "account_sts_CX6": "cx6_account_status",
    "payment_history_profile": "payment_history_profile",
    "AFS Current Year String": "pymt_hist_current_yr",
    "Updated AFS Current Year String": "new_current_yr",
    "AFS Current Year PHP String Update Indicator": "update_current_yr",
    "AFS Previous 1 Year String": "pymt_hist_previous_1_yr",
    "Updated AFS Previous 1 Year String": "new_previous_1_yr",
    "AFS Previous 1 Year PHP String Update Indicator": "update_prev_1_yr",
    "L_CB_1ST_DLQ_DATE": _us_date("sor_dofd"),
    "DOFD Update Indicator": _yn(f"{_REAL_DELINQUENCY} AND (coalesce(account_status = '11', false) OR coalesce(rev_aftr_30_days, false))"),
    **UPDATE_STRINGS,
    "Requires_Manual_Review": REVIEW_SQL,
}


def _named(columns: dict[str, str]) -> str:
    return ",\n    ".join(f'{sql} AS "{name}"' for name, sql in columns.items())


CX6_COUNTS_SQL = """SELECT ln_no, coalesce(cx6_accurate_php_updated, cx6_php_updated) AS "What CX6 PHP string should be",
  count(*) AS cx6_count FROM cx6 WHERE ln_no IS NOT NULL GROUP BY ALL"""

FINAL_REPORT_SQL = f"""WITH {PHP_CTES},
strings AS ({CX6_COUNTS_SQL}),
report_rows AS (SELECT ln_no, {_named(ROW_COLUMNS)} FROM updates),
paired AS (
  SELECT r.* EXCLUDE (ln_no), s."What CX6 PHP string should be", coalesce(s.cx6_count, 1) AS pair_count,
    if(payment_history_profile IS NULL, '', {_yn('payment_history_profile <> s."What CX6 PHP string should be"')})
      AS "CX6 PHP String Update Indicator"
  FROM report_rows r LEFT JOIN strings s ON r.ln_no = s.ln_no)
SELECT *, {_yn("'Y' IN (" + '"Account Status Update Indicator", "CX6 PHP String Update Indicator")')} AS "CX6_Update_Indicator"
FROM paired
"""


def php_queries() -> dict[str, str]:
    return {
        "php_periods": f"WITH {PHP_CTES} SELECT ln_no, start_month_php, end_month_php FROM periods",
        "php_late_flag": f"WITH {PHP_CTES} SELECT ln_no, rev_aftr_30_days, has_late_reversal FROM step1",
        "php_status_byte": f"WITH {PHP_CTES} SELECT account_status, account_status_php_byte FROM step1",
        "php_positions": (f"WITH {PHP_CTES} SELECT ln_no, snapshot_month, php_36_original, php_start_date, "
                          "loan_number_padded, update_start_pos, update_end_pos, snapshot_php_position FROM step2"),
        "php_updates": f"WITH {PHP_CTES} SELECT {UPDATE_COLUMNS} FROM updates",
        "php_updates_sql": f"WITH {PHP_CTES} SELECT {UPDATE_COLUMNS} FROM updates",
        "cx6_updates": (f"WITH {PHP_CTES} SELECT ln_no, payment_history_profile, file_date, payment_date, "
                        "months_between, cx6_php_updated, cx6_accurate_php_updated FROM cx6"),
        "update_strings": f"WITH {PHP_CTES} SELECT ln_no, {_named(UPDATE_STRINGS)} FROM updates",
        "manual_review": f"WITH {PHP_CTES} SELECT ln_no, {REVIEW_SQL} AS \"Requires_Manual_Review\" FROM updates",
        "final_report": FINAL_REPORT_SQL,
        "report_roundtrip": FINAL_REPORT_SQL,
    }




# ---- extract, run date ---------------------------------------------------------------

def _normalized_sql() -> str:
    cols = [c.strip() for c in F1_COLUMNS.split(",")]
    sel = ", ".join("CASE WHEN _k % 97 = 0 THEN CAST(NULL AS DATE) ELSE otod END AS otod" if c == "otod" else c
                    for c in cols)
    return f"WITH f AS ({F1_SQL}) SELECT {sel} FROM f"


# Fixture F10: which dates are unreadable goes by the order key and the name's length.
_CSV_DATES = ("rev_transaction_dt", "otod", "sor_dofd", "pymt_tran_dt", "trans_due_dt", "rev_eff_date")


def _extract_csv_sql() -> str:
    names = [c.strip() for c in F1_COLUMNS.split(",")] + ["trans_due_dt", "rev_eff_date"]
    order = [  # the extract's columns as they land
        "ln_no", "rev_month_snapshot", "rev_ss_month", "rev_transaction_dt", "pymt_ss_month", "pymt_tran_dt", "otod", "account_status",
        "rev_aftr_30_days", "pymt_hist_previous_2_yr", "pymt_hist_previous_1_yr", "pymt_hist_current_yr", "payment_history_profile",
        "cx6_account_status", "file_date", "sor_dofd", "has_df_tran", "has_due_date_change", "date_closed", "trans_due_dt", "rev_eff_date"]
    shown, read = [], []
    for c in order:
        broken = f"(_k + {len(c)}) % 97 = 0"
        if c in _CSV_DATES:
            unpadded = f"month({c}) || '/' || day({c}) || '/' || year({c})"
            text = unpadded if c in ("trans_due_dt", "rev_eff_date") else f"strftime({c}, '%m/%d/%Y')"
            shown.append(f"CASE WHEN {broken} THEN '13/45/2024' ELSE {text} END")
            read.append(f"CASE WHEN NOT ({broken}) THEN {c} END AS {c}")
        elif c == "ln_no":
            shown.append("CASE _k % 89 WHEN 1 THEN 'none' WHEN 2 THEN coalesce(ln_no::VARCHAR, '') || ',more' ELSE ln_no::VARCHAR END")
            read.append(c)
        elif c == "account_status":
            text = "account_status || CASE WHEN _k % 9 = 7 THEN ',x' ELSE '' END"
            shown.append(f"'\"' || {text} || '\"'")
            read.append(f"{text} AS {c}")
        elif c == "rev_aftr_30_days":
            shown.append(f"{c}::INT::VARCHAR")
            read.append(c)
        else:
            shown.append(f"{c}::VARCHAR")
            read.append(f"{c}::VARCHAR AS {c}")
    cells = [f"coalesce({x}, '')" for x in shown]
    line = f"CASE WHEN _k % 89 = 0 THEN {' || chr(44) || '.join(cells[:3])} ELSE {' || chr(44) || '.join(cells)} END"
    assert sorted(names) == sorted(order)
    return (f"WITH f AS (SELECT *, file_date + 1 AS trans_due_dt, file_date - 9 AS rev_eff_date FROM ({F1_SQL})) "
            f"SELECT {', '.join(read)}, NULL::VARCHAR AS bad_line FROM f WHERE _k % 89 > 2 "
            f"UNION ALL SELECT {', '.join('NULL' for _ in order)}, {line} FROM f WHERE _k % 89 <= 2")


RUN_DATE_SQL = ("SELECT CAST(max(o_orderdate) AS DATE) AS run_date, "
                "strftime(max(o_orderdate), '%m%d%Y') AS run_date_mmddyyyy FROM orders")

# ---- manifests -------------------------------------------------------------------------

_HOST_RE = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)"
_PATH_RE = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)"
MANIFEST_CTE = f"""urls AS (
  SELECT page_id AS i, length(html) AS n,
    regexp_replace(regexp_extract(url, '{_HOST_RE}', 1) || regexp_extract(url, '{_PATH_RE}', 1), '/+$', '') AS p FROM pages),
placed AS (
  SELECT i, n, CASE i % 10 WHEN 3 THEN regexp_replace(p, '/[^/]*$', '') || '/.cache/deep/' || i WHEN 4 THEN p || '/.hidden' ELSE p END AS p
  FROM urls WHERE i % 97 <> 41),
manifest AS (
  SELECT p AS path, CASE WHEN i % 17 <> 0 THEN CAST(n AS BIGINT) END AS size,
    i % 19 <> 2 AND i % 13 = 0 AS is_symlink, CASE WHEN i % 23 = 6 THEN 'dir' ELSE 'file' END AS kind
  FROM placed)"""


def _rollup_sql(hidden: str, root: str = ".") -> str:
    """Directories as prefixes of the paths; which are reported depends on the hidden rule."""
    hidden_sql = {"keep": "false", "prune": "len(list_filter(dir_names, lambda x: starts_with(x, '.'))) > 0",
                  "basename": "coalesce(starts_with(dir_names[len(dir_names)], '.'), false)"}[hidden]
    return f"""WITH {MANIFEST_CTE},
files AS (
  SELECT string_split(path, '/') AS names, CASE WHEN kind = 'file' AND NOT is_symlink THEN coalesce(size, 0) ELSE 0 END AS b,
         CASE WHEN kind = 'dir' AND NOT is_symlink THEN 0 ELSE 1 END AS leaf FROM manifest),
below AS (SELECT names[1:depth] AS dir_names, CAST(depth AS INTEGER) AS depth, b
          FROM (SELECT names, b, unnest(range(0, len(names) - leaf + 1)) AS depth FROM files)),
rollup AS (
  SELECT concat_ws('/', '{root}', CASE WHEN depth > 0 THEN array_to_string(dir_names, '/') END) AS dir, depth,
         CAST(sum(b) AS BIGINT) AS bytes
  FROM below WHERE NOT ({hidden_sql}) GROUP BY ALL)
"""


def _tight(b: str) -> str:
    x = f"CAST({b} AS DOUBLE)"
    parts = []
    for i, unit in enumerate(["B", "KB", "MB", "GB", "TB", "PB"]):
        parts.append(f"WHEN {x} / {float(1024 ** i)!r} < 1024.0 THEN printf('%.1f', {x} / {float(1024 ** i)!r}) || '{unit}'")
    return f"(CASE {' '.join(parts)} ELSE printf('%.1f', {x} / {float(1024 ** 6)!r}) || 'PB' END)"


def _integer_size(b: str) -> str:
    parts = []
    for i, unit in enumerate(["B", "K", "M", "G", "T", "P"]):
        v = f"({b} // {1024 ** i})"
        parts.append(f"WHEN {v} <= 1024 THEN CAST({v} AS VARCHAR) || '{unit}'")
    return f"(CASE {' '.join(parts)} ELSE CAST({b} // {1024 ** 6} AS VARCHAR) END)"


SIZE_LISTING_SQL = _rollup_sql("prune") + f"""
SELECT dir, depth, bytes,
  repeat('  ', depth) || CASE WHEN length({_tight('bytes')}) < 10 THEN rpad({_tight('bytes')}, 10, ' ')
                              ELSE {_tight('bytes')} END || ' ' || dir AS line_tree,
  repeat('  ', len(string_split(dir, '/')) - 1) || {_integer_size('bytes')} || '  ' || dir AS line_plain,
  printf('%8d MB  %s', CAST(ceil(bytes / 1048576.0) AS BIGINT), dir) AS line_mb
FROM rollup WHERE bytes >= {int(0.01 * 1024 * 1024)}
"""

SIZE_SPACED_SQL = _rollup_sql("keep") + """
SELECT dir, CASE WHEN bytes < 1024 THEN printf('%.1f B', bytes::DOUBLE) WHEN bytes < 1048576 THEN printf('%.1f KB', bytes / 1024.0::DOUBLE)
       ELSE printf('%.1f MB', bytes / 1048576.0::DOUBLE) END AS size  -- the pages never reach a GB
FROM rollup
"""


# The fixture's exclusions, cleaned by hand -- blanks trimmed and dropped, the
# absolute one relative to the root, the one outside the root gone.
EXCLUDED_NAMES = ["es"]
EXCLUDED_PATHS = ["blog.ththan.example.net/en", "m.ththth.example.net/en"]


def _excluded_manifest_sql() -> str:
    dirs = "(CASE kind WHEN 'dir' THEN names ELSE names[1:len(names) - 1] END)"
    prefixes = f"list_transform(range(1, len({dirs}) + 1), lambda k: array_to_string({dirs}[1:k], '/'))"
    hit = f"list_has_any({dirs}, {EXCLUDED_NAMES!r}) OR list_has_any({prefixes}, {EXCLUDED_PATHS!r})"
    return (f"WITH {MANIFEST_CTE}, c AS (SELECT *, string_split(path, '/') AS names FROM manifest), "
            f"kept AS (SELECT path, size, is_symlink, kind FROM c WHERE NOT ({hit})) ")


# Fixture F9, cleaned by hand: what each kind of entry comes to, NULL where it excludes nothing.
EXCLUDE_TABLE_SQL = f"""WITH {MANIFEST_CTE},
parts AS (SELECT page_id % 40 AS kind, regexp_extract(url, '://([^/?#]+)', 1) AS host, regexp_extract(url, '^[^:]+://[^/]+/([a-z]+)', 1) AS lang,
            regexp_extract(url, '([^/]+)/?$', 1) AS last_part FROM pages),
entries AS (
  SELECT CASE kind WHEN 3 THEN host || '/' || lang WHEN 5 THEN host WHEN 11 THEN host || '/' || lang WHEN 13 THEN CASE lang WHEN 'es' THEN lang END
              WHEN 15 THEN last_part END AS entry FROM parts),
listed AS (SELECT list(entry) FILTER (entry NOT LIKE '%/%') AS names, list(entry) FILTER (entry LIKE '%/%') AS paths FROM entries),
split AS (SELECT *, string_split(path, '/') AS all_parts FROM manifest),
placed_dirs AS (SELECT *, CASE kind WHEN 'dir' THEN all_parts ELSE all_parts[1:len(all_parts) - 1] END AS dirs FROM split)
SELECT path, size, is_symlink, kind FROM placed_dirs, listed
WHERE NOT coalesce(list_has_any(dirs, names), false)
  AND NOT coalesce(list_has_any(list_transform(range(1, len(dirs) + 1), lambda k: array_to_string(dirs[1:k], '/')), paths), false)"""

# The patterns of the fixture, each as a condition written by hand on a part of the path: its
# names up to the k-th (parts), the text of these (upto), the k-th name (name), whether it is a
# directory (is_dir), and the texts that begin at one of its names (tails).
_GLOB_RULES = {
    "find": ["name LIKE '%.html'", "length(name) = 2 AND name LIKE 'e%' AND name <> 'en'", "name LIKE 'm.th_hth%'",
             "upto LIKE 'blog.%.net/fr'", "upto LIKE 'www.%/9%'", "upto LIKE '%.example.org/de/%'"],
    "rsync": ["name LIKE '%.html'", "length(name) = 2 AND name LIKE 'e%' AND name <> 'en'", "name LIKE 'm.th_hth%'",
              "name = 'fr' AND parts[k - 1] LIKE 'blog.%.net'", "name IN ('fq', 'fr', 'fs') AND is_dir",
              "name LIKE '9%' AND len(list_filter(tails, lambda t: t LIKE 'www.%/9%')) > 0",
              "name = 'de' AND parts[k - 1] LIKE '%.example.org' AND is_dir"],
}


def _glob_sql() -> str:
    kept = " UNION ALL ".join(
        f"SELECT '{form}' AS form, path, size, is_symlink, kind FROM whole w "
        f"WHERE NOT EXISTS (SELECT 1 FROM pieces p WHERE p.id = w.id AND ({' OR '.join(f'({r})' for r in rules)}))"
        for form, rules in _GLOB_RULES.items())
    return f"""WITH {MANIFEST_CTE},
whole AS (SELECT *, row_number() OVER () AS id, string_split(path, '/') AS every FROM manifest),
cut AS (SELECT id, every, kind AS row_kind, unnest(range(1, len(every) + 1)) AS k FROM whole),
pieces AS (
  SELECT id, k, every[1:k] AS parts, array_to_string(every[1:k], '/') AS upto, every[k] AS name, k < len(every) OR row_kind = 'dir' AS is_dir,
         list_transform(range(1, k + 1), lambda j: array_to_string(every[j:k], '/')) AS tails FROM cut)
{kept}"""


def manifest_queries() -> dict[str, str]:
    excl = _excluded_manifest_sql()
    return {
        "size_rollup": _rollup_sql("prune") + "SELECT * FROM rollup",
        "size_topk": _rollup_sql("keep") + """
SELECT dir, depth, bytes, CAST(ceil(bytes / 1048576.0) AS BIGINT) AS mb
FROM rollup WHERE depth <= 2 ORDER BY bytes DESC, dir ASC LIMIT 10""",
        "size_listing": SIZE_LISTING_SQL,
        "size_spaced": SIZE_SPACED_SQL,
        "path_exclude_table": EXCLUDE_TABLE_SQL,
        "path_exclude_glob": _glob_sql(),
        "path_exclude": excl + "SELECT path, size, is_symlink, kind FROM kept",
        "manifest_table": f"WITH {MANIFEST_CTE} SELECT path, size, is_symlink, kind FROM manifest",
        "size_rollup_basename": _rollup_sql("basename", "site") + "SELECT * FROM rollup",
        "manifest_totals": excl + ("SELECT COUNT(*) AS files, CAST(COALESCE(SUM(size), 0) AS BIGINT) AS bytes "
                                   "FROM kept WHERE kind = 'file' AND NOT is_symlink"),
        "running_share": f"""WITH {MANIFEST_CTE},
r AS (SELECT path, size,
        COUNT(*) OVER w AS files_done, SUM(coalesce(size, 0)) OVER w AS bytes_done,
        COUNT(*) OVER () AS total_files, SUM(coalesce(size, 0)) OVER () AS total_bytes
      FROM manifest WHERE kind = 'file' AND NOT is_symlink
      WINDOW w AS (ORDER BY path, size NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT path, size, files_done,
  round(CAST(100 AS DOUBLE) * files_done / total_files, 6) AS files_pct,
  CAST(bytes_done AS BIGINT) AS bytes_done,
  round(CASE WHEN total_bytes > 0 THEN CAST(100 AS DOUBLE) * CAST(bytes_done AS DOUBLE) / CAST(total_bytes AS DOUBLE)
             ELSE 0.0 END, 6) AS bytes_pct
FROM r""",
    }


# ---- log-normal ------------------------------------------------------------------------

def _lognormal_sql(src: str, keys: list[str], value: str, level: float) -> str:
    """Student's t with nu degrees as sqrt(nu) * tan(angle): the angle whose share of the
    integral of cos ** (nu - 1) is the level, by 60 halvings; Simpson sums of 400 panels."""
    k = ", ".join(keys)
    part = ("list_sum(list_transform(range(0, 401), lambda i: (CASE WHEN i IN (0, 400) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) "
            "* power(cos({to} * i / 400), nu - 1))) * {to} / 1200")
    widest = "least(pi() / 2, 9.5 / sqrt(nu))"
    middle = "((lo + hi) / 2)"
    return f"""WITH RECURSIVE x AS (SELECT {k}, CASE WHEN {value} > 0 AND NOT isnan({value}) THEN ln({value}) END AS lx FROM {src}),
s AS (SELECT {k}, COUNT(lx) AS n, AVG(lx) AS mean_log, STDDEV_SAMP(lx) AS sd_log FROM x GROUP BY {k}),
degrees AS (SELECT DISTINCT CAST(n - 1 AS DOUBLE) AS nu FROM s WHERE n > 1),
halved(nu, whole, lo, hi, step) AS (
  SELECT nu, {part.format(to=widest)}, CAST(0 AS DOUBLE), {widest}, 0 FROM degrees
  UNION ALL
  SELECT nu, whole, CASE WHEN {part.format(to=middle)} < {level!r} * whole THEN {middle} ELSE lo END,
         CASE WHEN {part.format(to=middle)} < {level!r} * whole THEN hi ELSE {middle} END, step + 1
  FROM halved WHERE step < 60),
quantiles AS (SELECT nu, sqrt(nu) * tan({middle}) AS t FROM halved WHERE step = 60),
c AS (SELECT s.*, t, sd_log / sqrt(CAST(n AS DOUBLE)) AS se FROM s LEFT JOIN quantiles ON nu = n - 1)
SELECT {k}, round(exp(mean_log - t * se), 4) AS lower, round(exp(mean_log + t * se), 4) AS upper,
  round(exp(mean_log), 4) AS point_estimate, CAST({level!r} AS DOUBLE) AS confidence_level, n,
  round(mean_log, 6) AS mean_log, round(sd_log, 6) AS sd_log
FROM c"""


EVENT_VALUES_SQL = """(
  SELECT CASE WHEN event_id < 30 THEN 'thirty' WHEN event_id < 32 THEN 'two' WHEN event_id < 33 THEN 'one'
              WHEN event_id < 40 THEN 'none' ELSE event_type END AS grp,
         CASE WHEN event_id BETWEEN 33 AND 39 THEN -value ELSE value END AS value FROM events)"""


def other_queries() -> dict[str, str]:
    out = {
        "reversals_normalized": _normalized_sql(),
        "run_date": RUN_DATE_SQL,
        "extract_scan": "SELECT * FROM orders",
        "extract_csv": _extract_csv_sql(),
        "lognormal_stats": _lognormal_sql("lineitem", ["l_returnflag", "l_linestatus"], "l_extendedprice", 0.98),
        "lognormal_ci": _lognormal_sql(EVENT_VALUES_SQL, ["grp"], "value", 0.95),
    }
    out.update(manifest_queries())
    return out




# ---- text lines, XML rows, JSON --------------------------------------------------------

_TRIM = "(' ' || chr(9) || chr(13) || chr(10))"
LINES_CTE = f"""lines AS (
  SELECT regexp_extract(url, '{_HOST_RE}', 1) AS file, page_id AS line_no,
    CASE WHEN page_id % 11 = 0 THEN 'Web' || url || '=1' WHEN page_id % 7 = 0 THEN url || '='
         WHEN page_id % 5 = 0 THEN ' key' || (page_id % 3) || chr(9) || '== ' || url || ' ' ELSE url END AS line
  FROM pages)"""

# Lines of whole files: breaks made one kind, a final break cut off, numbered by place.
TEXT_LINES_CTE = """whole AS (
  SELECT 'doc-' || doc_id || '.def' AS file, CASE WHEN doc_id % 5 = 0 THEN body || brk WHEN doc_id % 7 = 0 THEN body || brk || brk
    WHEN doc_id % 13 = 0 THEN '' WHEN doc_id % 17 <> 0 THEN body END AS value
  FROM (SELECT doc_id, brk, replace('first = ' || doc_id || chr(10) || 'first = second' || chr(10) || text, chr(10), brk) AS body
        FROM (SELECT *, CASE doc_id % 3 WHEN 0 THEN chr(13) || chr(10) WHEN 1 THEN chr(13) ELSE chr(10) END AS brk FROM documents))),
plain AS (SELECT file, regexp_replace(replace(replace(value, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\\n\\z', '') AS value
          FROM whole WHERE value <> ''),
split AS (SELECT file, string_split(value, chr(10)) AS ls FROM plain),
lines AS (SELECT file, unnest(range(len(ls)))::INT AS line_no, unnest(ls) AS line FROM split)"""


def _kv_sql(lines_cte: str) -> str:
    return f"""WITH {lines_cte},
pieces AS (SELECT file, line_no, string_split(regexp_replace(line, '=$', ''), '=') AS ps FROM lines WHERE lower(left(line, 3)) <> 'web'),
p AS (SELECT file, line_no, trim(ps[1], {_TRIM}) AS key, trim(array_to_string(ps[2:], '='), {_TRIM}) AS value
      FROM pieces WHERE len(ps) > 1)
SELECT file, key, arg_max(value, line_no) AS value FROM p WHERE key <> '' GROUP BY file, key"""


SUPPLIER_ROWS_SQL = ("SELECT CAST(s_suppkey AS VARCHAR) AS ows_ID, s_name AS ows_Title, "
                     "CASE WHEN s_nationkey <> 0 THEN CAST(s_nationkey AS VARCHAR) END AS ows_Nation FROM supplier")

# ---- validation ------------------------------------------------------------------------

VALIDATION_CTE = """v AS (
  SELECT 'process_' || CAST(user_id % 10 AS VARCHAR) AS process, event_type AS test_name,
         CASE event_type WHEN 'error' THEN 'fail' WHEN 'signup' THEN 'review' ELSE 'pass' END AS status,
         'event <' || CAST(event_id AS VARCHAR) || '> & user ' || CAST(user_id AS VARCHAR) AS detail, event_id
  FROM events),
s AS (
  SELECT process,
    COUNT(*) FILTER (WHERE status = 'pass') AS pass,
    COUNT(*) FILTER (WHERE status = 'fail') AS fail,
    COUNT(*) FILTER (WHERE status = 'review') AS review,
    COUNT(*) FILTER (WHERE status IS NULL OR status NOT IN ('pass', 'fail', 'review')) AS other,
    COUNT(*) AS total
  FROM v GROUP BY process)"""


def _esc(x: str) -> str:
    return f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


# The texts that open and close a notice.
NOTICE_START = ("<html><head><style>.fail { color: red; font-weight: bold; } .review { color: orange; font-weight: bold; }"
                "</style></head><body><p>Validation tests did not all pass for process <b>")
NOTICE_END = "</table><p>Please review the validation results and take appropriate action.</p></body></html>"


def _notice_sql(rows_per_part: int) -> str:
    counts = " || ".join(f"'<tr><td>{c}</td><td>' || \"{c}\" || '</td></tr>'" for c in ("pass", "fail", "review", "other"))
    cells = " || ".join(f"'<td>' || coalesce({_esc(c)}, '') || '</td>'" for c in ("test_name", "status", "detail"))
    return f"""WITH {VALIDATION_CTE},
bad AS (
  SELECT process, '<tr class="' || coalesce({_esc('status')}, '') || '">' || {cells} || '</tr>' AS h,
    row_number() OVER (PARTITION BY process ORDER BY test_name NULLS FIRST,
      left(md5(concat_ws('|', CAST(event_id AS VARCHAR), status, detail)), 15), event_id) - 1 AS place
  FROM v WHERE status IS DISTINCT FROM 'pass'),
body AS (SELECT process, place // {rows_per_part} + 1 AS part, string_agg(h, '' ORDER BY place) AS html FROM bad GROUP BY ALL),
ends AS (SELECT *, (total - pass + {rows_per_part} - 1) // {rows_per_part} + 1 AS last FROM s WHERE total > pass)
SELECT process, CAST(part AS BIGINT) AS part, html FROM body
UNION ALL
SELECT process, 0, '{NOTICE_START}' || coalesce({_esc('process')}, '') || '</b></p><h3>Summary:</h3><table><tr><th>status</th>'
  || '<th>count</th></tr>' || {counts} || '</table><table><tr><th>test_name</th><th>status</th><th>detail</th></tr>' FROM ends
UNION ALL SELECT process, CAST(last AS BIGINT), '{NOTICE_END}' FROM ends"""


def text_queries() -> dict[str, str]:
    return {
        "kv_parse": _kv_sql(LINES_CTE),
        "text_lines": f"WITH {TEXT_LINES_CTE} SELECT file, line_no, line FROM lines",
        "text_parameters": _kv_sql(TEXT_LINES_CTE),
        "line_classes": (f"WITH {LINES_CTE} SELECT file, line_no, line, lower(left(line, 3)) = 'web' AS is_web, "
                         "lower(left(line, 4)) = 'http' AS is_url FROM lines"),
        "xml_rows": SUPPLIER_ROWS_SQL,
        "xml_rows_union": SUPPLIER_ROWS_SQL,
        "ragged_union": SUPPLIER_ROWS_SQL,
        "json_pages": """SELECT *, position // 64 AS page FROM (
  SELECT o_orderkey AS number, o_orderstatus AS state, row_number() OVER (ORDER BY o_orderstatus, o_orderkey) - 1 AS position FROM orders)""",
        "json_records_variant": """SELECT CAST(o_orderkey AS VARCHAR) AS number, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS "the customer",
  CASE WHEN o_orderkey % 5 = 0 THEN o_orderpriority END AS "priority.text", CASE WHEN o_orderkey % 7 = 0 THEN o_orderstatus = 'O' END AS open,
  CASE WHEN o_orderkey % 11 = 0 THEN '{"status":"' || o_orderstatus || '"}' END AS details,
  CASE WHEN o_orderkey % 13 = 1 THEN o_orderstatus END AS state FROM orders""",
        "json_props_variant": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
        "json_result": "SELECT CAST(o_orderkey AS VARCHAR) AS number, o_orderstatus AS state FROM orders",
        "json_props": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
        "validation_summary": f"WITH {VALIDATION_CTE} SELECT * FROM s",
        "non_passing": (f"WITH {VALIDATION_CTE} SELECT process, test_name, status, detail FROM v "
                        "WHERE status IS DISTINCT FROM 'pass'"),
        "validation_notice": _notice_sql(100),
        "join_like": ("SELECT p_name, p_partkey, l_orderkey, l_linenumber, l_quantity FROM part "
                      "JOIN lineitem ON p_partkey = l_partkey WHERE p_name LIKE 'red%'"),
        "join_like_nocase": ("SELECT p_name, printf('part-%x', p_partkey) AS p_code, 'PART-' || upper(printf('%x', l_partkey)) AS l_code, "
                             "l_orderkey, l_linenumber FROM part JOIN lineitem ON p_partkey = l_partkey WHERE p_name ILIKE 'red%'"),
    }




# ---- factored report ------------------------------------------------------------------

def factored_report_queries() -> dict[str, str]:
    return {
        "report_rows": f"WITH {PHP_CTES} SELECT ln_no, {_named(ROW_COLUMNS)} FROM updates",
        "report_cx6_strings": f"WITH {PHP_CTES} {CX6_COUNTS_SQL}",
    }


def oracle_sql() -> dict[str, str]:
    out = {}
    out.update(php_queries())
    out.update(other_queries())
    out.update(text_queries())
    out.update(factored_report_queries())
    return out
