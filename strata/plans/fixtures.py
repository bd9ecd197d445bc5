"""Inputs for the operators, derived by Spark from the driver tables.

Every derivation is a projection / aggregation of a driver table, so its size
grows with the table.  The equivalent SQL texts live in ``strata.plans.oracle``.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.sources.manifest import manifest_from_table

# Clock used by the report fixtures.
AS_OF = _dt.date(1999, 6, 15)
_BASE_DAY = _dt.date(1996, 1, 1)
_SENTINEL = _dt.date(1899, 12, 30)
# History strings the fixture cuts 12/24-character windows from.
_PREV2_SRC = "00000B11234500B6JKLD0000"
_PREV1_SRC = "0123450B0000D6JKL0000000"
_CUR_SRC = "0000000B0000012000000000"
_CX6_SRC = "B000123456JKL0D0B00010203040506"


# Declared schemas of the driver tables read here (FIXTURES.md).
# A declared schema spares the footer-reading job that inference launches.
TABLE_SCHEMAS = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "pages": "page_id bigint, url string, html string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read
    if name in TABLE_SCHEMAS:
        reader = reader.schema(TABLE_SCHEMAS[name])
    return reader.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _window(src: str, start: Column, length: int) -> Column:
    return F.lit(src).substr(start.cast("int"), F.lit(length))


def _null(t: str) -> Column:
    return F.lit(None).cast(t)


def _extract_with_key(orders: DataFrame) -> DataFrame:
    """F1 (the reversal extract) plus the source order key ``_k``."""
    k = F.col("o_orderkey")
    o = orders.select(k.alias("_k"), F.floor(k / 3).cast("bigint").alias("ln_no"))
    k, ln = F.col("_k"), F.col("ln_no")
    o = o.withColumn("_base", F.date_add(F.lit(_BASE_DAY), (ln * 37 % 1500).cast("int")))
    base = F.col("_base")
    snap = F.date_add(base, (31 * (k % 3)).cast("int"))
    pay = F.date_sub(base, ((ln % 9 - 2) * 60).cast("int"))
    status = None
    for i, code in enumerate(["11", "71", "78", "80", "82", "83", "84", "05"]):
        status = F.when(k % 9 == i, code) if status is None else status.when(k % 9 == i, code)
    cx6 = F.when(ln % 4 == 0, "11").when(ln % 4 == 1, "71").when(ln % 4 == 2, "80")
    # a few loans without a number, a few with eleven digits
    number = F.when(ln % 211 == 5, _null("bigint")).when(ln % 223 == 7, ln + 10_000_000_000).otherwise(ln)
    return o.select(
        "_k", number.alias("ln_no"),
        snap.alias("rev_month_snapshot"),
        F.trunc(snap, "month").alias("rev_ss_month"),
        F.date_add(base, 45).alias("rev_transaction_dt"),
        F.trunc(pay, "month").alias("pymt_ss_month"),
        pay.alias("pymt_tran_dt"),
        F.when(ln % 53 == 0, _null("date")).when(ln % 50 == 0, F.lit(_SENTINEL))
         .otherwise(F.date_sub(base, (ln % 700).cast("int"))).alias("otod"),
        status.alias("account_status"),
        F.when(ln % 41 == 0, _null("boolean")).when(k % 7 == 0, True).when(k % 11 == 0, _null("boolean"))
         .otherwise(False).alias("rev_aftr_30_days"),
        _window(_PREV2_SRC, 1 + ln % 12, 12).alias("pymt_hist_previous_2_yr"),
        F.when(ln % 37 == 0, _null("string")).otherwise(_window(_PREV1_SRC, 1 + ln % 11, 12))
         .alias("pymt_hist_previous_1_yr"),
        F.when(ln % 31 == 0, _null("string")).otherwise(_window(_CUR_SRC, 1 + ln % 10, 12))
         .alias("pymt_hist_current_yr"),
        F.when(ln % 13 == 0, _null("string")).otherwise(_window(_CX6_SRC, 1 + ln % 6, 24))
         .alias("payment_history_profile"),
        cx6.alias("cx6_account_status"),
        F.date_add(base, (30 * (ln % 7)).cast("int")).alias("file_date"),
        F.when(k % 8 == 0, _null("date")).when(k % 8 == 1, F.lit(_SENTINEL)).otherwise(base).alias("sor_dofd"),
        F.when(ln % 3 == 0, "Yes").otherwise("No").alias("has_df_tran"),
        F.when(ln % 4 == 0, "Yes").otherwise("No").alias("has_due_date_change"),
        F.when(ln % 5 == 0, F.date_sub(base, 100)).when(ln % 5 == 1, F.date_add(base, 60))
         .otherwise(_null("date")).alias("date_closed"),
    )


def reversal_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the reversal extract, one row per order."""
    return _extract_with_key(table(spark, sf_dir, "orders")).drop("_k")


# The extract as it lands -- mixed-case names, dates as text.
RAW_NAMES = {
    "ln_no": "LN_NO", "rev_month_snapshot": "Rev_Month_Snapshot", "rev_ss_month": "Rev_ss_month",
    "rev_transaction_dt": "Rev_Transaction_dt", "pymt_ss_month": "Pymt_SS_Month", "pymt_tran_dt": "PYMT_TRAN_DT",
    "otod": "OTOD", "account_status": "Account_Status", "rev_aftr_30_days": "REV_AFTR_30_DAYS",
    "pymt_hist_previous_2_yr": "PYMT_HIST_PREVIOUS_2_YR", "pymt_hist_previous_1_yr": "Pymt_Hist_Previous_1_Yr",
    "pymt_hist_current_yr": "Pymt_Hist_Current_Yr", "payment_history_profile": "Payment_History_Profile",
    "cx6_account_status": "CX6_Account_Status", "file_date": "File_Date", "sor_dofd": "SOR_DOFD",
    "has_df_tran": "Has_DF_Tran", "has_due_date_change": "Has_Due_Date_Change", "date_closed": "Date_Closed",
}
TEXT_DATES = ("rev_transaction_dt", "otod", "sor_dofd", "pymt_tran_dt")
BROKEN_DATE_TEXT = "13/45/2024"


def raw_reversal_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 as a spreadsheet export: text dates (every 97th ``otod`` broken),
    other dates as timestamps, the late flag as 0/1."""
    f = _extract_with_key(table(spark, sf_dir, "orders"))
    cols = []
    for name, raw in RAW_NAMES.items():
        c = F.col(name)
        if name in TEXT_DATES:
            c = F.date_format(c, "MM/dd/yyyy")
            if name == "otod":
                c = F.when(F.col("_k") % 97 == 0, F.lit(BROKEN_DATE_TEXT)).otherwise(c)
        elif name == "rev_aftr_30_days":
            c = c.cast("int")
        elif isinstance(f.schema[name].dataType, T.DateType):
            c = c.cast("timestamp_ntz")
        cols.append(c.alias(raw))
    return f.select(*cols)


CSV_DATES = (*TEXT_DATES, "trans_due_dt", "rev_eff_date")
CSV_SCHEMA = T.StructType([T.StructField(n, T.LongType() if n == "LN_NO" else T.IntegerType() if n == "REV_AFTR_30_DAYS" else T.StringType())
                           for n in (*RAW_NAMES.values(), "Trans_Due_Dt", "Rev_Eff_Date")])


def extract_csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 as lines of a text extract, with all six text dates; by order key
    some dates are unreadable, and some lines end early, have a field too many or
    a word for a number.  The status is quoted and followed by a comma inside."""
    f = _extract_with_key(table(spark, sf_dir, "orders"))
    k = F.col("_k")
    f = f.withColumns({"trans_due_dt": F.date_add("file_date", 1), "rev_eff_date": F.date_sub("file_date", 9)})
    cells = []
    for name in (*RAW_NAMES, "trans_due_dt", "rev_eff_date"):
        c = F.col(name)
        if name in CSV_DATES:
            c = F.date_format(c, "M/d/yyyy" if name in ("trans_due_dt", "rev_eff_date") else "MM/dd/yyyy")
            c = F.when((k + len(name)) % 97 == 0, BROKEN_DATE_TEXT).otherwise(c)
        elif name == "rev_aftr_30_days":
            c = c.cast("int")
        elif name == "account_status":
            c = F.concat(F.lit('"'), c, F.when(k % 9 == 7, ",x").otherwise(""), F.lit('"'))
        elif name == "ln_no":
            c = F.when(k % 89 == 1, "none").otherwise(c.cast("string"))
        cells.append(F.coalesce(c.cast("string"), F.lit("")))
    cells = [F.concat(cells[0], F.when(k % 89 == 2, ",more").otherwise("")), *cells[1:]]
    line = F.when(k % 89 == 0, F.concat_ws(",", *cells[:3])).otherwise(F.concat_ws(",", *cells))
    return f.select(line.alias("line"))


def run_date_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: a one-row table whose second column is the run date as yyyyMMdd."""
    return table(spark, sf_dir, "orders").agg(
        F.lit("run").alias("name"), F.date_format(F.max("o_orderdate"), "yyyyMMdd").alias("run_yyyymmdd"))


# URL parts (scheme, host, path) as regular expressions.
HOST_RE = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)"
URL_PATH_RE = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)"


def page_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one file per page; path = host + URL path without trailing '/',
    size = length of the page text.  By page id, some lie below a hidden
    directory, some are hidden files, links, directories, linked directories or
    unreadable (NULL size), and some are listed by an absolute path."""
    url = F.col("url")
    path = F.regexp_replace(F.concat(F.regexp_extract(url, HOST_RE, 1), F.regexp_extract(url, URL_PATH_RE, 1)),
                            "/+$", "")
    return manifest_from_table(page_files(spark, sf_dir, path), MANIFEST_ROOT)


def page_files(spark: SparkSession, sf_dir: str, path: Column) -> DataFrame:
    """The listed files of F2 as whatever walked the store would give them."""
    i = F.col("page_id")
    before = (F.when(i % 97 == 41, "/elsewhere/").when(i % 10 == 5, MANIFEST_ROOT + "/").otherwise(""))

    def listed(p: Column) -> Column:
        deep = F.concat(F.regexp_replace(p, "/[^/]*$", ""), F.lit("/.cache/deep/"), i.cast("string"))
        return F.concat(before, F.when(i % 10 == 3, deep).when(i % 10 == 4, F.concat(p, F.lit("/.hidden"))).otherwise(p))

    # the path is named by the lambda, so it is computed once a row however often it is used
    placed = F.transform(F.array(path), listed)[0]
    return table(spark, sf_dir, "pages").select(
        placed.alias("path"), F.when(i % 17 != 0, F.length("html").cast("long")).alias("size"),
        F.when(i % 19 != 2, i % 13 == 0).alias("is_symlink"),
        F.when(i % 23 == 6, "dir").when(i % 19 != 2, "file").alias("kind"))


# The exclusion list of the registered exclusion query, one of
# each documented kind (name anywhere, relative path, absolute path inside the
# root, absolute path outside it, blank).
MANIFEST_ROOT = "/srv/site"
EXCLUDES = ["es", " blog.ththan.example.net/en ", "/srv/site/m.ththth.example.net/en", "/var/other/x", "  "]


# Patterns of each kind the copying tools take -- a file by its ending, a directory
# by a class, a single unknown letter, a path, directories alone, a path over several levels, one
# with all below it, one outside the root, and one that matches nothing (an open bracket).
GLOB_EXCLUDES = ["*.html", "e[!n]", "m.th?hth*", "blog.*.net/fr", "f[q-s]/", "www.**/9*", "*.example.org/de/***", "/var/*/x", "[en"]


def exclusion_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """an exclusion list as a table, entries of each kind taken from the pages
    by id: relative paths, absolute ones inside the root (some to be normalised)
    and outside it, names, names of files (which exclude nothing) and blanks."""
    i, url = F.col("page_id"), F.col("url")
    host = F.regexp_extract(url, HOST_RE, 1)
    lang = F.regexp_extract(url, r"^[^:]+://[^/]+/([a-z]+)", 1)
    root = F.lit(MANIFEST_ROOT + "/")
    entry = (F.when(i % 40 == 3, F.concat(F.lit(" "), host, F.lit("/"), lang)).when(i % 40 == 5, F.concat(root, host))
             .when(i % 40 == 7, F.concat(F.lit("/var/"), host)).when(i % 40 == 9, "  ")
             .when(i % 40 == 11, F.concat(root, F.lit("./x/..//"), host, F.lit("/"), lang, F.lit("/\t")))
             .when((i % 40 == 13) & (lang == "es"), lang).when(i % 40 == 15, F.regexp_extract(url, r"([^/]+)/?$", 1))
             .when(i % 40 == 17, F.concat(root, F.lit("../..x/"), host)).when(i % 40 == 19, F.concat(root, F.lit("..x/"), host)))
    return table(spark, sf_dir, "pages").select(entry.alias("entry")).where("entry IS NOT NULL")


def definition_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page URLs as definition-file lines; file = host, line_no = page id.
    By page id, some begin with WEB, some end in ``=`` and some are parameters."""
    i, url = F.col("page_id"), F.col("url")
    line = (F.when(i % 11 == 0, F.concat(F.lit("Web"), url, F.lit("=1"))).when(i % 7 == 0, F.concat(url, F.lit("=")))
            .when(i % 5 == 0, F.concat(F.lit(" key"), (i % 3).cast("string"), F.lit("\t== "), url, F.lit(" "))).otherwise(url))
    return table(spark, sf_dir, "pages").select(
        F.regexp_extract("url", HOST_RE, 1).alias("file"), i.alias("line_no"), line.alias("line"))


def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as text files with each kind of line break; by id, some end
    in one, some in two, and parameters stand before the last line."""
    i = F.col("doc_id")
    brk = F.when(i % 3 == 0, F.lit("\r\n")).when(i % 3 == 1, F.lit("\r")).otherwise(F.lit("\n"))
    body = F.replace(F.concat(F.lit("first = "), i.cast("string"), F.lit("\nfirst = second\n"), F.col("text")), F.lit("\n"), brk)
    text = (F.when(i % 5 == 0, F.concat(body, brk)).when(i % 7 == 0, F.concat(body, brk, brk))
            .when(i % 13 == 0, F.lit("")).when(i % 17 != 0, body))
    return table(spark, sf_dir, "documents").select(F.format_string("doc-%d.def", i).alias("file"), text.alias("value"))


# XML wrapper of the row documents.
XML_OPEN = "<xml xmlns:rs='urn:schemas-microsoft-com:rowset' xmlns:z='#RowsetSchema'><rs:data>"
XML_CLOSE = "</rs:data></xml>"
ROWS_PER_DOCUMENT = 1000


def _xml_attr(name: str, value: Column) -> Column:
    esc = F.replace(F.replace(F.replace(F.replace(value.cast("string"), F.lit("&"), F.lit("&amp;")),
                                        F.lit("<"), F.lit("&lt;")), F.lit("'"), F.lit("&apos;")),
                    F.lit('"'), F.lit("&quot;"))
    return F.when(value.isNotNull(), F.concat(F.lit(f" {name}='"), esc, F.lit("'"))).otherwise(F.lit(""))


def supplier_row_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one ``z:row`` element per supplier; ``ows_Nation`` is left out
    when the nation key is 0, so the rows are ragged."""
    s = table(spark, sf_dir, "supplier")
    nation = F.when(F.col("s_nationkey") != 0, F.col("s_nationkey"))
    elem = F.concat(F.lit("<z:row"), _xml_attr("ows_ID", F.col("s_suppkey")), _xml_attr("ows_Title", F.col("s_name")),
                    _xml_attr("ows_Nation", nation), F.lit("/>"))
    return s.select(F.col("s_suppkey"), elem.alias("element"))


def supplier_xml_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F4 documents: suppliers grouped by key range into documents of at
    most ROWS_PER_DOCUMENT rows each."""
    rows = supplier_row_elements(spark, sf_dir)
    doc = F.floor(F.col("s_suppkey") / ROWS_PER_DOCUMENT)
    return rows.groupBy(doc.alias("doc")).agg(
        F.concat(F.lit(XML_OPEN), F.array_join(F.collect_list("element"), ""), F.lit(XML_CLOSE)).alias("value"))


RECORDS_PER_ENVELOPE = 100


def order_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``{"result": [...]}`` envelopes of at most 100 order records each
    (one per priority and order-key range); every 7th record lists its keys
    in the other order."""
    o = table(spark, sf_dir, "orders")
    num = F.col("o_orderkey").cast("string")
    st = F.col("o_orderstatus")
    fwd = F.concat(F.lit('{"number":"'), num, F.lit('","state":"'), st, F.lit('"}'))
    rev = F.concat(F.lit('{"state":"'), st, F.lit('","number":"'), num, F.lit('"}'))
    rec = F.when(F.col("o_orderkey") % 7 == 0, rev).otherwise(fwd)
    page = F.floor(F.col("o_orderkey") / RECORDS_PER_ENVELOPE)
    return o.groupBy("o_orderpriority", page.alias("page")).agg(
        F.concat(F.lit('{"result":['), F.array_join(F.collect_list(rec), ","), F.lit("]}")).alias("body"))


def ragged_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F5 with records of no fixed shape: by order key some have a priority, some a
    customer (a number), some a flag, some nested details; names need quoting."""
    k = F.col("o_orderkey")
    fields = [F.concat(F.lit('"number":"'), k.cast("string"), F.lit('"')),
              F.when(k % 3 == 0, F.concat(F.lit('"the customer":'), F.col("o_custkey").cast("string"))),
              F.when(k % 5 == 0, F.concat(F.lit('"priority.text":"'), F.col("o_orderpriority"), F.lit('"'))),
              F.when(k % 7 == 0, F.concat(F.lit('"open":'), F.when(F.col("o_orderstatus") == "O", "true").otherwise("false"))),
              F.when(k % 11 == 0, F.concat(F.lit('"details":{"status":"'), F.col("o_orderstatus"), F.lit('"}'))),
              F.when(k % 13 == 0, F.lit('"state":null')).when(k % 13 == 1, F.concat(F.lit('"state":"'), F.col("o_orderstatus"), F.lit('"')))]
    record = F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority", F.floor(k / RECORDS_PER_ENVELOPE).alias("page")).agg(
        F.concat(F.lit('{"result":['), F.array_join(F.collect_list(record), ","), F.lit("]}")).alias("body"))


def validation_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one validation result per event."""
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "signup", "review") \
        .otherwise("pass")
    return e.select(
        F.concat(F.lit("process_"), (F.col("user_id") % 10).cast("string")).alias("process"),
        F.col("event_type").alias("test_name"), status.alias("status"),
        F.concat(F.lit("event <"), F.col("event_id").cast("string"), F.lit("> & user "),
                 F.col("user_id").cast("string")).alias("detail"),
        F.col("event_id"))


def event_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event values by type, with groups of 30, 2, 1 and 0 positive values cut out."""
    i = F.col("event_id")
    group = (F.when(i < 30, "thirty").when(i < 32, "two").when(i < 33, "one").when(i < 40, "none")
             .otherwise(F.col("event_type")))
    value = F.when((i >= 33) & (i < 40), -F.col("value")).otherwise(F.col("value"))
    return table(spark, sf_dir, "events").select(group.alias("grp"), value.alias("value"))
