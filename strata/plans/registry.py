"""The registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per
operator key of the survey inventory.  Each reads the driver tables (or data
Spark derives from them) in full."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions.sizes import human_size
from strata.operators.hierarchy import (
    GLOB_FORMS, exclude_by_table, exclude_globs, exclude_paths, format_listing, manifest_totals, running_share, size_filter, size_rollup, size_topk,
)
from strata.operators.joins import join_like, join_like_nocase
from strata.operators.lognormal import lognormal_ci
from strata.operators.payment_history import (
    php_periods, php_updates, with_late_flag, with_loan_stats, with_positions, with_status_byte,
)
from strata.operators.report import (
    cx6_updates, final_report, manual_review, report_cx6_strings, report_rows, update_strings,
)
from strata.operators.textrows import classify_lines, kv_parse, ragged_union
from strata.operators.validation import non_passing, validation_notice, validation_summary
from strata.plans import fixtures as fx
from strata.plans.report_job import parse_report_lines, report_lines
from strata.plans.updates_sql import php_updates_sql
from strata.sources.json import explode_result, records_by_name, result_pages, variant_records
from strata.sources.reversals import extract_from_lines, normalize_reversals, run_date_frame, scan_reversals
from strata.sources.text import explode_lines
from strata.sources.xml import explode_xml_rows, explode_xml_union

Query = Callable[[SparkSession, str], DataFrame]


# ---- payment history and the review report -------------------------------------------

def _updates(spark, sf):
    return php_updates(fx.reversal_extract(spark, sf), fx.AS_OF)


def q_php_periods(spark, sf):
    return php_periods(fx.reversal_extract(spark, sf))


def q_php_late_flag(spark, sf):
    return with_late_flag(fx.reversal_extract(spark, sf)).select("ln_no", "rev_aftr_30_days", "has_late_reversal")


def q_php_status_byte(spark, sf):
    return with_status_byte(fx.reversal_extract(spark, sf)).select("account_status", "account_status_php_byte")


def q_php_positions(spark, sf):
    df = with_positions(with_loan_stats(fx.reversal_extract(spark, sf)), fx.AS_OF)
    return df.select("ln_no", "snapshot_month", "php_36_original", "php_start_date", "loan_number_padded",
                     "update_start_pos", "update_end_pos", "snapshot_php_position")


def q_php_updates(spark, sf):
    return _updates(spark, sf)


def q_php_updates_sql(spark, sf):
    extract = fx.reversal_extract(spark, sf)
    return php_updates_sql(spark, extract, php_periods(extract), fx.AS_OF)


def q_cx6_updates(spark, sf):
    return cx6_updates(_updates(spark, sf), fx.AS_OF)


def q_final_report(spark, sf):
    return final_report(_updates(spark, sf), fx.AS_OF)


def q_report_rows(spark, sf):
    return report_rows(_updates(spark, sf))


def q_report_cx6_strings(spark, sf):
    return report_cx6_strings(_updates(spark, sf), fx.AS_OF)


def q_update_strings(spark, sf):
    return update_strings(_updates(spark, sf))


def q_manual_review(spark, sf):
    # the review rules read extract columns only: no per-loan join needed
    return manual_review(fx.reversal_extract(spark, sf))


def q_report_roundtrip(spark, sf):
    report = final_report(_updates(spark, sf), fx.AS_OF)
    return parse_report_lines(report_lines(report), report.schema)


# ---- extract and run date --------------------------------------------------------------

def q_reversals_normalized(spark, sf):
    return normalize_reversals(fx.raw_reversal_extract(spark, sf)).select(*fx.RAW_NAMES.keys())


def q_extract_csv(spark, sf):
    return normalize_reversals(extract_from_lines(fx.extract_csv_lines(spark, sf), fx.CSV_SCHEMA))


def q_extract_scan(spark, sf):
    return scan_reversals(spark, f"{sf}/orders.parquet")


def q_run_date(spark, sf):
    return run_date_frame(fx.run_date_table(spark, sf))


# ---- manifests and size rollups ----------------------------------------------------------

def q_size_rollup(spark, sf):
    return size_rollup(fx.page_manifest(spark, sf), root=".", hidden="prune")


def q_size_rollup_basename(spark, sf):
    return size_rollup(fx.page_manifest(spark, sf), root="site", hidden="basename")


def q_manifest_table(spark, sf):
    return fx.page_manifest(spark, sf)


def q_size_topk(spark, sf):
    return size_topk(size_rollup(fx.page_manifest(spark, sf), root=".", hidden="keep"), max_depth=2, k=10)


def q_size_listing(spark, sf):
    rollup = size_filter(size_rollup(fx.page_manifest(spark, sf), root=".", hidden="prune"), min_mb=0.01)
    tree = format_listing(rollup, "tree").withColumnRenamed("line", "line_tree")
    plain = format_listing(tree, "plain").withColumnRenamed("line", "line_plain")
    return format_listing(plain, "mb").withColumnRenamed("line", "line_mb")


def q_size_spaced(spark, sf):
    rollup = size_rollup(fx.page_manifest(spark, sf), root=".", hidden="keep")
    return rollup.select("dir", human_size("bytes", "spaced").alias("size"))


def q_path_exclude(spark, sf):
    return exclude_paths(fx.page_manifest(spark, sf), fx.EXCLUDES, fx.MANIFEST_ROOT)


def q_path_exclude_table(spark, sf):
    return exclude_by_table(fx.page_manifest(spark, sf), fx.exclusion_entries(spark, sf), fx.MANIFEST_ROOT)


def q_path_exclude_glob(spark, sf):
    manifest = fx.page_manifest(spark, sf)
    kept = [exclude_globs(manifest, fx.GLOB_EXCLUDES, fx.MANIFEST_ROOT, form).withColumn("form", F.lit(form)) for form in GLOB_FORMS]
    return kept[0].unionByName(kept[1])


def q_manifest_totals(spark, sf):
    return manifest_totals(exclude_paths(fx.page_manifest(spark, sf), fx.EXCLUDES, fx.MANIFEST_ROOT))


def q_running_share(spark, sf):
    out = running_share(fx.page_manifest(spark, sf))
    return out.withColumns({"files_pct": F.round("files_pct", 6), "bytes_pct": F.round("bytes_pct", 6)})


# ---- log-normal intervals --------------------------------------------------------------

def _rounded_ci(df):
    return df.withColumns({
        "lower": F.round("lower", 4), "upper": F.round("upper", 4), "point_estimate": F.round("point_estimate", 4),
        "mean_log": F.round("mean_log", 6), "sd_log": F.round("sd_log", 6)})


def q_lognormal_stats(spark, sf):
    li = fx.table(spark, sf, "lineitem")
    return _rounded_ci(lognormal_ci(li, ["l_returnflag", "l_linestatus"], "l_extendedprice", 0.98))


def q_lognormal_ci(spark, sf):
    return _rounded_ci(lognormal_ci(fx.event_values(spark, sf), "grp", "value", 0.95))


# ---- text lines, XML rows, JSON envelopes ------------------------------------------------

XML_ROW_SCHEMA = "_ows_ID string, _ows_Title string, _ows_Nation string"
RECORD_SCHEMA = T.StructType([T.StructField("number", T.StringType()), T.StructField("state", T.StringType())])


def q_kv_parse(spark, sf):
    return kv_parse(fx.definition_lines(spark, sf))


def q_line_classes(spark, sf):
    return classify_lines(fx.definition_lines(spark, sf))


def _file_lines(spark, sf):
    return explode_lines(fx.text_files(spark, sf), F.col("file"), F.col("value"))


def q_text_lines(spark, sf):
    return _file_lines(spark, sf)


def q_text_parameters(spark, sf):
    return kv_parse(_file_lines(spark, sf))


def q_xml_rows(spark, sf):
    return explode_xml_rows(fx.supplier_xml_documents(spark, sf), "value", XML_ROW_SCHEMA)


def q_xml_rows_union(spark, sf):
    return explode_xml_union(fx.supplier_xml_documents(spark, sf), "value")


def q_ragged_union(spark, sf):
    s = fx.table(spark, sf, "supplier")
    ident = [F.col("s_suppkey").cast("string").alias("ows_ID"), F.col("s_name").alias("ows_Title")]
    has_nation = F.coalesce(F.col("s_nationkey") != 0, F.lit(False))
    with_nation = s.where(has_nation).select(*ident, F.col("s_nationkey").cast("string").alias("ows_Nation"))
    without = s.where(~has_nation).select(*ident)
    return ragged_union(without, with_nation)


def q_json_result(spark, sf):
    return explode_result(fx.order_envelopes(spark, sf), "body", RECORD_SCHEMA)


PAGE_SIZE = 64


def q_json_pages(spark, sf):
    records = explode_result(fx.order_envelopes(spark, sf), "body", RECORD_SCHEMA)
    return result_pages(records.select(F.col("number").cast("long").alias("number"), "state"), PAGE_SIZE, ["state"])


def q_json_records_variant(spark, sf):
    return records_by_name(variant_records(fx.ragged_envelopes(spark, sf), "body", "result"))


def q_json_props_variant(spark, sf):
    e = fx.table(spark, sf, "events")
    return records_by_name(variant_records(e, "props", keep=["event_id"]), keep=["event_id"])


def q_json_props(spark, sf):
    e = fx.table(spark, sf, "events")
    return e.select("event_id", F.from_json("props", "k bigint").alias("p")).select("event_id", "p.k")


# ---- validation, joins -------------------------------------------------------------------

def q_validation_summary(spark, sf):
    return validation_summary(fx.validation_results(spark, sf))


def q_non_passing(spark, sf):
    return non_passing(fx.validation_results(spark, sf)).drop("event_id")


def q_validation_notice(spark, sf):
    return validation_notice(fx.validation_results(spark, sf), rows_per_part=100, row_key="event_id")


def q_join_like(spark, sf):
    part = fx.table(spark, sf, "part").select("p_partkey", "p_name")
    li = fx.table(spark, sf, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity")
    return join_like(part, li, "p_partkey", "l_partkey", "p_name", "red").select(
        "p_name", "p_partkey", "l_orderkey", "l_linenumber", "l_quantity")


def q_join_like_nocase(spark, sf):
    # the keys as text, in lower case on one side and in upper case on the other
    part = fx.table(spark, sf, "part").select("p_name", "p_partkey", F.concat(F.lit("part-"), F.lower(F.hex("p_partkey"))).alias("p_code"))
    li = fx.table(spark, sf, "lineitem").select(F.concat(F.lit("PART-"), F.hex("l_partkey")).alias("l_code"), "l_orderkey", "l_linenumber")
    return join_like_nocase(part, li, "p_code", "l_code", "p_name", "RED").select("p_name", "p_code", "l_code", "l_orderkey", "l_linenumber")


def queries() -> dict[str, Query]:
    return {
        "php_periods": q_php_periods,
        "php_late_flag": q_php_late_flag,
        "php_status_byte": q_php_status_byte,
        "php_positions": q_php_positions,
        "php_updates": q_php_updates,
        "php_updates_sql": q_php_updates_sql,
        "cx6_updates": q_cx6_updates,
        "final_report": q_final_report,
        "report_rows": q_report_rows,
        "report_cx6_strings": q_report_cx6_strings,
        "update_strings": q_update_strings,
        "manual_review": q_manual_review,
        "report_roundtrip": q_report_roundtrip,
        "reversals_normalized": q_reversals_normalized,
        "run_date": q_run_date,
        "extract_scan": q_extract_scan,
        "extract_csv": q_extract_csv,
        "size_rollup": q_size_rollup,
        "size_topk": q_size_topk,
        "size_listing": q_size_listing,
        "size_spaced": q_size_spaced,
        "path_exclude": q_path_exclude,
        "path_exclude_table": q_path_exclude_table,
        "path_exclude_glob": q_path_exclude_glob,
        "manifest_totals": q_manifest_totals,
        "running_share": q_running_share,
        "manifest_table": q_manifest_table,
        "size_rollup_basename": q_size_rollup_basename,
        "lognormal_stats": q_lognormal_stats,
        "lognormal_ci": q_lognormal_ci,
        "kv_parse": q_kv_parse,
        "line_classes": q_line_classes,
        "text_lines": q_text_lines,
        "text_parameters": q_text_parameters,
        "xml_rows": q_xml_rows,
        "xml_rows_union": q_xml_rows_union,
        "ragged_union": q_ragged_union,
        "json_result": q_json_result,
        "json_pages": q_json_pages,
        "json_records_variant": q_json_records_variant,
        "json_props": q_json_props,
        "json_props_variant": q_json_props_variant,
        "validation_summary": q_validation_summary,
        "non_passing": q_non_passing,
        "validation_notice": q_validation_notice,
        "join_like": q_join_like,
        "join_like_nocase": q_join_like_nocase,
    }
