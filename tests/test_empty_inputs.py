"""Every operator on empty input: no error, no rows (or the one-row totals)."""

from strata.operators.hierarchy import (
    exclude_paths, format_listing, manifest_totals, running_share, size_rollup, size_topk,
)
from strata.operators.joins import join_like
from strata.operators.lognormal import lognormal_ci
from strata.operators.payment_history import php_periods, php_updates
from strata.operators.report import final_report, report_cx6_strings, report_rows
from strata.operators.textrows import kv_parse
from strata.operators.validation import validation_notice, validation_summary
from strata.plans import fixtures as fx
from strata.sources.manifest import MANIFEST_SCHEMA
from test_payment_history import COLS


def test_empty_inputs(spark):
    ext = spark.createDataFrame([], COLS)
    up = php_updates(ext, fx.AS_OF)
    assert php_periods(ext).count() == 0 and up.count() == 0
    assert final_report(up, fx.AS_OF).count() == 0
    assert report_rows(up).count() == 0 and report_cx6_strings(up, fx.AS_OF).count() == 0

    m = spark.createDataFrame([], MANIFEST_SCHEMA)
    assert [r.dir for r in size_topk(size_rollup(m)).collect()] == ["."]  # the root is always listed
    assert [r.line for r in format_listing(size_rollup(m), "mb").collect()] == ["       0 MB  ."]
    assert exclude_paths(m, ["x"], "/r").count() == 0 and running_share(m).count() == 0
    t = manifest_totals(m).first()
    assert (t.files, t.bytes) == (0, 0)

    x = spark.createDataFrame([], "grp string, x double")
    assert lognormal_ci(x, "grp", "x").count() == 0

    lines = spark.createDataFrame([], "file string, line_no int, line string")
    assert kv_parse(lines).count() == 0

    v = spark.createDataFrame([], "process string, test_name string, status string, detail string")
    assert validation_summary(v).count() == 0 and validation_notice(v).count() == 0

    a = spark.createDataFrame([], "k long, name string")
    b = spark.createDataFrame([], "k2 long, v long")
    assert join_like(a, b, "k", "k2", "name", "red").count() == 0

    from strata.operators.joins import join_like_nocase
    assert join_like_nocase(a.selectExpr("string(k) AS k", "name"), b.selectExpr("string(k2) AS k2"), "k", "k2", "name", "red").count() == 0

    from strata.sources.json import records_by_name, result_pages, variant_records
    from strata.sources.reversals import extract_from_lines
    from strata.sources.xml import explode_xml_union
    text = spark.createDataFrame([], "body string, k long")
    assert records_by_name(variant_records(text, "body", "result", ["k"]), ["k"]).columns == ["k"]
    assert result_pages(a, 10, ["k"]).count() == 0
    assert explode_xml_union(text, "body").count() == 0
    assert extract_from_lines(text, fx.CSV_SCHEMA, "body").count() == 0
