"""The report job end to end: landed files -> report folders."""

import tempfile

from pyspark.sql import functions as F

from conftest import SF001
from strata.operators.payment_history import php_updates
from strata.operators.report import final_report
from strata.plans import fixtures as fx
from strata.plans.report_job import LABEL_DATASET, read_report, register_views, run_report
from strata.sources.reversals import normalize_reversals


def _expected(spark, raw):
    return final_report(php_updates(normalize_reversals(raw), fx.AS_OF), fx.AS_OF)


def test_run_report_batch(spark):
    raw = fx.raw_reversal_extract(spark, SF001)
    base = tempfile.mkdtemp(prefix="job-", dir="/tmp")
    raw.write.parquet(f"{base}/landing/sor_with_cx6_19990615.parquet")
    dates = fx.run_date_table(spark, SF001)
    out = run_report(spark, f"{base}/landing/sor_with_cx6_19990615.parquet", dates, f"{base}/out",
                     "Internal review copy", fx.AS_OF, factored=False)
    assert out.endswith("_" + dates.select(F.date_format(F.to_date("run_yyyymmdd", "yyyyMMdd"), "MMddyyyy")).first()[0])
    got = read_report(spark, out)
    assert got.exceptAll(_expected(spark, raw)).count() == 0
    assert spark.read.parquet(f"{out}/{LABEL_DATASET}").first()[0] == "Internal review copy"


def test_register_views(spark):
    register_views(spark, fx.reversal_extract(spark, SF001), fx.AS_OF, prefix="t_")
    n = spark.sql("SELECT COUNT(*) FROM t_php_updates").first()[0]
    assert n == fx.reversal_extract(spark, SF001).count()
    assert spark.sql("SELECT SUM(pair_count) FROM t_final_report").first()[0] >= n


def test_run_report_factored(spark):
    from strata.plans.report_job import CX6_DATASET, ROWS_DATASET
    raw = fx.raw_reversal_extract(spark, SF001)
    base = tempfile.mkdtemp(prefix="jobf-", dir="/tmp")
    raw.write.parquet(f"{base}/landing/x.parquet")
    out = run_report(spark, f"{base}/landing/x.parquet", fx.run_date_table(spark, SF001), f"{base}/out",
                     "label", fx.AS_OF)
    rows = spark.read.parquet(f"{out}/{ROWS_DATASET}")
    strings = spark.read.parquet(f"{out}/{CX6_DATASET}")
    assert rows.count() == raw.count()
    pairs = rows.join(strings, "ln_no", "left").agg(F.sum(F.coalesce("cx6_count", F.lit(1)))).first()[0]
    assert pairs == _expected(spark, raw).agg(F.sum("pair_count")).first()[0]
