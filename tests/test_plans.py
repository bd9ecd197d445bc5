"""Plan-shape guards for scale: no pair-emitting joins, no unbounded windows,
and a hot loan holding a third of all rows."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import SF01, SF001
from strata.operators.payment_history import php_updates
from strata.operators.report import final_report
from strata.plans import fixtures as fx
from strata.plans import registry

# within bounded buckets or range partitions, over a row a bucket, or (the SQL text) as the statement has it
WINDOW_KEYS = {"running_share", "json_pages", "validation_notice", "php_updates_sql"}
# a shuffle join (sort-merge, or hash when AQE finds the build side small) with the hot partition split
SKEW_JOIN = re.compile(r"(?:SortMergeJoin|ShuffledHashJoin)\(skew=true\)")  # per-range windows + a window over one row per range


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", sorted(registry.queries()))
def test_no_cartesian_or_nested_loop(spark, key):
    plan = _plan(registry.queries()[key](spark, SF01))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if key not in WINDOW_KEYS:
        assert "Window" not in plan


def test_running_share_windows_are_partitioned(spark):
    plan = _plan(registry.queries()["running_share"](spark, SF01))
    # the only single-partition step is the window over per-bucket totals
    assert plan.count("SinglePartition") <= 1 and "rangepartitioning" not in plan


def test_no_plan_outgrows_its_code(spark):
    """Generated code that doesn't compile fails here instead of being interpreted, and no plan repeats a computed path over and over."""
    old = spark.conf.get("spark.sql.codegen.fallback")
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        for key, query in registry.queries().items():
            df = query(spark, SF001)
            assert len(df._jdf.queryExecution().optimizedPlan().toString()) < 60_000, key
            df.write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.set("spark.sql.codegen.fallback", old)


def test_exclusion_by_table_splits_a_hot_directory(spark):
    from strata.operators.hierarchy import exclude_by_table
    files = spark.range(60_000).repartition(8).selectExpr(
        "concat(IF(id % 3 = 0, 'hot/dir', concat('d', id)), '/file', id) AS path", "id AS size", "false AS is_symlink", "'file' AS kind")
    entries = spark.range(40_000).selectExpr("concat('d', id * 2) AS entry")

    def run():
        out = exclude_by_table(files, entries, "/r")
        n = len(out.collect())
        return n, _plan(out).split("== Initial Plan ==")[0]

    n, final = _with_conf(spark, SKEW_CONF, run)
    assert n == sum(i % 3 == 0 or i % 2 == 1 for i in range(60_000))
    assert SKEW_JOIN.search(final)


def test_hot_loan_report(spark):
    """A third of the rows belong to one loan: the report stays exact and is
    built from (loan, CX6 string) counts, never from the k*k pairs."""
    src = fx.reversal_extract(spark, SF01)
    src = src.withColumn("ln_no", F.when(F.col("ln_no") % 3 == 0, F.lit(0)).otherwise(F.col("ln_no")))
    rep = final_report(php_updates(src, fx.AS_OF), fx.AS_OF)
    k = Counter(r.ln_no for r in src.select("ln_no").collect())
    assert k[0] >= 0.33 * src.count()
    pairs = sum(v * v for ln, v in k.items() if ln is not None) + k[None]
    assert rep.agg(F.sum("pair_count")).first()[0] == pairs
    # the factored form holds no pair at all: one row per row, one per string
    from strata.operators.report import report_cx6_strings, report_rows
    up = php_updates(src, fx.AS_OF)
    assert report_rows(up).count() == src.count()
    strings = report_cx6_strings(up, fx.AS_OF)
    assert strings.count() <= src.count()
    assert strings.agg(F.sum("cx6_count")).first()[0] == src.where("ln_no IS NOT NULL").count()


def test_hot_loan_sort_merge_with_skew_split(spark):
    """Broadcasts off (as on large data): the per-loan joins sort-merge and AQE
    splits the hot loan's partition; the result stays exact."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        # several input partitions, as on a cluster: AQE splits a skewed
        # partition along map outputs, so a one-task input cannot be split
        src = fx.reversal_extract(spark, SF01).repartition(8)
        src = src.withColumn("ln_no", F.when(F.col("ln_no") % 3 == 0, F.lit(0)).otherwise(F.col("ln_no")))
        rep = final_report(php_updates(src, fx.AS_OF), fx.AS_OF)
        total = rep.agg(F.sum("pair_count")).first()[0]
        rows = rep.collect()
        plan = rep._jdf.queryExecution().executedPlan().toString()
        k = Counter(r.ln_no for r in src.select("ln_no").collect())
        assert total == sum(v * v for ln, v in k.items() if ln is not None) + k[None]
        assert sum(r.pair_count for r in rows) == total
        final = plan.split("== Initial Plan ==")[0]
        assert "BroadcastHashJoin" not in final
        # both per-loan stats joins and the pairing join split the hot loan
        assert len(SKEW_JOIN.findall(final)) == 3
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


SKEW_CONF = {"spark.sql.autoBroadcastJoinThreshold": "-1",
             "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
             "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k",
             "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
             "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k"}


def _with_conf(spark, conf, fn):
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        return fn()
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_join_like_hot_part_splits(spark):
    from strata.operators.joins import join_like

    def run():
        part = fx.table(spark, SF01, "part").select("p_partkey", "p_name")
        hot = part.where(F.col("p_name").startswith("red")).agg(F.min("p_partkey")).first()[0]
        li = fx.table(spark, SF01, "lineitem").select("l_partkey", "l_orderkey").repartition(8)
        li = li.withColumn("l_partkey", F.when(F.col("l_orderkey") % 3 == 0, F.lit(hot)).otherwise(F.col("l_partkey")))
        j = join_like(part, li, "p_partkey", "l_partkey", "p_name", "red")
        n = j.count()
        rows = j.collect()
        final = _plan(j).split("== Initial Plan ==")[0]
        want = li.join(part.where(F.col("p_name").startswith("red")), F.col("l_partkey") == F.col("p_partkey")).count()
        return n, len(rows), want, final

    n, got, want, final = _with_conf(spark, SKEW_CONF, run)
    assert n == got == want
    assert SKEW_JOIN.search(final)


def test_validation_notice_hot_process(spark):
    """A process with a third of all rows, most of them one test's: parts stay
    bounded and every row is there once."""
    from strata.operators.validation import validation_notice

    v = fx.validation_results(spark, SF01).repartition(8)
    v = v.withColumn("process", F.when(F.col("event_id") % 3 == 0, F.lit("hot")).otherwise(F.col("process")))
    rows = validation_notice(v, rows_per_part=100, row_key="event_id").collect()
    per_part = [r.html.count("<tr class=") for r in rows if r.part > 0]
    assert sum(per_part) == v.where(~F.col("status").eqNullSafe("pass")).count() and max(per_part) == 100
