"""Validation notices, log-normal intervals and the prefix join."""

import math
import re
import statistics

import pytest
from pyspark.sql import functions as F

from conftest import SF01
from test_functions import central_probability
from strata.operators.joins import join_like
from strata.operators.lognormal import lognormal_ci
from strata.operators import validation
from strata.operators.validation import NOTICE_CLOSE, non_passing, validation_notice, validation_summary
from strata.plans import fixtures as fx

RESULTS = [("p1", "t_a", "pass", "ok", 1), ("p1", "t_b", "fail", "x<1 & y", 2), ("p1", "t_a", "review", "r", 3),
           ("p2", "t_a", "pass", "ok", 4), ("p3", "t_c", None, "no status", 5), ("p1", "t_c", "fail", "z", 6)]
SCHEMA = "process string, test_name string, status string, detail string, rid long"


def test_summary_and_non_passing(spark):
    df = spark.createDataFrame(RESULTS, SCHEMA)
    s = {r.process: r for r in validation_summary(df).collect()}
    assert (s["p1"]["pass"], s["p1"]["fail"], s["p1"]["review"]) == (1, 2, 1)
    assert s["p3"]["other"] == 1 and s["p2"]["total"] == 1
    assert non_passing(df).count() == 4


def test_notice_parts_reassemble(spark):
    df = spark.createDataFrame(RESULTS, SCHEMA)
    parts = validation_notice(df, rows_per_part=2, row_key="rid").collect()
    by = {}
    for r in parts:
        by.setdefault(r.process, []).append((r.part, r.html))
    assert set(by) == {"p1", "p3"}  # p2 passed everything
    doc = "".join(h for _, h in sorted(by["p1"]))
    assert doc.startswith("<html>") and doc.endswith(NOTICE_CLOSE)
    assert "x&lt;1 &amp; y" in doc and doc.count("<tr class=") == 3
    assert max(p for p, _ in by["p1"]) == 3  # head, two row parts, tail


def test_notice_null_process_keeps_rows(spark):
    df = spark.createDataFrame(RESULTS + [(None, "t_x", "fail", "orphan", 7)], SCHEMA)
    doc = "".join(r.html for r in sorted(validation_notice(df, row_key="rid").where("process IS NULL").collect(),
                                          key=lambda r: r.part))
    assert "orphan" in doc and doc.endswith(NOTICE_CLOSE)


def test_notice_parts_bounded(spark):
    v = fx.validation_results(spark, SF01)
    parts = validation_notice(v, rows_per_part=50, row_key="event_id")
    sizes = parts.where("part > 0").select(F.size(F.split("html", "<tr class=")).alias("n")).collect()
    assert max(r.n for r in sizes) - 1 == 50


@pytest.mark.parametrize("row_key", ["even", "same", "none", None])
def test_notice_parts_whatever_the_keys(spark, monkeypatch, row_key):
    monkeypatch.setattr(validation, "BUCKET_ROWS", 37)
    df = spark.range(1000).selectExpr("'p' AS process", "concat('t', id % 3) AS test_name", "'fail' AS status",
                                      "IF(id % 2 = 0, 'twin', concat('d', id)) AS detail", "id * 10 AS even",
                                      "7L AS same", "CAST(NULL AS BIGINT) AS none")
    parts = sorted(validation_notice(df, rows_per_part=100, row_key=row_key).collect(), key=lambda r: r.part)
    assert [r.part for r in parts] == list(range(12))
    assert [r.html.count("<tr class=") for r in parts[1:-1]] == [100] * 10
    tests = re.findall("<td>(t[012])</td>", "".join(r.html for r in parts))
    assert tests == sorted(tests) and len(tests) == 1000  # one order over the joined notice
    assert sorted(re.findall("<td>(d[0-9]+)</td>", "".join(r.html for r in parts))) == sorted(
        f"d{i}" for i in range(1, 1000, 2))


def ci_reference(xs, level):
    xs = [x for x in xs if x is not None and not (isinstance(x, float) and math.isnan(x)) and x > 0]
    n = len(xs)
    if n == 0:
        return n, None, None, None
    logs = [math.log(x) for x in xs]
    m = statistics.fmean(logs)
    if n == 1:
        return n, None, None, math.exp(m)
    sd = statistics.stdev(logs)
    low, high = 0.0, 1000.0
    for _ in range(60):  # the value whose central probability is the level
        t = (low + high) / 2
        low, high = (t, high) if central_probability(t, n - 1) < level else (low, t)
    return n, math.exp(m - t * sd / math.sqrt(n)), math.exp(m + t * sd / math.sqrt(n)), math.exp(m)


def test_lognormal_edges(spark):
    data = {"zero_neg": [0.0, -1.0], "one": [5.0], "two": [1.0, 4.0], "mixed": [2.0, None, float("nan"), 0.0, 8.0, 3.0],
            "many": [float(i) for i in range(1, 60)]}
    rows = [(g, x) for g, xs in data.items() for x in xs]
    df = spark.createDataFrame(rows, "grp string, x double")
    got = {r.grp: r for r in lognormal_ci(df, "grp", "x", 0.98).collect()}
    for g, xs in data.items():
        n, lo, hi, pt = ci_reference(xs, 0.98)
        r = got[g]
        assert r.n == n
        for a, b in ((r.lower, lo), (r.upper, hi), (r.point_estimate, pt)):
            assert (a is None and b is None) or math.isclose(a, b, rel_tol=1e-7), (g, a, b)
        if lo is not None:
            assert r.lower <= r.point_estimate <= r.upper


def test_join_like_pushes_prefix_to_scan(spark):
    part = spark.read.parquet(f"{SF01}/part.parquet").select("p_partkey", "p_name")
    li = spark.read.parquet(f"{SF01}/lineitem.parquet").select("l_partkey", "l_orderkey")
    j = join_like(part, li, "p_partkey", "l_partkey", "p_name", "red")
    plan = j._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(p_name,red)" in plan
    assert j.count() == 7749
    assert join_like(part, li, "p_partkey", "l_partkey", "p_name", "RED", ignore_case=True).count() == 7749
    assert join_like(part, li, "p_partkey", "l_partkey", "p_name", "re%").count() == 0
