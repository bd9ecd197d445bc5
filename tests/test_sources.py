"""Readers: landed extract (CSV), run-date table, multi-line JSON, manifest glob."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import SF001, SF01
from strata.plans import fixtures as fx
from strata.sources.json import scan_json_result
from strata.sources.manifest import manifest_from_table
from strata.sources.reversals import (
    normalize_reversals, read_run_date_table, run_date_frame, scan_reversals, scan_run_date,
)


def test_csv_extract_normalises_like_parquet(spark):
    raw = fx.raw_reversal_extract(spark, SF001)
    base = tempfile.mkdtemp(prefix="csv-", dir="/tmp")
    raw.write.option("header", True).csv(f"{base}/x.csv")
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in raw.schema.fields])
    from_csv = normalize_reversals(scan_reversals(spark, f"{base}/x.csv", "csv", schema=schema, header=True))
    from_df = normalize_reversals(raw)
    assert from_csv.columns == [c.lower() for c in raw.columns]
    assert from_csv.exceptAll(from_df).count() == 0 and from_csv.count() == from_df.count()
    types = dict(from_csv.dtypes)
    assert types["otod"] == "date" and types["rev_month_snapshot"] == "date"
    assert types["rev_aftr_30_days"] == "boolean" and types["account_status"] == "string"
    # the broken text date became NULL, others parsed
    broken = from_df.where(F.col("otod").isNull()).count()
    assert broken > 0


def test_status_read_as_number_becomes_text(spark):
    df = spark.createDataFrame([(11, "1/5/2024", "2024-01-05 10:00:00")], "ACCOUNT_STATUS int, OTOD string, T string")
    df = df.withColumn("T", F.col("T").cast("timestamp"))
    r = normalize_reversals(df).first()
    assert r.account_status == "11" and r.otod == dt.date(2024, 1, 5) and r.t == dt.date(2024, 1, 5)


def test_run_date_table(spark):
    base = tempfile.mkdtemp(prefix="rd-", dir="/tmp")
    fx.run_date_table(spark, SF01).write.parquet(f"{base}/dates")
    table = read_run_date_table(spark, f"{base}/dates")
    day, text = scan_run_date(table)
    assert text == day.strftime("%m%d%Y")
    two = table.unionByName(table)
    with pytest.raises(ValueError):
        scan_run_date(two)
    bad = spark.createDataFrame([("run", "2024-13-01")], "name string, d string")
    with pytest.raises(ValueError):
        scan_run_date(bad)
    assert run_date_frame(bad).first().run_date is None


def test_multiline_json_envelopes(spark):
    d = tempfile.mkdtemp(prefix="jsonm-", dir="/tmp")
    for i in range(3):
        with open(os.path.join(d, f"page{i}.json"), "w") as f:
            f.write('{\n  "result": [\n    {"number": "N%d", "state": "1"},\n    {"state": "2", "number": "M%d"}\n  ]\n}\n'
                    % (i, i))
    schema = T.StructType([T.StructField("number", T.StringType()), T.StructField("state", T.StringType())])
    got = sorted(tuple(r) for r in scan_json_result(spark, d, schema, multi_line=True).collect())
    assert got == sorted([(f"N{i}", "1") for i in range(3)] + [(f"M{i}", "2") for i in range(3)])


def test_manifest_from_table(spark):
    rows = [("/r/x/a", 1, False, "file"), ("/r/x/.git/b", None, None, None), ("c/d/", 0, None, None), ("/r/xy/e", 2, False, "file"),
            ("/r/x/", 0, False, "dir"), (None, 3, False, "file"), ("l", 9, True, "file")]
    df = spark.createDataFrame(rows, "path string, size long, is_symlink boolean, kind string")
    got = sorted(tuple(r) for r in manifest_from_table(df, "/r/x").collect())
    assert got == [(".git/b", None, False, "file"), ("a", 1, False, "file"), ("c/d", 0, False, "dir"), ("l", 9, True, "file")]
    assert manifest_from_table(df.select("path", "size"), "/r/x/").where("is_symlink").count() == 0


def test_shared_dir_needs_a_setting_on_a_cluster(spark):
    from types import SimpleNamespace

    from strata.session import shared_dir

    def session(master, setting=None, folder=None):
        ctx = SimpleNamespace(master=master, getCheckpointDir=lambda: folder)
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: setting), sparkContext=ctx)

    assert shared_dir(session("spark://host:7077", "hdfs://nn/ckpt/")) == "hdfs://nn/ckpt"
    assert shared_dir(session("yarn", folder="hdfs://nn/c2")) == "hdfs://nn/c2"
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(RuntimeError):
            shared_dir(session(master))
    assert shared_dir(spark) == shared_dir(spark)
