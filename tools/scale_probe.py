"""Run the report chain on a k-times larger extract derived from the driver
tables and print per-stage wall time, CPU time and shuffle bytes.

usage: python tools/scale_probe.py [sf_dir] [k] [partitions] [conf=value,...]
The extract is F1 from ``orders`` with k copies of every loan (loan numbers
offset per copy), written once below ``spark.checkpoint.dir``; the stage
figures come from Spark's event log in a scratch folder.
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def stage_rows(log_dir: str):
    for path in sorted(p for p in glob.glob(os.path.join(log_dir, "**", "*"), recursive=True) if os.path.isfile(p)):
        with open(path) as f:
            for line in f:
                ev = json.loads(line)
                if ev.get("Event") != "SparkListenerStageCompleted":
                    continue
                info = ev["Stage Info"]
                acc = {a["Name"]: a.get("Value") for a in info.get("Accumulables", [])}
                yield (info["Stage ID"], info["Number of Tasks"],
                       info.get("Completion Time", 0) - info.get("Submission Time", 0),
                       int(acc.get("internal.metrics.executorCpuTime", 0) or 0) / 1e9,
                       int(acc.get("internal.metrics.shuffle.write.bytesWritten", 0) or 0) / 1e6,
                       acc.get("internal.metrics.shuffle.write.recordsWritten", 0))


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.1"
    k = int(argv[2]) if len(argv) > 2 else 10
    parts = int(argv[3]) if len(argv) > 3 else 16
    extra_conf = dict(kv.split("=", 1) for kv in argv[4].split(",")) if len(argv) > 4 and argv[4] else {}
    from pyspark.sql import functions as F

    from strata.operators.payment_history import php_updates
    from strata.operators.report import final_report
    from strata.plans import fixtures as fx
    from strata.session import get_session, scratch_path

    log_dir = tempfile.mkdtemp(prefix="strata-probe-events-")
    spark = get_session("local[8]", app_name="strata-probe", shuffle_partitions=32,
                        extra={"spark.driver.memory": "16g", "spark.eventLog.enabled": "true",
                               "spark.eventLog.dir": f"file://{log_dir}", "spark.eventLog.compress": "false",
                               **extra_conf})
    base = fx.reversal_extract(spark, sf_dir)
    copies = base.select(F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("_copy"), "*")
    offset = F.col("_copy").cast("long") * F.lit(10 ** 9)
    extract_path = scratch_path(spark, "probe-extract")
    copies.withColumn("ln_no", F.col("ln_no") + offset).drop("_copy").repartition(parts).write.parquet(extract_path)
    ext = spark.read.parquet(extract_path)
    spark.sparkContext.setJobDescription("final_report")
    t0 = time.perf_counter()
    final_report(php_updates(ext, fx.AS_OF), fx.AS_OF).write.format("noop").mode("overwrite").save()
    took = time.perf_counter() - t0
    spark.stop()
    print(f"final_report on {k}x {sf_dir} ({parts} files): {took:.2f} s")
    print("stage tasks wall_ms cpu_s shuffle_MB records")
    for row in stage_rows(log_dir):
        print(*[f"{v:.2f}" if isinstance(v, float) else v for v in row])


if __name__ == "__main__":
    main(sys.argv)
