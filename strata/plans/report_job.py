"""The end-to-end payment-history report job and its output."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.operators.payment_history import php_updates
from strata.operators.report import final_report, report_cx6_strings, report_label_frame, report_rows
from strata.sources.reversals import normalize_reversals, scan_reversals, scan_run_date

REPORT_DATASET = "Reversals"
LABEL_DATASET = "report_label"
ROWS_DATASET = "Reversals_rows"
CX6_DATASET = "Reversals_cx6_strings"


def report_dir(out_dir: str, run_mmddyyyy: str, prefix: str = "payment_reversal_report") -> str:
    return f"{out_dir.rstrip('/')}/{prefix}_{run_mmddyyyy}"


def write_report(report: DataFrame, label: str, out_dir: str, run_mmddyyyy: str) -> str:
    """Write the report and a one-row label table side by side under a
    run-date name; returns the folder.  Spark's commit protocol makes each
    write all-or-nothing, so a lost executor only re-runs its tasks."""
    target = report_dir(out_dir, run_mmddyyyy)
    report.write.mode("overwrite").parquet(f"{target}/{REPORT_DATASET}")
    report_label_frame(report.sparkSession, label).coalesce(1).write.mode("overwrite").parquet(
        f"{target}/{LABEL_DATASET}")
    return target


def report_lines(report: DataFrame) -> DataFrame:
    """The report as text, one JSON line (``line``) a row, NULLs written out."""
    row = F.struct(*[F.col(f"`{c}`") for c in report.columns])
    return report.select(F.to_json(row, {"ignoreNullFields": "false"}).alias("line"))


def parse_report_lines(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """The report back from its text lines."""
    return lines.select(F.from_json("line", schema).alias("_r")).select("_r.*")


def read_report(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(f"{target}/{REPORT_DATASET}")


def write_factored_report(updates: DataFrame, label: str, out_dir: str, run_mmddyyyy: str, as_of=None) -> str:
    """Write the report in factored form: per-row columns and per-loan CX6
    strings with counts (their join on ``ln_no`` is the paired report)."""
    target = report_dir(out_dir, run_mmddyyyy)
    report_rows(updates).write.mode("overwrite").parquet(f"{target}/{ROWS_DATASET}")
    report_cx6_strings(updates, as_of).write.mode("overwrite").parquet(f"{target}/{CX6_DATASET}")
    report_label_frame(updates.sparkSession, label).coalesce(1).write.mode("overwrite").parquet(
        f"{target}/{LABEL_DATASET}")
    return target


# ---- publication by run date ---------------------------------------------------------------

PUBLISHED, LABELS = "published", "labels"


def publish_report(report: DataFrame, label: str, out_dir: str, run_date) -> str:
    """Publish a report for a run date and say which version it is.

    The rows go to a version of their own (a partition of ``published`` that no
    other writer touches); only when they are all there does one small append to
    ``labels`` name it.  A job that dies in between leaves a version nobody
    reads; a rerun publishes a newer one.  Overwriting the date's partition in
    place would have readers see neither while old files go and new ones come.
    """
    spark, base = report.sparkSession, out_dir.rstrip("/")
    version = uuid.uuid4().hex
    report.write.parquet(f"{base}/{PUBLISHED}/run_date={run_date}/version={version}")
    said = spark.range(1).select(F.lit(str(run_date)).cast("date").alias("run_date"), F.lit(version).alias("version"),
                                 F.lit(label).alias("label"), F.current_timestamp().alias("published_at"))
    said.coalesce(1).write.mode("append").parquet(f"{base}/{LABELS}")
    return version


def read_published(spark: SparkSession, out_dir: str, run_date) -> tuple[DataFrame, str]:
    """The rows and the label last published for a run date."""
    base = out_dir.rstrip("/")
    labels = spark.read.schema("run_date date, version string, label string, published_at timestamp").parquet(f"{base}/{LABELS}")
    last = (labels.where(F.col("run_date") == F.lit(str(run_date)).cast("date"))
            .agg(F.max(F.struct("published_at", "version", "label")).alias("last")).first()["last"])
    if last is None:
        raise ValueError(f"nothing published for {run_date}")
    return spark.read.parquet(f"{base}/{PUBLISHED}/run_date={run_date}/version={last['version']}"), last["label"]


def run_report(spark: SparkSession, extract_path: str, dates: DataFrame, out_dir: str, label: str,
               as_of=None, fmt: str = "parquet", factored: bool = True, **read_options) -> str:
    """Read the run date and the extract, build the report, write it.

    The two pair-free parts are written; ``factored=False`` writes the paired
    report instead, which grows with the square of a loan's distinct rows."""
    _, run_text = scan_run_date(dates)
    extract = normalize_reversals(scan_reversals(spark, extract_path, fmt, **read_options))
    updates = php_updates(extract, as_of)
    if factored:
        return write_factored_report(updates, label, out_dir, run_text, as_of)
    return write_report(final_report(updates, as_of), label, out_dir, run_text)


def register_views(spark: SparkSession, extract: DataFrame, as_of=None, prefix: str = "") -> dict[str, DataFrame]:
    """Publish the job's stages as temp views so they can be queried with
    ``spark.sql`` (names: sor_with_cx6, php_periods, php_updates,
    cx6_updates, final_report)."""
    from strata.operators.payment_history import php_periods
    from strata.operators.report import cx6_updates

    updates = php_updates(extract, as_of)
    frames = {
        "sor_with_cx6": extract,
        "php_periods": php_periods(extract),
        "php_updates": updates,
        "cx6_updates": cx6_updates(updates, as_of),
        "final_report": final_report(updates, as_of),
    }
    for name, df in frames.items():
        df.createOrReplaceTempView(prefix + name)
    return frames
