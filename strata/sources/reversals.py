"""The reversal extract and the run-date table."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions.dates import lenient_date

# Extract columns holding month/day/year text dates.
DATE_COLUMNS = ("rev_transaction_dt", "otod", "sor_dofd", "trans_due_dt", "rev_eff_date", "pymt_tran_dt")


def lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def scan_reversals(spark: SparkSession, path: str, fmt: str = "parquet", schema=None,
                   **options) -> DataFrame:
    """Read a landed extract (parquet / csv / json ...) with lower-cased names.

    Pass ``schema`` for text formats: inference costs a full extra pass."""
    reader = spark.read.format(fmt).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    return lower_names(reader.load(path))


def normalize_reversals(df: DataFrame, date_columns=DATE_COLUMNS, pattern: str = "M/d/yyyy") -> DataFrame:
    """Status as text, every timestamp as a date, the late flag as boolean, and
    the named text-date columns parsed leniently (unparseable -> NULL).  A
    date column that already holds dates is kept."""
    df = lower_names(df)
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = {}
    for name, dtype in types.items():
        if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
            cols[name] = F.col(name).cast("date")
    if "account_status" in types:
        cols["account_status"] = F.col("account_status").cast("string")
    if "rev_aftr_30_days" in types:
        cols["rev_aftr_30_days"] = F.col("rev_aftr_30_days").try_cast("boolean")
    for name in date_columns:
        if isinstance(types.get(name), T.StringType):
            cols[name] = lenient_date(name, pattern)
    return df.withColumns(cols)


BAD_LINE = "bad_line"


def extract_from_lines(lines: DataFrame, schema: T.StructType, column: str = "line", **options) -> DataFrame:
    """A text extract's lines (CSV, without header) by the declared ``schema``, with
    lower-cased names and ``bad_line``: a line that doesn't fit (too few or too
    many fields, a value not of its type) has its text there and NULLs in all
    other columns, so no line is lost and none is half read."""
    declared = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields) + f", `{BAD_LINE}` string"
    reading = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD_LINE, **options}
    row = F.from_csv(F.col(column), declared, reading)
    read = lines.select(row.alias("_r"))
    good = F.col(f"_r.{BAD_LINE}").isNull()
    return read.select(*[F.when(good, F.col("_r")[f.name]).alias(f.name.lower()) for f in schema.fields],
                       F.col(f"_r.{BAD_LINE}").alias(BAD_LINE))


def scan_extract_lines(spark: SparkSession, path: str, schema: T.StructType, **options) -> DataFrame:
    """``extract_from_lines`` over text files (splittable; no quoted line breaks)."""
    return extract_from_lines(spark.read.text(path), schema, "value", **options)


def read_run_date_table(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    return spark.read.format(fmt).options(**options).load(path)


def run_date_frame(dates: DataFrame) -> DataFrame:
    """From a run-date table (second column = ``yyyyMMdd`` text): the run date
    and its ``MMddyyyy`` form used in output names."""
    text = F.col(f"`{dates.columns[1]}`")
    d = F.try_to_date(text, "yyyyMMdd")
    return dates.select(d.alias("run_date"), F.date_format(d, "MMddyyyy").alias("run_date_mmddyyyy"))


def scan_run_date(dates: DataFrame) -> tuple[_dt.date, str]:
    """The run date on the driver; the table must hold exactly one row (a
    distributed table has no "first" row to fall back on)."""
    rows = run_date_frame(dates).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"run-date table must have exactly one row, found {len(rows)}+")
    if rows[0]["run_date"] is None:
        raise ValueError("run-date value is not a yyyyMMdd date")
    return rows[0]["run_date"], rows[0]["run_date_mmddyyyy"]
