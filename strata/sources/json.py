"""JSON envelopes ``{"result": [record, ...]}`` as record rows.

Records are bound by field name (a record listing its keys in another order
still lands in the right columns).  An envelope without ``result`` fails the
job, as a response without results is an error.  Every record of an envelope
is kept, however many there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.operators.ordering import numbered

NO_RESULT = "No results found in the response"


def envelope_schema(record_schema: T.StructType, field: str = "result") -> T.StructType:
    return T.StructType([T.StructField(field, T.ArrayType(record_schema))])


def _records(arr: Column) -> Column:
    return F.when(arr.isNull(), F.raise_error(F.lit(NO_RESULT))).otherwise(arr)


def explode_result(df: DataFrame, column: str, record_schema: T.StructType,
                   field: str = "result", keep=()) -> DataFrame:
    """Parse a JSON text column holding envelopes and explode the records."""
    env = F.from_json(F.col(column), envelope_schema(record_schema, field))
    return (df.select(*keep, F.explode(_records(env.getField(field))).alias("_r"))
            .select(*keep, "_r.*"))


def scan_json_result(spark: SparkSession, path: str, record_schema: T.StructType,
                     field: str = "result", multi_line: bool = False) -> DataFrame:
    """Read envelope files (one per line, or one document per file with
    ``multi_line``) with a declared schema and explode the records."""
    env = spark.read.schema(envelope_schema(record_schema, field)).option("multiLine", multi_line).json(path)
    return env.select(F.explode(_records(F.col(field))).alias("_r")).select("_r.*")


def result_pages(records: DataFrame, page_size: int, order: list[str]) -> DataFrame:
    """The records in pages of ``page_size``, none lost: ``position`` in the whole
    order (ties by the other columns) and ``page``, both from 0.  The last page
    may be short."""
    if page_size < 1:
        raise ValueError("a page holds at least one record")
    return numbered(records, order).withColumn("page", F.floor(F.col("position") / page_size))


# ---- records whose keys are not known beforehand -----------------------------------------

# Types of a key's values as Spark's schema of variants names them, and the column type each
# becomes; anything else (objects, arrays, mixed kinds) stays JSON text.
_VALUE_TYPES = (("BIGINT", "bigint"), ("DECIMAL", "double"), ("DOUBLE", "double"), ("FLOAT", "double"), ("BOOLEAN", "boolean"))


def variant_records(df: DataFrame, column: str, field: str | None = None, keep=()) -> DataFrame:
    """JSON text as rows of ``keep`` and one ``record`` of type variant: the text
    itself, or with ``field`` each element of the array under that key.  An
    envelope without the array fails the job; other text that isn't JSON, and a
    NULL, has a NULL record."""
    parsed = df.select(*keep, F.try_parse_json(F.col(column)).alias("record"))
    if field is None:
        return parsed
    array = F.try_variant_get("record", f"$.{field}", "array<variant>")
    checked = parsed.select(*keep, _records(array).alias("_a"))
    return checked.select(*keep, F.explode("_a").alias("record"))


def record_columns(records: DataFrame) -> dict[str, str]:
    """The keys that occur in ``record`` and the column type each gets.  Found in
    one pass, aggregated by key; a row a key reaches the driver."""
    spark = records.sparkSession
    pairs = records.select("record").lateralJoin(spark.tvf.variant_explode(F.col("record").outer())).select("key", "value")
    found = pairs.where("key IS NOT NULL").groupBy("key").agg(F.schema_of_variant_agg("value").alias("kind")).collect()
    return {r["key"]: next((t for name, t in _VALUE_TYPES if r["kind"].startswith(name)), "string") for r in sorted(found)}


def records_by_name(records: DataFrame, keep=(), columns: dict[str, str] | None = None) -> DataFrame:
    """``keep`` and a column for each key of the records, bound by name; a key that
    a record lacks is NULL there, and so is a value of another type."""
    columns = record_columns(records) if columns is None else columns
    # a path in double quotes takes any key; those with a double quote go in single ones
    path = {k: f"$['{k}']" if '"' in k else f'$["{k}"]' for k in columns}
    return records.select(*keep, *[F.try_variant_get("record", path[k], t).alias(k) for k, t in columns.items()])
