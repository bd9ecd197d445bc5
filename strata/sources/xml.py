"""XML row elements (``<z:row a='..' b='..'/>``) as a table of strings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Element text gets a column name no XML attribute can have (names hold no blanks).
VALUE_TAG = "element text"


def scan_xml_rows(spark: SparkSession, path: str, row_tag: str = "z:row", schema=None,
                  attribute_prefix: str = "_") -> DataFrame:
    """One row per ``row_tag`` element, attributes as string columns named
    without the prefix; attributes absent on an element are NULL.  Values are
    kept verbatim (no trimming).

    Without ``schema`` the reader infers the column set (one extra pass),
    keeps every value as text and returns attributes only (element text and
    child elements are not attributes)."""
    reader = (spark.read.format("xml").option("rowTag", row_tag)
              .option("attributePrefix", attribute_prefix).option("inferSchema", "false")
              .option("ignoreSurroundingSpaces", "false").option("valueTag", VALUE_TAG))
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.load(path)
    n = len(attribute_prefix)
    if schema is None and n:
        df = df.select(*[f"`{c}`" for c in df.columns if c.startswith(attribute_prefix)])
    return df.toDF(*[c[n:] if n and c.startswith(attribute_prefix) else c for c in df.columns])


def explode_xml_rows(df: DataFrame, column: str, row_schema: str, path: str = "`rs:data`.`z:row`",
                     attribute_prefix: str = "_") -> DataFrame:
    """Row elements of a text column that holds whole documents: the elements at
    ``path`` below the document's root, their attributes as string columns.
    ``row_schema`` lists the attributes with their prefix; those absent on an
    element are NULL."""
    outer, inner = path.split(".")
    schema = f"{outer} struct<{inner}: array<struct<{row_schema}>>>"
    options = {"attributePrefix": attribute_prefix, "ignoreSurroundingSpaces": "false"}
    rows = F.from_xml(column, schema, options).getField(outer.strip("`")).getField(inner.strip("`"))
    out = df.select(F.explode(rows).alias("_r")).select("_r.*")
    n = len(attribute_prefix)
    return out.toDF(*[c[n:] if c.startswith(attribute_prefix) else c for c in out.columns])


_ATTRIBUTE = r"""([^\s=<>/]+)\s*=\s*(?:"[^"]*"|'[^']*')"""


def attribute_names(df: DataFrame, column: str, row_tag: str = "z:row") -> list[str]:
    """The attribute names of all ``row_tag`` elements, sorted.  Each document's
    names are taken from its tags and aggregated; one row a name reaches the
    driver.  A tag inside a comment counts too: its names only add NULL columns."""
    tags = F.regexp_extract_all(F.col(column), F.lit(rf"<{row_tag}((?:\s+{_ATTRIBUTE})+)\s*/?>"), F.lit(1))
    names = F.regexp_extract_all(F.concat_ws(" ", F.array_distinct(F.transform(tags, _without_values))), F.lit(_ATTRIBUTE), F.lit(1))
    found = df.select(F.explode(F.array_distinct(names)).alias("name")).distinct().collect()
    return sorted(r["name"] for r in found)


def _without_values(tag):
    return F.regexp_replace(tag, r"""=\s*(?:"[^"]*"|'[^']*')""", "=''")


def explode_xml_union(df: DataFrame, column: str, row_tag: str = "z:row", parent: str = "rs:data", attribute_prefix: str = "_") -> DataFrame:
    """``explode_xml_rows`` without a declared list: a column for each attribute
    that occurs in any row element, so rows of any documents are bound by name."""
    names = attribute_names(df, column, row_tag)
    if not names:
        return df.select(F.lit(None).alias("none")).where("false").drop("none")
    schema = ", ".join(f"`{attribute_prefix}{n}` string" for n in names)
    return explode_xml_rows(df, column, schema, f"`{parent}`.`{row_tag}`", attribute_prefix)
