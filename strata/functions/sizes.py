"""Human-readable byte sizes, three house styles.

``tight``   : ``1.5KB`` -- one decimal, units B..PB, a sixth division still
              prints PB.
``spaced``  : ``1.5 KB`` -- same rule, units B..TB, PB after the fifth division.
``integer`` : ``1K`` -- integer division while the value is strictly above
              1024, units B K M G T P (past P there is no unit letter).

Rounding to one decimal is half-even on the exact binary value, as in
``printf``/Python formatting.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit ladders of the three styles.
UNITS_TIGHT = ["B", "KB", "MB", "GB", "TB", "PB"]
UNITS_SPACED = ["B", "KB", "MB", "GB", "TB"]
UNITS_INTEGER = ["B", "K", "M", "G", "T", "P"]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _decimal_ladder(size: Column, units: list[str], overflow_unit: str, sep: str) -> Column:
    x = size.cast("double")
    expr = None
    for i, unit in enumerate(units):
        scaled = x / F.lit(float(1024 ** i))
        text = F.concat(F.format_string("%.1f", F.bround(scaled, 1)), F.lit(sep + unit))
        cond = scaled < F.lit(1024.0)
        expr = F.when(cond, text) if expr is None else expr.when(cond, text)
    over = x / F.lit(float(1024 ** len(units)))
    return expr.otherwise(F.concat(F.format_string("%.1f", F.bround(over, 1)), F.lit(sep + overflow_unit)))


def _integer_ladder(size: Column) -> Column:
    b = size.cast("long")
    expr = None
    value = b
    for i in range(len(UNITS_INTEGER) + 1):
        unit = UNITS_INTEGER[i] if i < len(UNITS_INTEGER) else ""
        text = F.concat(value.cast("string"), F.lit(unit))
        cond = value <= F.lit(1024)
        if i == len(UNITS_INTEGER):
            expr = expr.otherwise(text)
        else:
            expr = F.when(cond, text) if expr is None else expr.when(cond, text)
        value = F.shiftright(value, 10)  # sizes are >= 0, so this is value div 1024
    return expr


def human_size(size, style: str = "tight") -> Column:
    size = _c(size)
    if style == "tight":
        return _decimal_ladder(size, UNITS_TIGHT, "PB", "")
    if style == "spaced":
        return _decimal_ladder(size, UNITS_SPACED, "PB", " ")
    if style == "integer":
        return _integer_ladder(size)
    raise ValueError(f"unknown size style {style!r}")


def whole_mb(size) -> Column:
    """Size in whole mebibytes, rounded up."""
    return F.ceil(_c(size).cast("double") / F.lit(1048576.0)).cast("long")
