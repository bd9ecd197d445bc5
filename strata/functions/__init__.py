"""Column helpers: small expressions reused by the operators.

All return ``pyspark.sql.Column`` built from JVM-side functions, so they stay
inside whole-stage code generation.
"""

from strata.functions.dates import (  # noqa: F401
    as_date, lenient_date, month_diff, month_start, snapshot_month, year_start,
    fmt_mdy, fmt_mdy_short, is_sentinel,
)
from strata.functions.strings import (  # noqa: F401
    concat_skip_null, substring_neg, mask_except, mask_chars, html_escape,
)
from strata.functions.sizes import human_size, whole_mb  # noqa: F401
