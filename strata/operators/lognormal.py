"""Grouped log-normal confidence interval for the mean of log values.

Per group: keep positive, non-NaN values; n, mean and sample standard
deviation of ln(x); standard error sd/sqrt(n); Student-t critical value at
1 - alpha/2 with n-1 degrees of freedom; bounds exp(mean -/+ t*se) and point
estimate exp(mean) (the geometric mean).  One ``groupBy`` with algebraic
aggregates (count, avg, stddev_samp), so partial aggregation runs map-side
and a hot group costs nothing extra.

NULL values are dropped; n = 1 gives NULL sd and bounds; a group without any
positive value gives n = 0 and NULLs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions.tdist import t_quantile


def _log_positive(value: str):
    x = F.col(value).cast("double")
    return F.ln(F.when((x > 0) & ~F.isnan(x), x))


def lognormal_stats(df: DataFrame, keys, value: str) -> DataFrame:
    keys = [keys] if isinstance(keys, str) else list(keys)
    lx = _log_positive(value)
    return df.groupBy(*keys).agg(
        F.count(lx).alias("n"), F.avg(lx).alias("mean_log"), F.stddev_samp(lx).alias("sd_log"))


def lognormal_ci(df: DataFrame, keys, value: str, confidence_level: float = 0.98) -> DataFrame:
    if not 0.0 < confidence_level < 1.0:
        raise ValueError("confidence_level must be in (0, 1)")
    keys = [keys] if isinstance(keys, str) else list(keys)
    stats = lognormal_stats(df, keys, value)
    alpha = 1.0 - confidence_level
    t = t_quantile(F.col("n") - 1, 1.0 - alpha / 2.0)
    se = F.col("sd_log") / F.sqrt(F.col("n").cast("double"))
    return stats.select(
        *keys,
        F.exp(F.col("mean_log") - t * se).alias("lower"),
        F.exp(F.col("mean_log") + t * se).alias("upper"),
        F.exp(F.col("mean_log")).alias("point_estimate"),
        F.lit(confidence_level).alias("confidence_level"),
        "n", "mean_log", "sd_log")
