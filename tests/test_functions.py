"""Unit tables for the Column helpers and their traps."""

import datetime as dt
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from strata.functions.dates import lenient_date, month_diff, snapshot_month
from strata.functions.sizes import human_size, whole_mb
from strata.functions.strings import concat_skip_null, mask_chars, mask_except, substring_neg
from strata.functions.tdist import t_quantile


def one(spark, col, schema="x string"):
    return spark.createDataFrame([("abcdef",)], schema).select(col.alias("r")).first()["r"]


def test_concat_skip_null(spark):
    df = spark.createDataFrame([("a", None, "b"), (None, None, None)], "x string, y string, z string")
    got = [r[0] for r in df.select(concat_skip_null("x", "y", "z")).collect()]
    assert got == ["ab", ""]
    # plain concat propagates NULL
    assert df.select(F.concat("x", "y", "z")).first()[0] is None


def test_substring_negative_length_matches_duckdb(spark):
    con = duckdb.connect()
    cases = [(i, n) for i in range(1, 8) for n in range(-9, 5)]
    rows = spark.createDataFrame([("abcdef", i, n) for i, n in cases], "s string, i int, n int")
    got = {(r.i, r.n): r.r for r in rows.select("i", "n", substring_neg("s", "i", "n").alias("r")).collect()}
    for i, n in cases:
        want = con.execute(f"SELECT substring('abcdef', {i}, {n})").fetchone()[0]
        assert got[(i, n)] == want, (i, n)


def test_month_diff_counts_boundaries(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 31), dt.date(2024, 2, 1)),
                                (dt.date(2022, 1, 1), dt.date(2021, 11, 15)),
                                (None, dt.date(2021, 1, 1))], "a date, b date")
    assert [r[0] for r in df.select(month_diff("a", "b")).collect()] == [1, -2, None]


def test_snapshot_month(spark):
    days = [dt.date(2024, 3, d) for d in (1, 5, 6, 31)] + [dt.date(2024, 1, 3)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    got = [r[0] for r in df.select(snapshot_month("d")).collect()]
    assert got == [dt.date(2024, 2, 1), dt.date(2024, 2, 1), dt.date(2024, 3, 1), dt.date(2024, 3, 1),
                   dt.date(2023, 12, 1)]


def test_lenient_date(spark):
    df = spark.createDataFrame([("1/5/2024",), ("01/05/2024",), ("13/45/2024",), ("x",), (None,)], "s string")
    got = [r[0] for r in df.select(lenient_date("s")).collect()]
    assert got == [dt.date(2024, 1, 5), dt.date(2024, 1, 5), None, None, None]


def test_masks(spark):
    df = spark.createDataFrame([("0B12JK9L0",)], "s string")
    r = df.select(mask_except("s", "B", "D").alias("a"), mask_chars("s", "123456JKL0", "D").alias("b")).first()
    assert r.a == "DBDDDDDDD"
    assert r.b == "DBDDDD9DD"


KIB, MIB, GIB, TIB, PIB = (1024 ** i for i in range(1, 6))
# Worked by hand: (bytes, tight, spaced, integer).
SIZES = [
    (0, "0.0B", "0.0 B", "0B"),
    (1, "1.0B", "1.0 B", "1B"),
    (1023, "1023.0B", "1023.0 B", "1023B"),
    (KIB, "1.0KB", "1.0 KB", "1024B"),
    (KIB + 1, "1.0KB", "1.0 KB", "1K"),
    (1280, "1.2KB", "1.2 KB", "1K"),
    (1536, "1.5KB", "1.5 KB", "1K"),
    (MIB - 1, "1024.0KB", "1024.0 KB", "1023K"),
    (MIB, "1.0MB", "1.0 MB", "1024K"),
    (MIB + 52429, "1.1MB", "1.1 MB", "1M"),
    (GIB - 1, "1024.0MB", "1024.0 MB", "1023M"),
    (5 * TIB + 7, "5.0TB", "5.0 TB", "5T"),
    (PIB, "1.0PB", "1.0 PB", "1024T"),
    (1024 * PIB, "1.0PB", "1024.0 PB", "1024P"),
    (3 * 1024 * PIB + 12345, "3.0PB", "3072.0 PB", "3"),
    (4096 * PIB, "4.0PB", "4096.0 PB", "4"),
]


@pytest.mark.parametrize("style,column", [("tight", 1), ("spaced", 2), ("integer", 3)])
def test_human_size(spark, style, column):
    df = spark.createDataFrame([(s[0],) for s in SIZES], "b long")
    got = [r[0] for r in df.select(human_size("b", style)).collect()]
    assert got == [s[column] for s in SIZES]


def test_whole_mb(spark):
    df = spark.createDataFrame([(0,), (1,), (1048576,), (1048577,)], "b long")
    assert [r[0] for r in df.select(whole_mb("b")).collect()] == [0, 1, 1, 2]


# Critical values of Student's t from printed tables, by degrees of freedom.
T_TABLE = {
    0.95: {1: 6.313752, 2: 2.919986, 5: 2.015048, 10: 1.812461, 30: 1.697261, 50: 1.675905, 60: 1.670649, 120: 1.657651},
    0.975: {1: 12.706205, 3: 3.182446, 10: 2.228139, 50: 2.008559, 100: 1.983972},
    0.99: {1: 31.820516, 2: 6.964557, 3: 4.540703, 10: 2.763769, 30: 2.457262, 50: 2.403272},
    0.9995: {1: 636.619249, 2: 31.599055, 5: 6.868827, 30: 3.645959},
}


def central_probability(t, nu, panels=20000):
    """P(-t < T < t) as a share of the integral over the angle, by midpoints."""
    import numpy as np

    def total(to):
        x = (np.arange(panels) + 0.5) * (to / panels)
        return np.sum(np.cos(x) ** (nu - 1)) * (to / panels)

    return total(math.atan(t / math.sqrt(nu))) / total(math.pi / 2)


@pytest.mark.parametrize("p", sorted(T_TABLE))
def test_t_quantile_table(spark, p):
    df = spark.createDataFrame([(d,) for d in T_TABLE[p]], "d long")
    got = [r[0] for r in df.select(t_quantile(F.col("d"), p)).collect()]
    assert all(math.isclose(g, want, rel_tol=1e-6) for g, want in zip(got, T_TABLE[p].values()))


@pytest.mark.parametrize("level", [0.9, 0.98, 0.999, 0.9999])
def test_t_quantile_inverts_the_distribution(spark, level):
    degrees = [*range(1, 200), 5000]
    df = spark.createDataFrame([(d,) for d in [0, *degrees]], "d long")
    got = [r[0] for r in df.select(t_quantile(F.col("d"), (1 + level) / 2)).collect()]
    assert got[0] is None
    # 1 - level is at least 1e-4: an error of 1e-9 in t would show here
    assert all(abs(central_probability(t, d) - level) < 1e-9 for t, d in zip(got[1:], degrees))
    assert all(a > b for a, b in zip(got[1:], got[2:]))
