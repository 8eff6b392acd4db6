"""Number text equals Python's."""

import math
import random
import struct

from pyspark.sql import functions as F

from corpusforge.functions.numbers import coerce_01, fmt_fixed, fmt_pct, fmt_thousands, percent_label, py_str


def samples():
    rng = random.Random(1)
    fixed = [0.125, 1.005, 1.015, 2.675, 0.5, 1.5, 2.5, -0.001, 1e7, 1.5e7, 123456789.125, 1e16, 1.2e-4, 9.9e-5, 1e-5, 99.995, 0.0]
    return (
        fixed
        + [round(rng.uniform(0, 1000), 3) for _ in range(800)]
        + [rng.randint(0, 10000) / 8 for _ in range(300)]
        + [10 ** rng.uniform(-9, 17) for _ in range(800)]
    )


def test_formats_like_python(spark):
    x = F.col("x")
    df = spark.createDataFrame([(float(v),) for v in samples()], "x double")
    rows = df.select("x", fmt_fixed(x, 2), fmt_fixed(x, 3), fmt_fixed(x, 0), py_str(x), fmt_pct(x), fmt_thousands(x)).collect()
    for v, two, three, whole, shortest, pct, thousands in rows:
        assert (two, three, whole, shortest, thousands) == (f"{v:.2f}", f"{v:.3f}", f"{v:.0f}", str(v), f"{v:,.0f}")
        if abs(v) < 1e15:
            assert pct == f"{v:.1%}"


def test_every_digit_count_and_half_way_values(spark):
    x = F.col("x")
    halves = [k / 2**j for j in range(1, 16) for k in (1, 3, 5, 7, 9, 11)]
    decimals = [k / 10**j + 5 / 10 ** (j + 1) for j in range(0, 7) for k in range(0, 12)]
    edges = [0.00005, 0.00055, -0.0, -0.00004, float("inf"), float("-inf"), 1e38, 1.5e38, 1e23, 1.7e308, 5e-324, 2.0**63]
    values = halves + decimals + edges + [-v for v in halves + decimals]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    rows = df.select("x", *[fmt_fixed(x, d) for d in range(7)], py_str(x)).collect()
    for v, *texts, shortest in rows:
        assert texts == [f"{v:.{d}f}" for d in range(7)] and shortest == repr(v)


def test_missing_numbers_and_labels(spark):
    df = spark.createDataFrame([(None, 25.0, True), (float("nan"), 33.333, False)], "x double, p double, b boolean")
    rows = df.select(fmt_fixed(F.col("x"), 2), percent_label(F.col("p")), coerce_01(F.col("b"))).collect()
    assert [tuple(r) for r in rows] == [("nan", "25%", 1), ("nan", "33.3%", 0)]


def test_random_bits(spark):
    """Any finite double, and many with few or many digits."""
    r = random.Random(9)
    values = [struct.unpack("<d", struct.pack("<Q", r.getrandbits(64)))[0] for _ in range(6_000)]
    values += [round(r.uniform(-(10 ** r.randint(0, 18)), 10 ** r.randint(0, 18)), r.randint(0, 7)) for _ in range(6_000)]
    values += [s * (k + 0.5) / 10**d for k in range(0, 200, 7) for d in range(7) for s in (1, -1)]
    values += [math.nextafter(v, up) for v in values[-400:] for up in (math.inf, -math.inf)]
    values = [v for v in values if v == v]
    x = F.col("x")
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for v, *texts, shortest, grouped in df.select("x", *[fmt_fixed(x, d) for d in (0, 1, 2, 3, 4, 6)], py_str(x), fmt_thousands(x)).collect():
        assert texts == [f"{v:.{d}f}" for d in (0, 1, 2, 3, 4, 6)] and shortest == repr(v) and grouped == f"{v:,.0f}", v


def test_no_python_in_number_text(spark):
    x = F.col("id").cast("double")
    plan = spark.range(9).select(fmt_fixed(x, 2), py_str(x), fmt_thousands(x), percent_label(x))
    assert "Python" not in plan._jdf.queryExecution().toString()
