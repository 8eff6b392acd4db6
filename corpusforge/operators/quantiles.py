"""Exact linear-interpolation quantiles without sorting or collecting a group.

A sketch brackets every wanted rank, one counting pass locates it, and only values inside the narrow
brackets are sorted, in ranges of bounded size. Copies of a value are one row from the first aggregation on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusforge.operators.ranking import running_in_ranges
from corpusforge.session import materialize

ACCURACY = 10_000
BRACKET = 2.0 / ACCURACY


def bracket_columns(value: str, probs: list[float], prefix: str = "_b") -> list[Column]:
    """Sketch aggregates whose results enclose each quantile's rank; mix them into any ``agg``."""
    wanted: list[float] = []
    for p in probs:
        wanted += [max(p - BRACKET, 0.0), min(p + BRACKET, 1.0)]
    return [F.percentile_approx(value, wanted, ACCURACY).alias(f"{prefix}rackets")]


def order_values(
    long: DataFrame, base: DataFrame, by: list[str], value: str, brackets: int, ranks: list[Column]
) -> DataFrame:
    """``by, n, r0, r1, ...``: the values at 0-based ``ranks`` (columns over ``n``) of every group.

    ``base`` is a materialized table with one row per group: ``n`` (non-null values) and
    ``_brackets``; a rank must lie in a bracket or right beside one. Ranks outside ``0..n-1`` give NULL.
    """
    frame = base.select(*by, "n", "_brackets").filter("n > 0")
    x = F.col(value)
    zone: Column = F.lit(0)
    in_band: Column = F.lit(False)
    for i in range(brackets):
        low, high = F.get("_brackets", F.lit(2 * i)), F.get("_brackets", F.lit(2 * i + 1))
        zone = zone + (x >= low).cast("int") + (x > high).cast("int")
        in_band = in_band | ((x >= low) & (x <= high))
    entries = (
        long.filter(x.isNotNull())
        .join(frame, by)
        .groupBy(*by, "n", zone.alias("_zone"), F.when(in_band, x).alias("_v"))
        .agg(F.count(F.lit(1)).alias("_cnt"), F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    )
    entries = running_in_ranges(entries, by, [F.col("_zone"), F.col("_v")], F.col("_cnt"), "_upto")
    entries = entries.withColumn("_from", F.col("_upto") - F.col("_cnt"))

    def at(rank: Column) -> Column:
        here = (F.col("_from") <= rank) & (rank < F.col("_upto"))
        known = (
            F.when(F.col("_v").isNotNull(), F.col("_v"))
            .when(rank == F.col("_from"), F.col("_lo"))
            .when(rank == F.col("_upto") - 1, F.col("_hi"))
        )
        return F.max(F.when(here, known))

    missed = F.raise_error(F.lit("a rank fell outside its sketch bracket")).cast("double")
    found = entries.groupBy(*by, "n").agg(*[at(r).alias(f"_r{i}") for i, r in enumerate(ranks)])
    checked = [
        F.when(F.col(f"_r{i}").isNull() & (r >= 0) & (r < F.col("n")), missed).otherwise(F.col(f"_r{i}")).alias(f"r{i}")
        for i, r in enumerate(ranks)
    ]
    return found.select(*by, "n", *checked)


def refine(long: DataFrame, base: DataFrame, by: list[str], value: str, probs: list[float]) -> DataFrame:
    """Exact quantiles ``q0..`` per group, from the sketches in ``base``."""
    positions = [F.lit(float(p)) * (F.col("n") - 1).cast("double") for p in probs]
    ranks: list[Column] = []
    for position in positions:
        k = F.floor(position)
        ranks += [k, F.least(k + 1, F.col("n") - 1)]
    found = order_values(long, base, by, value, len(probs), ranks)
    outs = []
    for i, position in enumerate(positions):
        low, high = F.col(f"r{2 * i}"), F.col(f"r{2 * i + 1}")
        part = position - F.floor(position)
        # weighted ends, as SQL's quantile_cont: ``low + (high - low) * part`` differs in the last bit, which shows in text
        outs.append(F.when(part == 0, low).otherwise(low * (1 - part) + high * part).alias(f"q{i}"))
    return found.select(*by, *outs)


def exact_quantiles(long: DataFrame, by: list[str], value: str, probs: list[float]) -> DataFrame:
    """``by, n, q0, q1, ...``: exact quantiles of ``value`` per group, NULLs ignored."""
    base = long.groupBy(*by).agg(F.count(value).alias("n"), *bracket_columns(value, probs))
    base = materialize(base)
    return base.select(*by, "n").join(refine(long, base, by, value, probs), by, "left")


def table_quantiles(df: DataFrame, value: str, probs: list[float]) -> list[float]:
    """Quantiles of one column of a whole table, as a few numbers on the driver."""
    long = df.select(F.lit(0).alias("_all"), F.col(value).cast("double").alias("_x"))
    row = exact_quantiles(long, ["_all"], "_x", probs).first()
    if row is None or row["n"] == 0:
        raise ValueError(f"column {value} has no values")
    return [row[f"q{i}"] for i in range(len(probs))]
