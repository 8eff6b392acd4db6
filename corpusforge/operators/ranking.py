"""Seeded orders: exact ranks and exact cuts in hash order, spread over many tasks.

A plain ``row_number`` over a class puts the whole class into one task. Here rows are first counted
per leading hash digits, so every task ranks only one even piece of a class, and cuts (quotas) sort only
the single piece that the cut falls into. Orders by value are cut into ranges in the same way. The number
of pieces follows the number of rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.operators.joins import running
from corpusforge.session import materialize

RANGE_ROWS = 500_000


def seeded_hash(seed: int, tag: str, key: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(tag), F.col(key).cast("string")).cast("binary"))


def hash_digits(rows: int) -> int:
    """Leading hash digits that deal ``rows`` into about as many pieces as a piece has rows."""
    return max(2, math.ceil(math.log(max(rows, 2), 16) / 2))


def _bucketed(df: DataFrame, by: list[str], seed: int, tag: str, key: str) -> tuple[DataFrame, DataFrame]:
    digits = hash_digits(df.count())
    hashed = df.withColumn("_h", seeded_hash(seed, tag, key)).withColumn("_bucket", F.substring("_h", 1, digits))
    counts = hashed.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_cnt"))
    return hashed, materialize(counts.withColumn("_before", running(by, [F.col("_bucket")], "_cnt")))


def hash_ranked(df: DataFrame, by: list[str], seed: int, tag: str, key: str = "_row_id", name: str = "_rank") -> DataFrame:
    """Add the 1-based rank of every row within its group, in seeded hash order."""
    hashed, offsets = _bucketed(df, by, seed, tag, key)
    same = [F.col(f"h.{c}").eqNullSafe(F.col(f"o.{c}")) for c in [*by, "_bucket"]]
    joined = (
        hashed.alias("h")
        .join(offsets.alias("o"), _all(same))
        .select("h.*", "o._before")
    )
    within = Window.partitionBy(*by, "_bucket").orderBy("_h", key)
    rank = (F.col("_before") + F.row_number().over(within)).cast("bigint")
    return joined.withColumn(name, rank).drop("_h", "_bucket", "_before")


def hash_cuts(df: DataFrame, by: list[str], quotas: DataFrame, seed: int, tag: str, key: str = "_row_id") -> DataFrame:
    """For each (group, ``cut``) the hash and key of the row at rank ``k``.

    ``quotas`` holds ``by..., cut, k``. A row is inside the cut when its (hash, key) is not greater.
    Cuts with ``k`` = 0 give no row; callers read a missing cut as empty.
    """
    hashed, offsets = _bucketed(df.select(*by, key), by, seed, tag, key)
    same = [F.col(f"o.{c}").eqNullSafe(F.col(f"q.{c}")) for c in by]
    hit = (F.col("o._before") < F.col("q.k")) & (F.col("q.k") <= F.col("o._before") + F.col("o._cnt"))
    pieces = offsets.alias("o").join(quotas.alias("q"), _all([*same, hit])).select(
        *[F.col(f"o.{c}") for c in by], "o._bucket", "q.cut", (F.col("q.k") - F.col("o._before")).alias("_local")
    )
    same = [F.col(f"h.{c}").eqNullSafe(F.col(f"p.{c}")) for c in [*by, "_bucket"]]
    inside = hashed.alias("h").join(materialize(pieces).alias("p"), _all(same)).select(
        "h.*", "p.cut", "p._local"
    )
    ranked = inside.withColumn("_n", F.row_number().over(Window.partitionBy(*by, "cut").orderBy("_h", key)))
    return ranked.filter(F.col("_n") == F.col("_local")).select(*by, "cut", "_h", F.col(key).alias("_k"))


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def in_ranges(df: DataFrame, by: list[str], order: list[Column], rows: int = RANGE_ROWS) -> DataFrame:
    """Store ``df`` with the number ``_piece`` of the range of (``by``, ``order``) that a row lies in."""
    stored = materialize(df)
    pieces = -(-stored.count() // rows)
    if pieces <= 1:
        return stored.withColumn("_piece", F.lit(0))
    ranges = stored.repartitionByRange(pieces, *by, *order)
    return materialize(ranges.withColumn("_piece", F.spark_partition_id()))


def running_in_ranges(
    df: DataFrame, by: list[str], order: list[Column], value: Column, name: str, rows: int = RANGE_ROWS
) -> DataFrame:
    """Add the sum of ``value`` up to and with each row, per group in the given total order.

    Ranges are summed first, so a task orders one range only; a group may be larger than any task.
    """
    ranged = in_ranges(df.withColumn("_add", value), by, order, rows)
    sums = ranged.groupBy(*by, "_piece").agg(F.sum("_add").alias("_sum"))
    before = sums.select(*by, "_piece", running(by, [F.col("_piece")], "_sum").alias("_before"))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in [*by, "_piece"]]
    joined = ranged.alias("r").join(before.alias("s"), _all(same)).select("r.*", "s._before")
    within = Window.partitionBy(*by, "_piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return joined.withColumn(name, F.col("_before") + F.sum("_add").over(within)).drop("_piece", "_add", "_before")


def dense_positions(df: DataFrame, key: str, name: str = "pos", rows: int = RANGE_ROWS) -> DataFrame:
    """0-based position of every row in key order."""
    placed = running_in_ranges(df, [], [F.col(key)], F.lit(1), name, rows)
    return placed.withColumn(name, (F.col(name) - 1).cast("bigint"))
