"""Join helpers: one-row-per-key lookups, alignment and overlays."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lookup_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join many rows to a table with one row per key.

    A plain shuffle join on purpose: because every key has a single row on the right, adaptive
    execution may broadcast that side when its measured size allows it, and otherwise splits the
    partitions of keys that hold a large share of the left rows (only their single right row is
    repeated). Results must therefore not rely on the partitioning this join leaves behind.
    """
    return left.join(right, keys, how)


def with_split(df: DataFrame, splits: DataFrame, which: str | None = None, key: str = "_row_id") -> DataFrame:
    """Rows of one split (or of all splits when ``which`` is None), as an equi-join on the row id.

    A split that is not in the table is an error. The table has a row per row, so it is merged at every
    size: its files are small for what they hold, and a broadcast of it would fill the driver.
    """
    if which is not None:
        chosen = splits.filter(F.col("split") == which)
        if chosen.isEmpty():
            there = sorted(r["split"] for r in splits.select("split").distinct().limit(20).collect() if r["split"])
            raise ValueError(f"no split {which!r}; the table has {there}")
        splits = chosen
    return df.join(splits.select(key, "split").hint("merge"), key)


def attach_targets(predictions: DataFrame, targets: DataFrame, key: str = "index") -> DataFrame:
    return predictions.join(targets.select(key, "target"), key, "left")


def align(corpus: DataFrame, outputs: DataFrame, key: str = "_row_id") -> DataFrame:
    return corpus.join(outputs, key)


def unaligned(corpus: DataFrame, outputs: DataFrame, key: str = "_row_id") -> DataFrame:
    """Row ids present on one side only; an empty result means the two tables match one to one."""
    left = corpus.select(key).join(outputs.select(key), key, "left_anti").withColumn("side", F.lit("corpus"))
    right = outputs.select(key).join(corpus.select(key), key, "left_anti").withColumn("side", F.lit("outputs"))
    return left.unionByName(right)


def pending(all_rows: DataFrame, done: DataFrame, key: str = "_row_id") -> DataFrame:
    return all_rows.join(done.select(key), key, "left_anti")


def minus(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.join(b.select(*keys), keys, "left_anti")


def _first_in(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key. The rank filter runs before the shuffle as well, so a task sends one row per key."""
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter("_rank = 1").select(*rows.columns)


def latest(rows: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Last version of every key; of equal versions, the one with the largest values."""
    rest = [c for c in rows.columns if c not in keys + by]
    return _first_in(rows, keys, [F.col(c).desc_nulls_last() for c in by + rest])


def overlay_latest(first: DataFrame, reruns: DataFrame, key: str = "_row_id", attempt: str = "attempt") -> DataFrame:
    """Rerun results replace first-pass results; the highest attempt wins."""
    return latest(first.unionByName(reruns), [key], [attempt])


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row of every key in the given order; rows without an order value come last.

    Text that holds a number is ordered as the number.
    """
    kinds = dict(df.dtypes)
    by = []
    for c in order:
        if kinds[c] == "string":
            by.append(F.col(c).try_cast("decimal(38,6)").asc_nulls_last())
        by.append(F.col(c).asc_nulls_last())
    return _first_in(df, keys, by)


def attach_block(rows: DataFrame, block: DataFrame) -> DataFrame:
    """Put the columns of a one-row table beside every row; more than one row is an error."""
    found = block.take(2)
    if len(found) != 1:
        raise ValueError("a shared block must have exactly one row")
    values = [F.lit(found[0][c]).cast(block.schema[c].dataType).alias(c) for c in block.columns]
    return rows.select("*", *values)


def running(by: list[str], order: list, value: str):
    """Window for sums of everything before the current row."""
    return F.coalesce(
        F.sum(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0),
    )
