"""Exact seeded sampling: stratified splits and limits, 3:1 undersampling, shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.functions.numbers import bin_index, coerce_01
from corpusforge.operators.quantiles import table_quantiles
from corpusforge.session import materialize
from corpusforge.operators.ranking import dense_positions, hash_cuts, hash_ranked, seeded_hash

# 8:1:1 splits, ten target strata for regression, three negatives to one positive.
SPLIT_SEED = 42
DECILES = 10


def largest_remainder(counts: DataFrame, label: str, cnt: str, n: Column, name: str) -> DataFrame:
    """Share ``n`` over labels in proportion to ``cnt``; leftovers go to the largest remainders.

    Integer arithmetic throughout, ties by label. ``counts`` has one row per label.
    """
    everything = Window.partitionBy()
    total = F.sum(cnt).over(everything)
    big = F.col(cnt).cast("decimal(19,0)") * n.cast("decimal(19,0)")
    rest = big % total.cast("decimal(19,0)")
    base = ((big - rest) / total.cast("decimal(19,0)")).cast("bigint")
    framed = counts.withColumn("_base", base).withColumn("_rest", rest).withColumn("_n", n.cast("bigint"))
    order = Window.partitionBy().orderBy(F.col("_rest").desc(), F.col(label).asc())
    left = F.col("_n") - F.sum("_base").over(everything)
    extra = (F.row_number().over(order) <= left).cast("bigint")
    return framed.withColumn(name, F.col("_base") + extra).drop("_base", "_rest", "_n")


def quantile_bins(df: DataFrame, col: str, q: int = DECILES, name: str = "stratum") -> DataFrame:
    """Right-closed quantile bins, repeated edges dropped, counted from 0."""
    edges = sorted(set(table_quantiles(df, col, [i / q for i in range(q + 1)])))
    return df.withColumn(name, bin_index(F.col(col).cast("double"), edges))


def split_quotas(df: DataFrame, strata: str) -> DataFrame:
    """Rows per stratum for test and valid: ceil(n/10), then a ninth of what is left, rounded up."""
    counts = df.groupBy(strata).agg(F.count(F.lit(1)).alias("cnt"))
    everything = Window.partitionBy()
    n = F.sum("cnt").over(everything)
    counts = counts.withColumn("_test", F.floor((n + 9) / 10).cast("bigint"))
    counts = largest_remainder(counts, strata, "cnt", F.col("_test"), "n_test")
    counts = counts.withColumn("_left", F.col("cnt") - F.col("n_test"))
    left = F.sum("_left").over(everything)
    counts = counts.withColumn("_valid", F.floor((left + 8) / 9).cast("bigint"))
    counts = largest_remainder(counts, strata, "_left", F.col("_valid"), "n_valid")
    return counts.select(strata, "cnt", "n_test", "n_valid")


def stratified_split(df: DataFrame, strata: str, seed: int = SPLIT_SEED, key: str = "_row_id") -> DataFrame:
    """``key, split`` with exact per-stratum quotas.

    Two scans: one counts hash buckets and finds the two cut rows per stratum, the other compares
    every row's hash with its stratum's cuts. No row is shuffled except one bucket per cut.
    """
    rows = df.select(key, strata)
    quotas = materialize(split_quotas(rows, strata))
    stacked = quotas.select(
        strata,
        F.explode(
            F.array(
                F.struct(F.lit("test").alias("cut"), F.col("n_test").alias("k")),
                F.struct(F.lit("valid").alias("cut"), (F.col("n_test") + F.col("n_valid")).alias("k")),
            )
        ).alias("_q"),
    ).select(strata, "_q.*")
    cuts = hash_cuts(rows, [strata], stacked, seed, "split", key)
    wide = materialize(
        cuts.groupBy(strata).agg(
            *[F.max(F.when(F.col("cut") == c, F.struct("_h", "_k"))).alias(f"_{c}") for c in ("test", "valid")]
        )
    )
    here = F.struct(F.col("_h"), F.col(key).alias("_k"))
    marked = rows.alias("r").join(
        wide.alias("w"), F.col(f"r.{strata}").eqNullSafe(F.col(f"w.{strata}")), "left"
    )
    marked = marked.select(f"r.{key}", "w._test", "w._valid").withColumn("_h", seeded_hash(seed, "split", key))
    split = F.when(here <= F.col("_test"), "test").when(here <= F.col("_valid"), "valid").otherwise("train")
    return marked.select(key, split.alias("split"))


def stratified_limit(df: DataFrame, label: str, n: int, seed: int = SPLIT_SEED, key: str = "_row_id") -> DataFrame:
    """Exactly ``min(n, rows)`` rows in label proportion, with a seeded output position ``pos``."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("cnt"))
    total = F.sum("cnt").over(Window.partitionBy())
    quotas = largest_remainder(counts, label, "cnt", F.least(F.lit(n), total), "_quota")
    quotas = quotas.select(label, F.least("_quota", "cnt").alias("k"), F.lit("keep").alias("cut"))
    cuts = materialize(hash_cuts(df.select(key, label), [label], materialize(quotas), seed, "limit", key))
    marked = df.alias("r").join(
        cuts.alias("c"), F.col(f"r.{label}").eqNullSafe(F.col(f"c.{label}"))
    )
    h = seeded_hash(seed, "limit", f"r.{key}")
    kept = marked.filter(F.struct(h.alias("_h"), F.col(f"r.{key}").alias("_k")) <= F.struct("c._h", "c._k"))
    return shuffled(kept.select("r.*"), seed, key)


def shuffled(df: DataFrame, seed: int = SPLIT_SEED, key: str = "_row_id") -> DataFrame:
    """Seeded shuffle: a 0-based ``pos`` for every row."""
    ranked = hash_ranked(df, [], seed, "shuffle", key, "pos")
    return ranked.withColumn("pos", F.col("pos") - 1)


def resolve_binary(df: DataFrame, label: str) -> DataFrame:
    """One row: negative and positive label, and whether the majority rule had to decide."""
    counts = df.groupBy(label).agg(
        F.count(F.lit(1)).alias("cnt"), F.min("_row_id").alias("first_row")
    ).withColumn("code", coerce_01(F.col(label)))
    found = counts.limit(3).collect()
    if len(found) != 2:
        raise ValueError(f"two labels are needed for undersampling, found {len(found)} or more")
    text = F.col(label).cast("string")
    explicit = F.count_distinct("code") == 2
    rank = F.struct(F.col("cnt"), -F.col("first_row"))
    return counts.agg(
        F.when(explicit, F.max(F.when(F.col("code") == 0, text))).otherwise(F.max_by(text, rank)).alias("negative"),
        F.when(explicit, F.max(F.when(F.col("code") == 1, text))).otherwise(F.min_by(text, rank)).alias("positive"),
        (~explicit).alias("by_majority"),
    )


def undersample_3to1(df: DataFrame, label: str, n: int, seed: int = SPLIT_SEED, key: str = "_row_id") -> DataFrame:
    """Three negatives then one positive, over and over, until ``n`` rows or a class runs out.

    How many of each are taken is known from the class sizes, so rows are cut before they are ranked.
    """
    chosen = resolve_binary(df, label).first()
    text = F.col(label).cast("string")
    sized = df.agg(
        F.count_if(text == chosen["negative"]).alias("neg"), F.count_if(text == chosen["positive"]).alias("pos")
    ).first()
    end_of_negatives = 4 * (sized["neg"] // 3) + sized["neg"] % 3
    stop = min(n, end_of_negatives, 4 * sized["pos"] + 3)
    positives = max(0, -(-(stop - 3) // 4))  # positions 3, 7, 11, ... below the end
    quotas = df.sparkSession.createDataFrame(
        [(chosen["negative"], "keep", stop - positives), (chosen["positive"], "keep", positives)],
        "_label string, cut string, k long",
    )
    rows = df.filter(text.isin(chosen["negative"], chosen["positive"])).withColumn("_label", text)
    cuts = materialize(hash_cuts(rows.select(key, "_label"), ["_label"], quotas, seed, "under", key))
    h = seeded_hash(seed, "under", f"r.{key}")
    inside = F.struct(h.alias("_h"), F.col(f"r.{key}").alias("_k")) <= F.struct("c._h", "c._k")
    kept = rows.alias("r").join(cuts.alias("c"), "_label").filter(inside).select("r.*").drop("_label")
    ranked = hash_ranked(kept, [label], seed, "under", key)
    j = F.col("_rank") - 1
    position = F.when(text == chosen["positive"], 4 * j + 3).otherwise(4 * F.floor(j / 3) + j % 3)
    return ranked.withColumn("pos", position.cast("bigint")).drop("_rank")


def limit_rows(df: DataFrame, n: int, key: str = "_row_id") -> DataFrame:
    """First ``n`` rows in key order."""
    return df.orderBy(key).limit(n)


def slice_corpus(df: DataFrame, start: int = 0, end: int = -1, n: int | None = None, test: bool = False, key: str = "_row_id") -> DataFrame:
    """Rows at positions ``[start, end)`` in key order; an empty slice is an error."""
    total = df.count()
    start = max(0, start)
    end = total if end == -1 else min(total, end)
    if n is not None:
        if n <= 0:
            raise ValueError("the number of samples must be positive")
        end = min(end, start + n)
    if test:
        start, end = 0, min(total, 10)
    if start >= end:
        raise ValueError(f"empty slice [{start}:{end}) of {total} rows")
    return dense_positions(df, key).filter((F.col("pos") >= start) & (F.col("pos") < end))
