"""Training-set statistics as long tables: overall, per class, per target-quartile bin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.functions.numbers import bin_index
from corpusforge.operators.cleaning import category, number
from corpusforge.operators.quantiles import bracket_columns, refine, table_quantiles
from corpusforge.operators.ranking import running_in_ranges
from corpusforge.session import materialize
from corpusforge.spec import STAT_VARIANTS, TableSpec

QUARTILES = [0.25, 0.5, 0.75]
BIN_PERCENTS = [0.0, 25.0, 50.0, 75.0, 100.0]


def numeric_long(df: DataFrame, by: list[str], cols) -> DataFrame:
    """``by..., col, x``: one row per row and numeric column."""
    pairs = [F.struct(F.lit(c).alias("col"), number(F.col(c)).alias("x")) for c in cols]
    return df.select(*by, F.explode(F.array(*pairs)).alias("_p")).select(*by, "_p.col", "_p.x")


def category_long(df: DataFrame, by: list[str], cols, key: str = "_row_id") -> DataFrame:
    """``by..., key, col, value, missing``: one row per row and categorical column."""
    pairs = [
        F.struct(
            F.lit(c).alias("col"),
            category(F.col(c)).alias("value"),
            (F.col(c).isNull() | (F.col(c).cast("string") == "?")).alias("missing"),
        )
        for c in cols
    ]
    return df.select(*by, key, F.explode(F.array(*pairs)).alias("_p")).select(*by, key, "_p.*")


def num_stats(df: DataFrame, cols, by: list[str] = (), variant: str = "full") -> DataFrame:
    """``by..., col, n, n_missing`` and the variant's statistics over non-null values.

    Columns without any value are left out. Quartiles are exact; a variant without quartiles skips
    their passes altogether.
    """
    by, shown = list(by), STAT_VARIANTS[variant]
    long = numeric_long(df, by, cols)
    build: dict[str, Column] = {
        "mean": F.avg("x"),
        "std": F.stddev_samp("x"),
        "min": F.min("x"),
        "max": F.max("x"),
    }
    aggs = [F.count("x").alias("n"), F.count_if(F.col("x").isNull()).alias("n_missing")]
    aggs += [build[s].alias(s) for s in build if s in shown]
    wants_quartiles = "p25" in shown
    if wants_quartiles:
        aggs += bracket_columns("x", QUARTILES)
    base = long.groupBy(*by, "col").agg(*aggs).filter("n > 0")
    if not wants_quartiles:
        return base.select(*by, "col", "n", "n_missing", *shown)
    base = materialize(base)
    quart = refine(long, base, [*by, "col"], "x", QUARTILES)
    named = quart.select(*by, "col", *[F.col(f"q{i}").alias(p) for i, p in enumerate(("p25", "p50", "p75"))])
    return base.join(named, [*by, "col"]).select(*by, "col", "n", "n_missing", *shown)


def cat_counts(df: DataFrame, cols, by: list[str] = (), key: str = "_row_id") -> DataFrame:
    """``by..., col, value, cnt, first_row, n_missing`` for every value."""
    by = list(by)
    return category_long(df, by, cols, key).groupBy(*by, "col", "value").agg(
        F.count(F.lit(1)).alias("cnt"),
        F.min(key).alias("first_row"),
        F.count_if("missing").alias("n_missing"),
    )


def cat_stats(df: DataFrame, cols, top_k: int | None = 5, by: list[str] = (), key: str = "_row_id") -> DataFrame:
    """Top values per column with count, share, rank, and the column's unique and missing counts.

    Shares divide by all rows of the group. Counting comes first, once, so a frequent value is one row
    before anything is ranked. A rank limit is applied before the ranking shuffle; without one, ranks
    come from counted ranges of the order, because a column may have any number of values.
    """
    by = list(by)
    return ranked_counts(materialize(cat_counts(df, cols, by, key)), top_k, by)


def ranked_counts(counts: DataFrame, top_k: int | None, by: list[str]) -> DataFrame:
    """:func:`cat_stats` from stored counts."""
    totals = counts.groupBy(*by, "col").agg(
        F.sum("cnt").alias("total"), F.count(F.lit(1)).alias("n_unique"), F.sum("n_missing").alias("n_missing")
    )
    order, rows = [F.col("cnt").desc(), F.col("first_row"), F.col("value")], counts.drop("n_missing")
    if top_k is None:
        ranked = running_in_ranges(rows, [*by, "col"], order, F.lit(1).cast("bigint"), "rnk")
    else:
        rank = F.row_number().over(Window.partitionBy(*by, "col").orderBy(*order)).cast("bigint")
        ranked = rows.withColumn("rnk", rank).filter(F.col("rnk") <= top_k)
    return ranked.join(totals, [*by, "col"]).select(
        *by, "col", "value", "cnt", "total", (F.col("cnt") / F.col("total")).alias("prop"), "rnk", "n_unique", "n_missing"
    )


def target_dist(df: DataFrame, target: str, key: str = "_row_id", regression: bool = False) -> DataFrame:
    """``label, cnt, prop, first_row``; empty for regression."""
    counts = df.groupBy(F.col(target).cast("string").alias("label")).agg(
        F.count(F.lit(1)).alias("cnt"), F.min(key).alias("first_row")
    )
    total = F.sum("cnt").over(Window.partitionBy())
    out = counts.select("label", "cnt", (F.col("cnt") / total).alias("prop"), "first_row")
    return out.filter(F.lit(False)) if regression else out.filter("label is not null")


def n_classes(df: DataFrame, target: str) -> DataFrame:
    """Distinct target values, NULL counted as one."""
    seen_null = F.coalesce(F.max(F.col(target).isNull().cast("int")), F.lit(0))
    return df.agg((F.count_distinct(target) + seen_null).cast("bigint").alias("n_classes"))


def class_num_stats(df: DataFrame, spec: TableSpec, variant: str = "full") -> DataFrame:
    return num_stats(_by_label(df, spec), spec.num_cols, ["label"], variant)


def class_cat_stats(df: DataFrame, spec: TableSpec, top_k: int | None = 5, key: str = "_row_id") -> DataFrame:
    return cat_stats(_by_label(df, spec), spec.cat_cols, top_k, ["label"], key)


def _by_label(df: DataFrame, spec: TableSpec) -> DataFrame:
    return df.withColumn("label", F.col(spec.target).cast("string")).filter("label is not null")


def bin_edges(df: DataFrame, target: str) -> tuple[list[float], list[float]]:
    """The five percentile values of the target and their distinct edges (at least four)."""
    raw = table_quantiles(df, target, [p / 100 for p in BIN_PERCENTS])
    edges = sorted(set(raw))
    if len(edges) < 4:
        raise ValueError(f"quartile bins need at least four distinct edges, found {len(edges)}")
    return raw, edges


def target_bins(df: DataFrame, target: str) -> DataFrame:
    """``bin, lo, hi, pct_lo, pct_hi, cnt, prop`` per quartile bin, bins counted from 1."""
    raw, edges = bin_edges(df, target)

    def percent(edge):
        return max(p for p, v in zip(BIN_PERCENTS, raw) if abs(v - edge) <= 1e-8 + 1e-5 * abs(edge))

    ranges = F.array(
        *[
            F.struct(
                F.lit(lo).alias("lo"),
                F.lit(hi).alias("hi"),
                F.lit(percent(lo)).alias("pct_lo"),
                F.lit(percent(hi)).alias("pct_hi"),
            )
            for lo, hi in zip(edges, edges[1:])
        ]
    )
    counted = with_bins(df, target, edges).groupBy("bin").agg(F.count(F.lit(1)).alias("cnt"))
    total = F.sum("cnt").over(Window.partitionBy())
    return (
        counted.withColumn("prop", F.col("cnt") / total)
        .filter("bin is not null")
        .withColumn("_r", F.element_at(ranges, F.col("bin").cast("int")))
        .select("bin", "_r.*", "cnt", "prop")
    )


def with_bins(df: DataFrame, target: str, edges: list[float]) -> DataFrame:
    return df.withColumn("bin", (bin_index(F.col(target).cast("double"), edges) + 1).cast("bigint"))


def bin_num_stats(df: DataFrame, spec: TableSpec, variant: str = "full") -> DataFrame:
    _, edges = bin_edges(df, spec.target)
    return num_stats(with_bins(df, spec.target, edges).filter("bin is not null"), spec.num_cols, ["bin"], variant)


def bin_cat_stats(df: DataFrame, spec: TableSpec, top_k: int | None = 5, key: str = "_row_id") -> DataFrame:
    _, edges = bin_edges(df, spec.target)
    return cat_stats(with_bins(df, spec.target, edges).filter("bin is not null"), spec.cat_cols, top_k, ["bin"], key)


def inline_num(df: DataFrame, spec: TableSpec, variant: str = "full") -> DataFrame:
    """Per-class numeric statistics on the full class x column grid; classes without values give NULLs."""
    labeled = _by_label(df, spec)
    labels = labeled.select("label").distinct()
    grid = labels.select("label", F.explode(F.array(*[F.lit(c) for c in spec.num_cols])).alias("col"))
    return grid.join(num_stats(labeled, spec.num_cols, ["label"], variant), ["label", "col"], "left")


def inline_cat_rates(df: DataFrame, spec: TableSpec, key: str = "_row_id") -> DataFrame:
    """``col, value, label, rate`` for every value seen in any class; absent combinations are 0."""
    labeled = _by_label(df, spec)
    counts = cat_counts(labeled, spec.cat_cols, ["label"], key)
    totals = counts.groupBy("label", "col").agg(F.sum("cnt").alias("total"))
    seen = counts.groupBy("col", "value").agg(
        F.map_from_entries(F.collect_list(F.struct("label", "cnt"))).alias("_by_label")
    )
    return seen.join(totals, "col").select(
        "col",
        "value",
        "label",
        F.coalesce(F.try_element_at("_by_label", F.col("label")) / F.col("total"), F.lit(0.0)).alias("rate"),
    )


def regression_cat_rates(df: DataFrame, spec: TableSpec, key: str = "_row_id") -> DataFrame:
    """Value shares over the whole table, by descending share."""
    return cat_stats(df, spec.cat_cols, None, [], key).select("col", "value", F.col("prop").alias("rate"), "rnk")


def sample_freq(df: DataFrame, stats: DataFrame, cat_cols, key: str = "_row_id") -> DataFrame:
    """How common each row's own category is: ``key, col, value, prop`` with 0 for unseen values.

    ``stats`` has ``col, value, prop``. Each column is looked up on its own value, so rows are never
    regrouped; Spark broadcasts the lookup when it is small and splits skewed values otherwise.
    """
    from corpusforge.operators.joins import lookup_join

    long = category_long(df, [], cat_cols, key).select(key, "col", "value")
    hit = stats.select("col", "value", "prop")
    return lookup_join(long, hit, ["col", "value"]).select(
        key, "col", "value", F.coalesce("prop", F.lit(0.0)).alias("prop")
    )


def stats_document(num: DataFrame, cat: DataFrame, dist: DataFrame) -> DataFrame:
    """Overall statistics as one nested row; only statistics rows are gathered, never data rows."""
    shown = [c for c in num.columns if c != "col"]
    n = num.agg(F.map_from_entries(F.collect_list(F.struct("col", F.struct(*shown)))).alias("num_stats"))
    per_col = cat.groupBy("col").agg(
        F.sort_array(F.collect_list(F.struct("rnk", "value", "cnt", "prop"))).alias("_v"),
        F.max("n_unique").alias("n_unique"),
        F.max("n_missing").alias("n_missing"),
    )
    c = per_col.agg(
        F.map_from_entries(
            F.collect_list(
                F.struct(
                    "col",
                    F.struct(
                        F.col("_v.value").alias("top_values"),
                        F.col("_v.cnt").alias("top_counts"),
                        F.col("_v.prop").alias("top_proportions"),
                        "n_unique",
                        "n_missing",
                    ),
                )
            )
        ).alias("cat_stats")
    )
    d = dist.agg(
        F.map_from_entries(F.collect_list(F.struct("label", "cnt"))).alias("target_dist"),
        F.map_from_entries(F.collect_list(F.struct("label", "prop"))).alias("target_proportions"),
        F.sum("cnt").alias("n_train"),
    )
    return n.crossJoin(c).crossJoin(d)


def split_report(df: DataFrame, splits: DataFrame, label: str, key: str = "_row_id") -> DataFrame:
    """Rows and shares per split and per (split, label)."""
    joined = df.select(key, F.col(label).cast("string").alias("label")).join(splits, key)
    counts = joined.groupBy("split", "label").agg(F.count(F.lit(1)).alias("_n"))
    rolled = counts.rollup("split", "label").agg(F.sum("_n").alias("cnt"), F.grouping_id().alias("_g"))
    total = F.max(F.when(F.col("_g") == 3, F.col("cnt"))).over(Window.partitionBy())
    in_split = F.max(F.when(F.col("_g") == 1, F.col("cnt"))).over(Window.partitionBy("split"))
    share = F.when(F.col("_g") == 0, F.col("cnt") / in_split).otherwise(F.col("cnt") / total)
    return rolled.select("split", "label", "cnt", share.alias("share"), "_g").filter("_g < 3").drop("_g")


def split_target_report(df: DataFrame, splits: DataFrame, target: str, key: str = "_row_id") -> DataFrame:
    """Smallest, largest, mean and median target per split."""
    joined = df.select(key, F.col(target).alias("_t")).join(splits, key).withColumn("_all", F.lit("target"))
    stats = num_stats(joined, ["_t"], ["split"])
    return stats.select("split", "n", "min", "max", "mean", F.col("p50").alias("median"))


def infer_task(df: DataFrame, target: str) -> DataFrame:
    """One row naming the task implied by the target values.

    Non-numeric targets, and numeric ones with at most 20 distinct whole values, are classification.
    """
    numeric = dict(df.dtypes)[target] not in ("string", "boolean")
    if not numeric:
        return df.agg(F.lit("classification").alias("task"))
    x = F.col(target).cast("double")
    distinct = df.select(x.alias("_x")).filter("_x is not null").groupBy("_x").count().limit(21)
    near = F.abs(F.col("_x") - F.bround("_x", 0)) <= 1e-8 + 1e-5 * F.abs(F.bround("_x", 0))
    few_whole = (F.count(F.lit(1)) <= 20) & F.coalesce(F.bool_and(near), F.lit(True))
    return distinct.agg(F.when(few_whole, "classification").otherwise("regression").alias("task"))
