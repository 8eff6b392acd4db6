"""Scores of predictions, computed from one small confusion table or one aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most labels for which a whole confusion grid is laid out.
GRID_LABELS = 1000

def eval_frame(corpus: DataFrame, to_target, parse, output: str = "output") -> DataFrame:
    """Add ``target``: the output mapped directly, else parsed first and then mapped."""
    return corpus.withColumn(
        "target", F.coalesce(to_target(F.col(output)), to_target(parse(F.col(output)).cast("string")))
    )


def valid_predictions(predictions: DataFrame, to_target, label: str = "label") -> DataFrame:
    """Rows with a label that maps to a value, as ``y_true, y_pred``."""
    mapped = predictions.withColumn("y_pred", F.when(F.col(label).isNotNull(), to_target(F.col(label))))
    return mapped.filter("y_pred is not null").withColumn("y_true", F.col("target"))


def missing_count(predictions: DataFrame, to_target, label: str = "label") -> DataFrame:
    mapped = F.when(F.col(label).isNotNull(), to_target(F.col(label)))
    return predictions.agg(F.count_if(mapped.isNull()).alias("missing_count"))


def label_distribution(predictions: DataFrame, label: str = "label") -> DataFrame:
    return predictions.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("cnt"))


def _counts(df: DataFrame) -> DataFrame:
    pairs = df.select(F.col("y_true").cast("bigint").alias("y_true"), F.col("y_pred").cast("bigint").alias("y_pred"))
    return pairs.groupBy("y_true", "y_pred").agg(F.count(F.lit(1)).alias("cnt"))


def confusion_counts(df: DataFrame) -> DataFrame:
    """``y_true, y_pred, cnt`` of the pairs that occur, for any number of labels."""
    return _counts(df)


def confusion(df: DataFrame, grid_labels: int = GRID_LABELS) -> DataFrame:
    """``y_true, y_pred, cnt`` over the whole label grid; up to two labels use the grid 0, 1.

    A grid has the square of its labels as cells, so there is none (no rows) for more than ``grid_labels``
    labels; :func:`confusion_counts` has the cells that are not zero for any number.
    """
    counts = _counts(df)
    labels = counts.select(F.explode(F.array("y_true", "y_pred")).alias("_v")).distinct().limit(grid_labels + 1)
    binary = F.array(F.lit(0).cast("bigint"), F.lit(1).cast("bigint"))
    small = (F.size("_l") <= 2) & F.forall("_l", lambda v: v.isin(0, 1))
    labels = labels.agg(F.collect_list("_v").alias("_l")).filter(F.size("_l") <= max(grid_labels, 2))
    labels = labels.select(F.when(small, binary).otherwise(F.col("_l")).alias("_l"))
    grid = labels.select(F.explode("_l").alias("y_true"), "_l").select("y_true", F.explode("_l").alias("y_pred"))
    return grid.join(counts, ["y_true", "y_pred"], "left").select("y_true", "y_pred", F.coalesce("cnt", F.lit(0)).alias("cnt"))


def _per_label(counts: DataFrame) -> DataFrame:
    sides = counts.select(
        F.explode(
            F.array(
                F.struct(F.col("y_true").alias("label"), F.col("cnt").alias("support"), F.lit(0).cast("bigint").alias("said")),
                F.struct(F.col("y_pred").alias("label"), F.lit(0).cast("bigint").alias("support"), F.col("cnt").alias("said")),
            )
        ).alias("_s"),
        F.when(F.col("y_true") == F.col("y_pred"), F.col("cnt")).otherwise(0).alias("_hit"),
    )
    per = sides.groupBy("_s.label").agg(
        F.sum("_s.support").alias("support"),
        F.sum("_s.said").alias("said"),
        F.sum(F.when(F.col("_s.support") > 0, F.col("_hit")).otherwise(0)).alias("hit"),
    )
    ratio = lambda a, b: F.when(F.col(b) == 0, 0.0).otherwise(F.col(a) / F.col(b))
    per = per.withColumn("precision", ratio("hit", "said")).withColumn("recall", ratio("hit", "support"))
    both = F.col("support") + F.col("said")
    return per.withColumn("f1", F.when(both == 0, 0.0).otherwise(2 * F.col("hit") / both))


def classification_metrics(df: DataFrame) -> DataFrame:
    """One row of scores. Binary precision, recall and F1 are NULL for more than two labels."""
    per = _per_label(_counts(df))
    k = F.count(F.lit(1))
    s, c = F.sum("support"), F.sum("hit")
    tp = F.sum((F.col("support") * F.col("said")).cast("double"))
    pp = F.sum((F.col("said") * F.col("said")).cast("double"))
    tt = F.sum((F.col("support") * F.col("support")).cast("double"))
    spread = F.sqrt((s.cast("double") * s - pp) * (s.cast("double") * s - tt))
    positive = lambda m: F.when(k <= 2, F.coalesce(F.max(F.when(F.col("label") == 1, F.col(m))), F.lit(0.0)))
    return per.agg(
        (c / s).alias("accuracy"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        positive("precision").alias("precision"),
        positive("recall").alias("recall"),
        positive("f1").alias("f1"),
        F.avg("precision").alias("precision_macro"),
        F.avg("recall").alias("recall_macro"),
        F.avg("f1").alias("f1_macro"),
        F.when(spread == 0, 0.0).otherwise((c.cast("double") * s - tp) / spread).alias("mcc"),
        s.alias("n"),
    ).select(*[F.when(F.col("n") > 0, F.col(x)).alias(x) for x in (
        "accuracy", "balanced_accuracy", "precision", "recall", "f1", "precision_macro", "recall_macro", "f1_macro", "mcc"
    )])


def classification_report(df: DataFrame) -> DataFrame:
    """Per label, then the macro and support-weighted averages: precision, recall, f1, support."""
    per = _per_label(_counts(df))
    rows = per.select(F.col("label").cast("string").alias("label"), "precision", "recall", "f1", "support")
    total = F.sum("support")
    macro = per.agg(
        F.lit("macro avg").alias("label"),
        *[F.avg(m).alias(m) for m in ("precision", "recall", "f1")],
        total.alias("support"),
    )
    weighted = per.agg(
        F.lit("weighted avg").alias("label"),
        *[(F.sum(F.col(m) * F.col("support")) / total).alias(m) for m in ("precision", "recall", "f1")],
        total.alias("support"),
    )
    return rows.unionByName(macro).unionByName(weighted)


def regression_metrics(df: DataFrame) -> DataFrame:
    """``rmse, mse, mae, r2`` in one aggregate; a constant target gives 1 when fitted exactly, else 0."""
    y, p = F.col("y_true").cast("double"), F.col("y_pred").cast("double")
    residual = F.sum((y - p) * (y - p))
    spread = F.var_pop(y) * F.count(y)
    r2 = F.when(spread == 0, F.when(residual == 0, 1.0).otherwise(0.0)).otherwise(1 - residual / spread)
    mse = F.avg((y - p) * (y - p))
    return df.agg(F.sqrt(mse).alias("rmse"), mse.alias("mse"), F.avg(F.abs(y - p)).alias("mae"), r2.alias("r2"))


def evaluate(
    predictions: DataFrame,
    to_target,
    regression: bool = False,
    label: str = "label",
    render_target=None,
    grid_labels: int = GRID_LABELS,
) -> DataFrame:
    """All scores of a prediction table with ``target``: valid rows only, plus ``missing_count``.

    Without any valid row every score is NULL. With ``render_target`` (label id to text) the labels of the
    confusion matrix are texts; an id that it cannot render stays as it is. With more than ``grid_labels``
    labels the matrix and its labels are NULL, all else is computed from sparse counts.
    """
    valid = valid_predictions(predictions, to_target, label)
    scores = regression_metrics(valid) if regression else classification_metrics(valid)
    missing = missing_count(predictions, to_target, label)
    if regression:
        scores = scores.select(*[F.when(F.col("mse").isNotNull(), F.col(c)).alias(c) for c in scores.columns])
        return scores.crossJoin(missing)
    cm = confusion(valid, grid_labels).groupBy("y_true").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("y_pred", "cnt"))), lambda e: e["cnt"]).alias("_row")
    )
    name = F.col("y_true") if render_target is None else F.coalesce(render_target(F.col("y_true")).cast("string"), F.col("y_true").cast("string"))
    ordered = F.sort_array(F.collect_list(F.struct("y_true", "_row", name.alias("_name"))))
    table = cm.agg(ordered.alias("_cells")).select(
        F.when(F.size("_cells") > 0, F.transform("_cells", lambda e: e["_row"])).alias("confusion_matrix"),
        F.when(F.size("_cells") > 0, F.transform("_cells", lambda e: e["_name"])).alias("confusion_matrix_labels"),
    )
    cell = lambda i, j: F.when(
        F.size("confusion_matrix") == 2, F.get(F.get("confusion_matrix", F.lit(i)), F.lit(j))
    )
    out = scores.crossJoin(table).crossJoin(missing)
    return out.withColumns({"tn": cell(0, 0), "fp": cell(0, 1), "fn": cell(1, 0), "tp": cell(1, 1)})
