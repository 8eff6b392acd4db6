"""Table cleaning: missing values, label and code filters, recodes, rare categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusforge.functions.clinical import (
    DEATH_OR_HOSPICE_CODES,
    DEATH_OR_HOSPICE_WORDS,
    age_bin3,
    icd9_group,
)
from corpusforge.functions.numbers import trim_all
from corpusforge.operators.joins import first_per_key
from corpusforge.session import materialize

# Texts that mean "missing", and the share below which a category is rare.
UNKNOWN_MARK = "?"
MISSING = "missing"
RARE_SHARE = 0.035
READMISSION_LABELS = ("<30", ">30", "NO")


def category(col: Column) -> Column:
    """Category text with NULL and ``?`` read as ``missing``."""
    return F.coalesce(F.nullif(col.cast("string"), F.lit(UNKNOWN_MARK)), F.lit(MISSING))


def number(col: Column) -> Column:
    """Double with NaN read as NULL."""
    x = col.cast("double")
    return F.when(~F.isnan(x), x)


def normalize_missing(df: DataFrame, cat_cols, num_cols) -> DataFrame:
    return df.withColumns(
        {c: category(F.col(c)) for c in cat_cols} | {c: number(F.col(c)) for c in num_cols}
    )


def features_frame(df: DataFrame, key: str, cat_cols, num_cols) -> DataFrame:
    """Numeric features as float, categorical ones as text with NULL as ``missing``."""
    return df.select(
        key,
        *[F.col(c).cast("float").alias(c) for c in num_cols],
        *[F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias(c) for c in cat_cols],
    )


def keep_labels(df: DataFrame, col: str, allowed=READMISSION_LABELS) -> DataFrame:
    label = F.upper(trim_all(F.col(col).cast("string")))
    return df.withColumn(col, label).filter(F.col(col).isin(*allowed))


def exclude_codes(df: DataFrame, col: str, codes=DEATH_OR_HOSPICE_CODES) -> DataFrame:
    """Drop listed codes; rows without a code, or with one that is not a number, stay."""
    return df.filter(~F.coalesce(code_number(F.col(col)).isin(*codes), F.lit(False)))


def code_number(col: Column) -> Column:
    """A code as a whole number; ``11.0`` is 11, and text that is no number is NULL."""
    return F.coalesce(col.cast("string").try_cast("bigint"), col.cast("string").try_cast("double").try_cast("bigint"))


def codes_by_keyword(dim: DataFrame, code: str, description: str, words=DEATH_OR_HOSPICE_WORDS) -> DataFrame:
    text = F.lower(F.col(description))
    hit = F.lit(False)
    for word in words:
        hit = hit | text.contains(word)
    return dim.filter(hit & F.col(code).isNotNull()).select(code_number(F.col(code)).alias(code)).filter(F.col(code).isNotNull()).distinct()


def exclude_by_keyword(
    df: DataFrame, col: str, dim: DataFrame, code: str, description: str, words=DEATH_OR_HOSPICE_WORDS
) -> DataFrame:
    """Drop rows whose code the dimension describes by one of the keywords.

    Without any such code the default list applies.
    """
    codes = codes_by_keyword(dim, code, description, words)
    if codes.isEmpty():
        return exclude_codes(df, col)
    bad = codes.select(F.col(code).alias("_bad"))
    return df.join(bad, code_number(df[col]) == F.col("_bad"), "left_anti")


def drop_if_present(df: DataFrame, cols) -> DataFrame:
    return df.drop(*cols)


def fill_missing(df: DataFrame, col: str, fill: str = MISSING) -> DataFrame:
    return df.withColumn(col, F.coalesce(F.nullif(F.col(col), F.lit(UNKNOWN_MARK)), F.lit(fill)))


def threshold_label(df: DataFrame, col: str, threshold: float, name: str = "label") -> DataFrame:
    return df.withColumn(name, (F.col(col) > threshold).cast("int"))


def merge_rare(df: DataFrame, cols, share: float = RARE_SHARE, other: str = "Other") -> DataFrame:
    """Categories with a share strictly below the threshold become ``other``.

    Shares count non-missing values. Frequent categories number at most 1/share per column, so they
    fit a literal list whatever the data size; rare ones are simply not in it.
    """
    if share <= 0:
        return df
    long = df.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("value")) for c in cols])
        ).alias("_e")
    ).select("_e.*")
    counts = materialize(long.filter("value is not null").groupBy("col", "value").agg(F.count(F.lit(1)).alias("cnt")))
    totals = counts.groupBy("col").agg(F.sum("cnt").alias("total"))
    kept = counts.join(totals, "col").filter(F.col("cnt") / F.col("total") >= share)
    frequent: dict[str, list[str]] = {}
    for row in kept.select("col", "value").collect():
        frequent.setdefault(row["col"], []).append(row["value"])
    return df.withColumns(
        {
            c: F.when(F.col(c).isNull() | F.col(c).isin(*frequent.get(c, []), other), F.col(c)).otherwise(other)
            for c in cols
        }
    )


def clean_encounters(df: DataFrame, codes=DEATH_OR_HOSPICE_CODES, drop_gender: bool = False) -> DataFrame:
    """Hospital encounters to the three-class modelling table; every step is skipped when its columns are absent."""
    have = set(df.columns)
    df = keep_labels(df, "readmitted")
    if "discharge_disposition_id" in have:
        df = exclude_codes(df, "discharge_disposition_id", codes)
    if {"patient_nbr", "encounter_id"} <= have:
        df = first_per_key(df, ["patient_nbr"], ["encounter_id"])
    df = drop_if_present(df, ["weight", "payer_code", *(["gender"] if drop_gender else [])])
    if "medical_specialty" in have:
        df = fill_missing(df, "medical_specialty")
    diagnoses = [c for c in ("diag_1", "diag_2", "diag_3") if c in have]
    if diagnoses:
        df = merge_rare(df.withColumns({c: icd9_group(F.col(c)) for c in diagnoses}), diagnoses)
    if "age" in have:
        df = df.withColumn("age", age_bin3(F.col("age")))
    return drop_if_present(df, ["encounter_id", "patient_nbr"])


def first_encounter(df: DataFrame, key: str = "patient_nbr", order: str = "_row_id") -> DataFrame:
    """First row of every patient in file order, identifiers dropped."""
    return drop_if_present(first_per_key(df, [key], [order]), [key, "encounter_id"])


def step_report(steps: dict[str, DataFrame]) -> DataFrame:
    """Row counts of named cleaning steps, in the order given."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(i).alias("step"), F.lit(name).alias("name"), "rows")
        for i, (name, df) in enumerate(steps.items())
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def dedupe_report(before: DataFrame, after: DataFrame, key: str, label: str) -> DataFrame:
    """Rows and distinct keys before and after, then label counts after, in long form."""

    def sizes(df, stage):
        one = df.agg(F.count(F.lit(1)).alias("r"), F.count_distinct(key).alias("k"))
        return one.select(
            F.explode(
                F.array(
                    F.struct(F.lit(f"{stage}_rows").alias("measure"), F.col("r").alias("value")),
                    F.struct(F.lit(f"{stage}_keys").alias("measure"), F.col("k").alias("value")),
                )
            ).alias("_m")
        ).select("_m.*")

    labels = after.groupBy(F.concat(F.lit("label_"), F.col(label).cast("string")).alias("measure")).agg(
        F.count(F.lit(1)).alias("value")
    )
    return sizes(before, "before").unionByName(sizes(after, "after")).unionByName(labels)
