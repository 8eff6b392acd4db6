"""Quality rules with risk-controlled thresholds, with DataFrame functions only.

Every rule is a score of a text and a ladder of cutoffs from lax to strict. Labelled documents that pass
the base rules are counted per stratum, rule and cutoff. A cutoff is certified when the exact binomial
bound (Clopper and Pearson) on its share of good documents rejected stays below the rule's part of the
allowed risk. The ladders are tested in fixed order up to the first failure, and the error probability
is divided by rules and strata (Bonferroni), so with probability ``1 - delta`` no stratum loses more than
``risk`` of its good documents. Of the certified cutoffs, the one that catches most bad documents beyond
the good ones it loses is used, if these are a hundredth of the bad ones at least.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.llm.common import SPACES, let, words
from corpusforge.session import materialize

SYMBOLS = "#*$%&|<>"
#: Least share of bad documents, net of good ones lost, for which a rule is applied.
LEAST_GAIN = 0.01
#: Rule -> score (larger is worse) over the base columns, cutoffs from lax to strict.
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbols": ("n_symbols / word_chars", (0.5, 0.3, 0.2, 0.15, 0.1, 0.08, 0.06, 0.04, 0.03, 0.02)),
    "repeats": ("n_repeat_words / n_words", (0.48, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2)),
    "lines": ("n_dup_lines / n_lines", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35)),
    "long_words": ("word_chars / n_words", (16.0, 14.0, 12.0, 11.0, 10.0, 9.0, 8.0, 7.5, 7.0)),
    "short_words": ("-word_chars / n_words", (-2.0, -2.5, -3.0, -3.25, -3.5, -3.75, -4.0, -4.25)),
}


def repeated_words(ws: Column, width: int = 3) -> Column:
    """Number of words inside a window of ``width`` words that occurs at least twice in the text.

    Windows are hashed, the place of a window replaces the low bits of its hash, and one sort brings equal
    windows together; the cost is n log n in the length of the text. As many low bits are given up as
    the number of places needs, no more.
    """

    def covered(places: Column) -> Column:
        start = F.struct(F.lit(-width).cast("long").alias("last"), F.lit(0).cast("long").alias("sum"))
        return F.aggregate(
            places,
            start,
            lambda acc, i: F.struct(
                i.alias("last"), (acc["sum"] + F.least(F.lit(width).cast("long"), i - acc["last"])).alias("sum")
            ),
            lambda acc: acc["sum"],
        )

    def from_sorted(s: Column, low: Column) -> Column:
        def same(a: Column, b: Column) -> Column:
            return F.coalesce(a.bitwiseXOR(b).bitwiseAND(-low) == 0, F.lit(False))

        repeated = F.filter(s, lambda x, k: same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1)))
        return covered(F.sort_array(F.transform(repeated, lambda x: x.bitwiseAND(low - 1))))

    def windows(low: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(ws) - width)
        marked = F.transform(
            places,
            lambda i: F.xxhash64(*[F.get(ws, i + j) for j in range(width)]).bitwiseAND(-low) + i.cast("long"),
        )
        return let(F.sort_array(marked), lambda s: from_sorted(s, low))

    low = F.pow(F.lit(2.0), F.ceil(F.log2(F.size(ws).cast("double")))).cast("long")
    return F.when(F.size(ws) > width, let(low, windows)).otherwise(F.lit(0)).cast("long")


def base_columns(text: Column) -> Column:
    """Struct of ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines`` of a text."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    counted = let(lines, lambda ls: F.struct(F.size(ls).alias("n"), F.size(F.array_distinct(ls)).alias("d")))
    return let(
        F.struct(words(text).alias("w"), counted.alias("l")),
        lambda x: F.struct(
            F.size(x["w"]).cast("long").alias("n_words"),
            F.char_length(F.array_join(x["w"], "")).cast("long").alias("word_chars"),
            (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            (x["l"]["n"] - x["l"]["d"]).cast("long").alias("n_dup_lines"),
            repeated_words(x["w"]).alias("n_repeat_words"),
            x["l"]["n"].cast("long").alias("n_lines"),
        ),
    )


def base_failed(min_words: int = 50, max_repeat_percent: int = 50) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


def score(rule: str) -> Column:
    """A rule's score; a text without words or lines scores as lax as can be."""
    top, bottom = RULES[rule][0].split(" / ")
    return F.coalesce(F.expr(top).cast("double") / F.nullif(F.expr(bottom), F.lit(0)), F.lit(float("-inf")))


def _log_gamma(x: Column) -> Column:
    """Stirling's series after a shift by 8; the error is below 1e-10."""
    z = x + 8.0
    shift = sum((F.log(x + float(j)) for j in range(1, 8)), F.log(x))
    series = 1 / (12 * z) - 1 / (360 * F.pow(z, 3)) + 1 / (1260 * F.pow(z, 5))
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - shift


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for k < n p, summed downwards from the largest term until terms vanish; 1 otherwise."""
    kd, nd = k.cast("double"), n.cast("double")
    largest = _log_gamma(nd + 1) - _log_gamma(kd + 1) - _log_gamma(nd - kd + 1) + kd * math.log(p) + (nd - kd) * math.log1p(-p)
    steps = F.least(k.cast("double"), 60 + 20 * F.sqrt(nd)).cast("int")
    one = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def add(acc: Column, j: Column) -> Column:
        term = acc["term"] * (kd - (j - 1)) * ((1 - p) / p) / (nd - kd + j)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    tail = F.when(steps > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(steps, F.lit(1))), one, add, lambda a: a["sum"])).otherwise(1.0)
    return F.when(kd < nd * p, F.exp(largest) * tail).otherwise(F.lit(1.0))


def certified_cutoffs(labelled: DataFrame, stratum: str, risk: float, delta: float) -> DataFrame:
    """``stratum, rule, cutoff, n_good, good_lost, n_bad, bad_caught, p_value, certified, chosen`` per cutoff.

    ``labelled`` holds the base columns, ``stratum`` and ``good``. Null is a stratum of its own.
    """
    good, bad = F.col("good"), ~F.col("good")
    sums = [
        F.struct(
            F.lit(rule).alias("rule"),
            F.lit(step).alias("step"),
            F.lit(cut).alias("cutoff"),
            F.count(F.when(good & (score(rule) > cut), 1)).alias("good_lost"),
            F.count(F.when(bad & (score(rule) > cut), 1)).alias("bad_caught"),
        )
        for rule, (_, cuts) in RULES.items()
        for step, cut in enumerate(cuts)
    ]
    counts = materialize(
        labelled.groupBy(stratum)
        .agg(F.count(F.when(good, 1)).alias("n_good"), F.count(F.when(bad, 1)).alias("n_bad"), F.array(*sums).alias("_c"))
        .select(stratum, "n_good", "n_bad", F.inline("_c"))
    )
    tests = max(1, counts.select(stratum).distinct().count()) * len(RULES)
    p_value = binomial_cdf(F.col("good_lost"), F.col("n_good"), risk / len(RULES))
    ladder = Window.partitionBy(stratum, "rule").orderBy("step")
    upto = ladder.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tested = counts.withColumn("p_value", p_value).withColumn(
        "certified", F.max((F.col("p_value") > delta / tests).cast("int")).over(upto) == 0
    )
    gain = (F.col("bad_caught") - F.col("good_lost")) / F.greatest(F.col("n_bad"), F.lit(1))
    gain = F.when(F.col("certified") & (gain >= LEAST_GAIN), gain)
    best = Window.partitionBy(stratum, "rule").orderBy(F.col("_gain").desc_nulls_last(), "step")
    return (
        tested.withColumn("_gain", gain)
        .withColumn("chosen", F.col("_gain").isNotNull() & (F.row_number().over(best) == 1))
        .drop("_gain", "step")
    )


def judge(
    docs: DataFrame,
    labels: DataFrame,
    risk: float = 0.05,
    delta: float = 0.1,
    key: str = "doc_id",
    text: str = "text",
    stratum: str = "lang",
    label: str = "quality",
    keep_row: bool = False,
) -> DataFrame:
    """``key``, the base columns, ``base_failed`` and ``kept`` for every row of ``docs``.

    With ``keep_row``, also ``row``: the input row as a struct, so its columns cannot clash with ours.

    All labelled documents are the holdout (a key with several labels has the lowest; null labels do not
    count). Where a stratum has too few labels to certify a cutoff, only the base rules reject. A null
    text has no words; rows with a null key have no label; repeated rows are judged alike; no rows give
    no rows.
    """
    row = [F.struct("*").alias("row")] if keep_row else []
    scored = materialize(
        docs.select(F.col(key).alias("_key"), F.col(stratum).cast("string").alias("_stratum"), base_columns(F.col(text)).alias("_b"), *row)
        .select("_key", "_stratum", "_b.*", *["row"] * keep_row)
        .withColumn("base_failed", base_failed())
    )
    marks = labels.filter(F.col(label).isNotNull()).groupBy(F.col(key).alias("_key")).agg((F.min(label) > 0).alias("good"))
    labelled = scored.filter(~F.col("base_failed")).join(marks, "_key")
    cutoffs = certified_cutoffs(labelled, "_stratum", risk, delta).filter("chosen")
    limits = cutoffs.groupBy("_stratum").agg(
        *[F.max(F.when(F.col("rule") == rule, F.col("cutoff"))).alias(f"_{rule}") for rule in RULES]
    )
    limits = materialize(limits)
    judged = scored.alias("d").join(limits.alias("c"), F.col("d._stratum").eqNullSafe(F.col("c._stratum")), "left")
    over = F.lit(False)
    for rule in RULES:
        over = over | F.coalesce(score(rule) > F.col(f"c._{rule}"), F.lit(False))
    return judged.select(
        F.col("d._key").alias(key),
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & ~over).alias("kept"),
        *["d.row"] * keep_row,
    )
