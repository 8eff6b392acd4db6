"""Mixing sources to target weights: capped water-filling and seeded whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.llm.common import even_pieces, numbered, words
from corpusforge.session import materialize


def water_fill(sources: DataFrame, total: float) -> float:
    """Level at which ``sum(least(cap, level * weight))`` is ``total``.

    Sources above their cap are clamped and the excess goes to the others by weight, until no source is
    above. Each round is one aggregation over the sources; the driver sees two sums and a count.
    """
    level, clamped = 0.0, -1
    while True:
        held = F.col("cap") <= F.lit(level) * F.col("weight")
        row = sources.agg(
            F.coalesce(F.sum(F.when(held, F.col("cap"))), F.lit(0.0)).alias("fixed"),
            F.coalesce(F.sum(F.when(~held, F.col("weight"))), F.lit(0.0)).alias("open"),
            F.count(F.when(held, 1)).alias("n"),
        ).first()
        if row["n"] == clamped or not row["open"]:
            return level
        clamped, level = row["n"], max(level, (total - row["fixed"]) / row["open"])


def source_targets(
    sized: DataFrame, weights: tuple[float, ...], max_epochs: float, share: float
) -> DataFrame:
    """``source, source_size, target``: sources in code point order, null last, take the weights in turn."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = numbered(sources, [F.col("source").isNull(), F.col("source")], "_place", 50_000)
    turn = F.pmod(F.col("_place"), F.lit(len(weights))).cast("int")
    weighted = materialize(
        placed.select(
            "source",
            "source_size",
            F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1).alias("weight"),
            (F.col("source_size") * F.lit(float(max_epochs))).alias("cap"),
        )
    )
    total = weighted.agg(F.sum("source_size").alias("t")).first()["t"] or 0
    level = water_fill(weighted, share * total)
    return weighted.select(
        "source", "source_size", F.least(F.col("cap"), F.lit(level) * F.col("weight")).alias("target")
    )


def _same_source(a: str, b: str) -> Column:
    return F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))


def _extra_rows(classes: DataFrame, wanted: DataFrame, closing_rounds: int) -> DataFrame:
    """``_row, more``: how many rows of a class get one repetition more, so that a source's sum comes near ``rest``.

    Of a source's classes in seeded order, those that fit are taken, then the one at the cut, for which
    the others make room: so a document that is much of its source does not spoil the sum. Sums run over
    counted pieces of the order, and rows are ordered inside a piece only. Then, a few times over, rows of
    one class whose size comes nearest to what is missing are added, as many of them as that takes.
    """
    pieces = even_pieces(classes.count())
    dealt = classes.alias("d").join(wanted.alias("w"), _same_source("d", "w")).filter("size > 0 and size <= rest")
    dealt = dealt.select("d.*", "w.rest").withColumn("_piece", F.pmod(F.shiftright("_h", 20), F.lit(pieces)))
    sums = dealt.groupBy("source", "_piece").agg(F.sum("size").alias("_sum"))
    earlier = Window.partitionBy("source").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
    inside = F.sum("size").over(Window.partitionBy("source", "_piece").orderBy("_h", "_row"))
    summed = (
        dealt.alias("d")
        .join(sums.alias("s"), _same_source("d", "s") & (F.col("d._piece") == F.col("s._piece")))
        .select("d.source", "d.size", "d.rows", "d._row", "d._h", "d._piece", "d.rest", "s._before")
        .withColumn("_upto", F.col("_before") + inside)
        .select("source", "size", "rows", "_row", "rest", "_upto")
    )
    summed = materialize(summed)
    crossing = (F.col("_upto") > F.col("rest")) & (F.col("_upto") - F.col("size") < F.col("rest"))
    at_cut = materialize(summed.filter(crossing).select("source", "size", "_row", F.col("rows").alias("more")))
    room = summed.alias("s").join(at_cut.alias("c"), _same_source("s", "c"), "left")
    fits = F.col("s._upto") <= F.col("s.rest") - F.coalesce(F.col("c.size"), F.lit(0))
    fitting = room.filter(fits).select("s.source", "s.size", "s._row", F.col("s.rows").alias("more"))
    taken = materialize(fitting.unionByName(at_cut))
    for _ in range(closing_rounds):
        have = taken.groupBy("source").agg(F.sum("size").alias("have"))
        missing = (
            wanted.alias("w")
            .join(have.alias("h"), _same_source("w", "h"), "left")
            .select("w.source", (F.col("w.rest") - F.coalesce(F.col("h.have"), F.lit(0))).alias("gap"))
            .filter("gap >= 1")
        )
        used = taken.groupBy("_row").agg(F.sum("more").alias("used"))
        free = classes.filter("size > 0").join(used, "_row", "left")
        free = free.withColumn("left", F.col("rows") - F.coalesce("used", F.lit(0))).filter("left > 0")
        each = F.col("f.size") / F.col("f.rows")
        count = F.greatest(F.lit(1), F.least(F.col("f.left"), F.round(F.col("m.gap") / each).cast("long")))
        offered = free.alias("f").join(missing.alias("m"), _same_source("f", "m")).withColumn("more", count)
        added = (F.col("more") * each).cast("long")
        near = F.abs(F.col("m.gap") - added)
        best = (
            offered.filter(near < F.col("m.gap"))
            .groupBy("m.source")
            .agg(F.min(F.struct(near.alias("near"), F.col("f._h").alias("h"), F.col("f._row").alias("_row"), added.alias("size"), "more")).alias("b"))
        )
        taken = materialize(taken.unionByName(best.select("source", "b.size", "b._row", "b.more")))
    return taken.groupBy("_row").agg(F.sum("more").alias("more"))


def mix_plan(
    docs: DataFrame,
    weights: tuple[float, ...] = (5, 2, 1),
    max_epochs: int = 3,
    share: float = 1.0,
    seed: int = 42,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    closing_rounds: int = 2,
) -> DataFrame:
    """``_row, key, size, rows, source_size, target, copies, more`` per class of equal (key, text, source).

    Every row of a class is taken ``copies`` times, and ``more`` of them once more.

    Sizes are word counts; a null text has none. Sources are weighed in code point order, null last. Whole
    repetitions of a source are its target over its size, rounded down; for the fraction a seeded part of
    its documents is taken once more, never a part of a document. A source without words is taken 0 times;
    null keys, texts and sources are values of their own; no rows give no rows. Reruns agree.
    """
    classes = materialize(
        docs.select(
            _row_key(key, text, source, seed).alias("_row"),
            F.col(source).cast("string").alias("source"),
            F.size(words(F.col(text))).cast("long").alias("_words"),
        )
        .groupBy("_row", "source")
        .agg(F.count(F.lit(1)).alias("rows"), F.max("_words").alias("_words"))
        .withColumn("_h", F.col("_row.hash"))
        .withColumn("size", F.col("rows") * F.col("_words"))
    )
    targets = source_targets(classes.select("source", "size"), weights, max_epochs, share)
    epochs = F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)))
    wanted = materialize(
        targets.withColumn("whole", F.coalesce(epochs, F.lit(0)).cast("long")).withColumn(
            "rest", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long")
        )
    )
    extra = _extra_rows(
        classes.select("source", "size", "rows", "_h", "_row"), wanted.select("source", "rest"), closing_rounds
    )
    planned = classes.join(extra, "_row", "left").alias("c").join(wanted.alias("w"), _same_source("c", "w"))
    return planned.select(
        "c._row",
        F.col("c._row.key").alias(key),
        F.col("c._words").alias("size"),
        "c.rows",
        "w.source_size",
        "w.target",
        F.col("w.whole").alias("copies"),
        F.coalesce(F.col("c.more"), F.lit(0)).cast("long").alias("more"),
    )


def _row_key(key: str, text: str, source: str, seed: int) -> Column:
    """What tells rows apart; a hash of values skips nulls, so it takes along which ones are null."""
    parts = [x for c in (key, text, source) for x in (F.col(c).isNull(), F.col(c))]
    return F.struct(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), F.xxhash64(F.lit(seed), *parts).alias("hash"))


def mix(docs: DataFrame, seed: int = 42, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as :func:`mix_plan` takes it."""
    plan = materialize(mix_plan(docs, seed=seed, key=key, text=text, source=source, **options))
    rows = docs.select(F.struct("*").alias("_doc"), _row_key(key, text, source, seed).alias("_row"))
    split = (F.col("more") > 0) & (F.col("more") < F.col("rows"))
    alike = plan.filter(~split).select("_row", (F.col("copies") + (F.col("more") > 0).cast("long")).alias("_times"))
    out = rows.join(alike, "_row").select("_doc", "_times")
    partly = plan.filter(split).select("_row", "copies", "more")
    if not partly.isEmpty():
        # equal rows are told apart by a number they get here; they are counted in lots, then numbered inside a lot
        lots = rows.withColumn("_id", F.monotonically_increasing_id()).withColumn("_lot", F.pmod("_id", F.lit(4096)))
        lots = materialize(lots.join(partly, "_row"))
        sizes = lots.groupBy("_row", "_lot").agg(F.count(F.lit(1)).alias("_n"))
        earlier = Window.partitionBy("_row").orderBy("_lot").rowsBetween(Window.unboundedPreceding, -1)
        offsets = sizes.select("_row", "_lot", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
        nth = F.col("_before") + F.row_number().over(Window.partitionBy("_row", "_lot").orderBy("_id"))
        times = F.col("copies") + (nth <= F.col("more")).cast("long")
        out = out.unionByName(lots.join(offsets, ["_row", "_lot"]).select("_doc", times.alias("_times")))
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times")))
    return out.filter("_times > 0").select("_doc", copies.alias("_copy")).select("_doc.*")
