"""Responses against expected labels: parse, verdict, counters, retries, final corpus."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusforge.functions.numbers import is_close, parse_number, py_str, trim_all
from corpusforge.functions.responses import (
    append_label,
    compose_response,
    features_text,
    split_final,
    split_think,
    strip_label,
)
from corpusforge.operators.joins import latest
from corpusforge.session import materialize
from corpusforge.sources.tables import append_outputs, path_exists, read_outputs, resume_outputs

KEPT, EMPTY, UNREADABLE, MISMATCH = "kept", "expected_empty", "predicted_parse_fail", "label_mismatch"

# When repeated generation stops.
TARGET_RATIO = 0.05
MAX_ROUNDS = 10
PATIENCE = 2
RETRY_TEMPERATURE = 0.2


def split_responses(outputs: DataFrame, raw: str = "raw", keep_think: bool = True) -> DataFrame:
    """Add ``think``, ``final`` and ``merged``; without ``keep_think`` merged is the answer alone."""
    split = outputs.withColumn("think", split_think(F.col(raw))).withColumn("final", split_final(F.col(raw)))
    merged = compose_response(F.col("think"), F.col("final")) if keep_think else F.col("final")
    return split.withColumn("merged", merged)


def verdict(joined: DataFrame, parse, regression: bool = False, expected: str = "output", final: str = "final") -> DataFrame:
    """Add ``predicted`` and ``status``; an empty expected label outranks an unreadable response."""
    want = F.coalesce(F.col(expected), F.lit(""))
    label = F.lower(trim_all(want))
    predicted = parse(F.col(final))
    as_text = py_str(predicted) if regression else predicted.cast("string")
    same_text = F.lower(trim_all(as_text)) == label
    if regression:
        a, b = parse_number(want), predicted
        same = F.when(a.isNotNull() & b.isNotNull(), is_close(a, b)).otherwise(same_text)
    else:
        same = same_text
    status = (
        F.when(label == "", EMPTY).when(predicted.isNull(), UNREADABLE).when(~same, MISMATCH).otherwise(KEPT)
    )
    return joined.withColumn("predicted", as_text).withColumn("status", status)


def verdict_counts(verdicts: DataFrame, file: str = "file") -> DataFrame:
    """Outcome counters per file and overall (``file`` NULL)."""
    per = verdicts.groupBy(file, "status").agg(F.count(F.lit(1)).alias("_n"))
    count = lambda s: F.coalesce(F.sum(F.when(F.col("status") == s, F.col("_n"))), F.lit(0)).alias(s)
    return per.rollup(file).agg(
        F.sum("_n").alias("total"),
        count(KEPT),
        F.coalesce(F.sum(F.when(F.col("status") != KEPT, F.col("_n"))), F.lit(0)).alias("filtered"),
        count(EMPTY),
        count(UNREADABLE),
        count(MISMATCH),
    )


def retry_candidates(verdicts: DataFrame) -> DataFrame:
    """Unreadable or mismatching responses; rows without an expected label are not retried."""
    return verdicts.filter(F.col("status").isin(UNREADABLE, MISMATCH))


def unparsed(predictions: DataFrame, label: str = "label") -> DataFrame:
    return predictions.filter(F.col(label).isNull())


def filtered_records(verdicts: DataFrame, regression: bool = False, expected: str = "output") -> DataFrame:
    """Audit rows of everything that was not kept; compared values only for mismatches."""
    bad = F.col("status") == MISMATCH
    want = F.lower(trim_all(F.col(expected)))
    if regression:
        want = F.coalesce(py_str(parse_number(F.col(expected))), want)
    return verdicts.filter(F.col("status") != KEPT).select(
        "_row_id",
        F.col("status").alias("reason"),
        F.coalesce(F.col(expected), F.lit("")).alias("expected_raw_output"),
        F.when(bad, want).alias("expected_parsed_output"),
        F.when(bad, F.lower(trim_all(F.col("predicted")))).alias("predicted_parsed_output"),
        F.col("final").alias("teacher_output_final"),
        F.col("merged").alias("teacher_output_merged"),
    )


def final_corpus(verdicts: DataFrame, instruction: str, accept_plain_title: bool = False) -> DataFrame:
    """Kept rows with the training instruction, the bare features and the response as output."""
    text = F.coalesce(features_text(F.col("input"), accept_plain_title), F.col("input"))
    return verdicts.filter(F.col("status") == KEPT).select(
        "_row_id", F.lit(instruction).alias("instruction"), strip_label(text).alias("input"), F.col("final").alias("output")
    )


def to_messages(corpus: DataFrame) -> DataFrame:
    """Chat messages: the instruction as system text, the input with its given label as user text."""

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    user = append_label(F.col("input"), F.trim(F.coalesce("output", F.lit(""))))
    system = F.coalesce("instruction", F.lit(""))
    return corpus.select("_row_id", F.array(message("system", system), message("user", user)).alias("messages"))


def unparsed_verdicts(verdicts: DataFrame) -> DataFrame:
    """Failures of a prediction run: responses without a readable label, right or wrong."""
    return verdicts.filter(F.col("predicted").isNull())


def generate_until(
    corpus: DataFrame,
    generate,
    parse,
    regression: bool = False,
    temperature: float = 0.0,
    target_ratio: float = TARGET_RATIO,
    max_rounds: int = MAX_ROUNDS,
    patience: int = PATIENCE,
    failures=retry_candidates,
    log: str | None = None,
) -> DataFrame:
    """Generate responses, then regenerate those that fail until few fail or progress stalls.

    ``generate(batches, temperature)`` maps an iterator of pandas frames with ``_row_id`` and
    ``messages`` to frames with ``_row_id`` and ``raw``; it runs inside the tasks. ``failures`` picks the
    rows to ask again from a table of verdicts: those that miss their label, or for a prediction run
    :func:`unparsed_verdicts`. Each round judges only its own answers, and is stored before the next.

    With ``log``, answers are appended to that response log round by round, and rows that it already
    answers are not asked anew when the job starts again. Inside a round, a task that fails is repeated
    and asks its rows again.
    """
    spark = corpus.sparkSession

    def ask(rows: DataFrame, heat: float, attempts: DataFrame | None) -> DataFrame:
        """Answers of ``rows``, stored (in the log too); an attempt is one more than the row's last."""

        def run(batches):
            yield from generate(batches, heat)

        got = to_messages(rows).mapInPandas(run, "_row_id bigint, raw string")
        once = latest(got.withColumn("_o", F.lit(0)), ["_row_id"], ["_o"]).drop("_o")
        answered = rows.select("_row_id").join(once, "_row_id", "left")
        if attempts is None:
            numbered = answered.withColumn("attempt", F.lit(0))
        else:
            numbered = answered.join(attempts, "_row_id").withColumn("attempt", F.col("attempt") + 1)
        stored = materialize(numbered.select("_row_id", "attempt", F.coalesce("raw", F.lit("")).alias("raw")))
        if log:
            append_outputs(stored, log)
        return stored

    def judge(outputs: DataFrame) -> DataFrame:
        return materialize(verdict(corpus.join(split_responses(outputs), "_row_id"), parse, regression))

    total = corpus.count()
    if log and path_exists(spark, log):
        known = materialize(read_outputs(spark, log))
        rounds = [judge(known.unionByName(ask(resume_outputs(corpus, known), temperature, None)))]
    else:
        rounds = [judge(ask(corpus, temperature, None))]
    least_drop = max(1, math.floor(total * 0.001))
    last, stalls = None, 0
    for _ in range(max_rounds):
        again = materialize(failures(rounds[-1]).select("_row_id", "attempt"))
        failing = again.count()
        if failing == 0 or failing / total <= target_ratio:
            break
        if last is not None:
            stalls = stalls + 1 if last - failing < least_drop else 0
            if stalls >= patience:
                break
        rows = corpus.join(again.select("_row_id"), "_row_id", "left_semi")
        rounds.append(judge(ask(rows, max(temperature, RETRY_TEMPERATURE), again)))
        last = failing
    everything = rounds[0]
    for later in rounds[1:]:
        everything = everything.unionByName(later)
    return latest(everything, ["_row_id"], ["attempt"]) if len(rounds) > 1 else everything
