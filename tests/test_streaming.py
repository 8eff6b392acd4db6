"""Running counters of a stream equal a batch over the log after every micro-batch."""

import uuid

import pytest
from pyspark.sql import functions as F

from corpusforge.functions.responses import normalize_class
from corpusforge.operators.joins import latest
from corpusforge.operators.verdicts import split_responses, verdict
from corpusforge.sources.tables import append_outputs, log_lines
from corpusforge.streaming.verdicts import add_changes, current_counts, status_changes, stream_verdicts, write_counts

ROUNDS = [
    [(i, 1, "yes" if i % 3 else "?") for i in range(40)],
    [(i, 2, "no") for i in range(0, 40, 4)] + [(i, 1, "yes") for i in range(40, 50)],
    [(i, 4, "yes") for i in range(0, 40, 8)] + [(i, 3, "?") for i in range(0, 40, 4)],  # attempt 3 after 4 in some rows
    [(5, 3, "no"), (5, 3, "yes"), (6, 2, None), (7, 9, "?")],
    [(5, 2, "?"), (60, 1, "yes")],  # an old attempt, and a row that the corpus does not have
]


def parse(final):
    return normalize_class(final, ["yes", "no"])


@pytest.fixture
def corpus(spark):
    rows = [(i, f"f{i % 2}", "yes" if i % 5 else "") for i in range(55)]
    return spark.createDataFrame(rows, "_row_id long, file string, output string")


def counts_of(rows, *by):
    return {tuple(r[c] for c in (*by, "status")): r["cnt"] for r in rows.collect()}


@pytest.mark.parametrize("by", [(), ("file",)])
def test_counters_follow_every_micro_batch(spark, tmp_path, corpus, by):
    log, out, state = (f"{tmp_path}/{n}" for n in ("log", "counts", "state"))
    for rows in ROUNDS:
        append_outputs(spark.createDataFrame(rows, "_row_id long, attempt long, raw string").coalesce(1), log)
        # the query is started again for every file: state and counters come from the checkpoint and the table
        judged = stream_verdicts(spark, log, corpus, parse, files_per_trigger=1)
        write_counts(status_changes(judged, by), out, state).awaitTermination()
        batch = verdict(split_responses(log_lines(spark.read, log)).join(corpus, "_row_id"), parse)
        batch = latest(batch.select("_row_id", "attempt", "predicted", "status", *by), ["_row_id"], ["attempt"])
        assert counts_of(current_counts(spark, out), *by) == counts_of(batch.groupBy(*by, "status").agg(F.count(F.lit(1)).alias("cnt")), *by)


def test_a_batch_that_runs_again_counts_once(spark, tmp_path):
    path = f"{tmp_path}/{uuid.uuid4().hex}"
    moves = [[("kept", 1), ("kept", 1)], [("kept", -1), ("label_mismatch", 1)], [("label_mismatch", -1), ("kept", 1)]]
    for batch, rows in enumerate(moves):
        for _ in range(2):
            add_changes(spark.createDataFrame(rows, "status string, change long"), path, batch)
    assert counts_of(current_counts(spark, path)) == {("kept",): 2}


def test_counters_call_no_python_per_row(spark, tmp_path, corpus):
    append_outputs(spark.createDataFrame(ROUNDS[0], "_row_id long, attempt long, raw string"), f"{tmp_path}/log")
    changes = status_changes(stream_verdicts(spark, f"{tmp_path}/log", corpus, parse))
    assert changes.isStreaming
    assert "Pandas" not in changes._jdf.queryExecution().analyzed().toString()
