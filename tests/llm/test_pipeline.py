"""Every stage against plain Python on its own input, the whole run, and the SQL of single operators."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from catalog.verify import compare, connect
from corpusforge.llm.queries import ORACLES, QUERIES

from . import brute
from .test_operators import FOLDER, clashing, empty, frame, passages

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small folder of documents and labels, with nulls, copies, near copies and shared lines."""
    at = str(tmp_path_factory.mktemp("tables"))
    docs = frame(spark, passages(21, 150)).withColumn("n_chars", F.char_length("text").cast("long"))
    docs.write.parquet(f"{at}/documents.parquet")
    labels = docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    labels.write.parquet(f"{at}/labels.parquet")
    return at


@pytest.fixture(scope="module")
def stored(spark, folder):
    """The documents each stage gets: {stage: rows}."""
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        result = stage(spark, docs, folder)
        at = f"{folder}/{name}"
        result.write.parquet(at)
        out[name] = (docs.collect(), spark.read.parquet(at).collect(), result.columns)
        docs = spark.read.parquet(at)
    return out


def test_stages_return_the_columns_of_documents(stored):
    assert all(columns == COLUMNS for name, (_, _, columns) in stored.items() if name != "best_fit_packing")


def test_quality_stage(stored):
    before, after, _ = stored["quality_rules"]
    kept = {r["doc_id"] for r in before if not brute.base_rules(r["text"])["base_failed"]}  # too few labels for more
    assert sorted(after) == sorted(r for r in before if r["doc_id"] in kept)


def test_line_stage(stored):
    before, after, _ = stored["line_dedup"]
    want = brute.kept_without_similar_lines([(r["doc_id"], r["text"]) for r in before])
    assert {r["doc_id"]: r["text"] for r in after} == {d: text for d, (_, _, text) in want.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in after) and any(n for _, n, _ in want.values())


def test_near_dedup_stage(stored):
    before, after, _ = stored["simhash_near_dedup"]
    groups = brute.smallest_linked([(r["doc_id"], brute.simhash(r["text"], 5)) for r in before], 3)
    assert sorted(after) == sorted(r for r in before if groups[r["doc_id"]] == r["doc_id"])
    assert len(after) < len(before)


def test_mixing_stage(stored):
    before, after, _ = stored["source_mixing"]
    total, taken = Counter(), Counter()
    for r in before:
        total[r["source"]] += len(brute.words(r["text"]))
    copies = Counter(after)
    for r, n in copies.items():
        assert n <= 3 and r in before
        taken[r["source"]] += n * len(brute.words(r["text"]))
    for s, want in brute.targets(total).items():
        assert abs(taken[s] - want) <= 0.03 * want + 60


def test_packing_stage(stored):
    before, after, _ = stored["best_fit_packing"]
    assert Counter(r["doc_id"] for r in after if r["piece"] == 0) == Counter(r["doc_id"] for r in before)
    used = Counter()
    for r in after:
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= 2048
    assert len(used) == brute.bins_of_best_fit([r["length"] for r in after], 2048)


def test_run_is_the_stages_in_order(spark, folder, stored):
    got = corpus_pipeline.run(spark, folder)
    assert sorted((r["doc_id"], r["ids_crc32"]) for r in got.collect()) == sorted((r["doc_id"], r["ids_crc32"]) for r in stored["best_fit_packing"][1])


SHORT, LONG = " ".join(f"term{i}" for i in range(60)), " ".join(f"word{i}" for i in range(30_000))
HARD = [(None, None), (1, ""), (1, ""), (2, "a b"), (None, SHORT), (3, LONG)]


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_on_hard_input(spark, folder, name):
    """Null keys and texts, repeated rows, a very long text, further columns with clashing names, no rows."""
    hard = clashing(frame(spark, HARD))
    result = STAGES[name](spark, hard, folder)
    got = result.collect()
    assert STAGES[name](spark, empty(spark), folder).count() == 0
    if name != "best_fit_packing":
        assert set(COLUMNS) <= set(result.columns)
        found = Counter((r["doc_id"], r["text"] or "") for r in got)
    given = Counter((d, t or "") for d, t in HARD)
    if name == "quality_rules":
        assert found == {(None, SHORT): 1, (3, LONG): 1}
    elif name == "line_dedup":
        assert found == given
    elif name == "simhash_near_dedup":
        assert {k: n for k, n in found.items() if k[1]} == {(2, "a b"): 1, (None, SHORT): 1, (3, LONG): 1}
        assert sum(n for (_, t), n in found.items() if not t) == 1
    elif name == "source_mixing":
        assert set(found) <= set(given) and all(n <= 3 * given[k] for k, n in found.items())
    else:
        assert Counter(r["doc_id"] for r in got if r["piece"] == 0) == Counter(d for d, _ in HARD)
        used = Counter()
        for r in got:
            used[r["sequence_id"]] += r["length"]
        assert max(used.values()) <= 2048


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_their_sql(spark, name):
    df = QUERIES[name](spark, FOLDER)
    rows = [tuple(r) for r in df.collect()]
    result = connect(FOLDER).execute(ORACLES[name])
    assert compare(df.columns, rows, [c[0] for c in result.description], result.fetchall()) == ""
