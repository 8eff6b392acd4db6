"""Retrieval against brute force: prefixes, ties, copies, balancing, and the tiled search."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusforge.operators import circle, render, retrieval
from corpusforge.operators.joins import with_split
from corpusforge.operators.retrieval import random_neighbors, similar_rows
from corpusforge.session import materialize
from corpusforge.spec import TableSpec


def steady(x):
    return float(f"{x:.10e}")


def brute(query, train, spec, n, balanced, exclude):
    nums, cats = list(spec.num_cols), list(spec.cat_cols)
    mean = train[nums].astype(float).mean().map(steady)
    std = train[nums].astype(float).std().replace(0, 1.0).map(steady)

    def unit(df):
        z = [((df[c].astype(float).fillna(mean[c]) - mean[c]) / std[c]).to_numpy() for c in nums]
        norm = np.sqrt(_sum([x * x for x in z]))
        norm[norm == 0] = 1
        return [x / norm for x in z]

    def _sum(parts):
        out = parts[0]
        for p in parts[1:]:
            out = out + p
        return out

    def text(df, c):
        return df[c].fillna("missing").replace("?", "missing").to_numpy()

    tv, qv, ids, y = unit(train), unit(query), train["_row_id"].to_numpy(), train[spec.target].to_numpy()
    tc, qc = [text(train, c) for c in cats], [text(query, c) for c in cats]
    out = {}
    for i, qid in enumerate(query["_row_id"]):
        mask = np.ones(len(train), bool)
        for a, b in zip(tc, qc):
            narrower = mask & (a == b[i])
            if narrower.sum() <= n:
                break
            mask = narrower
        c = np.where(mask)[0]
        if exclude:
            c = c[ids[c] != qid]
        sim = _sum([t[c] * q[i] for t, q in zip(tv, qv)])
        order = np.lexsort((ids[c], -sim))
        rows = [(int(ids[j]), float(s), y[j]) for j, s in zip(c[order], sim[order])]
        out[int(qid)] = [(a, b) for a, b, _ in pick(rows, spec.task, n, balanced)]
    return out


def pick(rows, task, n, balanced):
    if not balanced:
        return rows[:n]
    best = lambda r: (-r[1], r[0])
    if task == "multiclass":
        labels = sorted({r[2] for r in rows})
        if len(labels) <= 1:
            return rows[:n]
        each, rest = divmod(n, len(labels))
        per = {k: [r for r in rows if r[2] == k] for k in labels}
        chosen = [r for k in labels for r in per[k][:each]]
        chosen += sorted([per[k][each] for k in labels if len(per[k]) > each], key=best)[:rest]
    else:
        middle = np.median([float(r[2]) for r in rows])
        ones = [r for r in rows if float(r[2]) > middle]
        zeros = [r for r in rows if not float(r[2]) > middle]
        chosen = ones[: n // 2] + zeros[: n // 2 + n % 2]
    chosen += [r for r in rows if r not in chosen][: max(0, n - len(chosen))]
    return sorted(chosen, key=best)


@pytest.fixture(scope="module")
def frame():
    rng, size = np.random.default_rng(1), 1500
    df = pd.DataFrame(
        {
            "_row_id": np.arange(size),
            "c1": rng.choice(["a", "b", "c", "d", None, "?"], size, p=[0.4, 0.3, 0.2, 0.05, 0.03, 0.02]),
            "c2": rng.choice(list("xyz"), size),
            "a": rng.normal(size=size).round(1),
            "b": rng.normal(size=size).round(2),
            "d": np.where(rng.random(size) < 0.3, 1.5, rng.normal(size=size)),
            "y": rng.choice(["P", "F", "O"], size, p=[0.6, 0.35, 0.05]),
            "p": rng.normal(size=size),
        }
    )
    df.loc[::13, "a"] = np.nan
    df.loc[rng.random(size) < 0.33, ["a", "b", "d"]] = [0.5, 0.25, 1.0]  # a third of all rows are copies
    return df


CASES = [
    ("multiclass", "y", ("c1", "c2"), ("a", "b", "d"), 8, True, True, 8192),
    ("multiclass", "y", ("c1", "c2"), ("a", "b", "d"), 7, False, False, 8192),
    ("regression", "p", ("c1", "c2"), ("a", "b"), 5, True, True, 8192),
    ("multiclass", "y", ("c1",), ("a",), 4, True, False, 8192),
    ("multiclass", "y", (), ("a", "b", "d"), 1, False, True, 1),
    ("regression", "p", (), ("a", "b", "d"), 1, True, True, 1),
]


@pytest.mark.parametrize("task,target,cats,nums,n,balanced,exclude,cell", CASES)
def test_equals_brute_force(spark, frame, task, target, cats, nums, n, balanced, exclude, cell):
    spec = TableSpec("t", target, task, cats, nums)
    pdf = frame[["_row_id", *cats, *nums, target]]
    train = pdf[pdf["_row_id"] % 10 < 7]
    query = train if exclude else pdf[pdf["_row_id"] % 10 >= 7]
    found = similar_rows(spark.createDataFrame(query), spark.createDataFrame(train), spec, n, balanced, exclude, cell_rows=cell)
    got = {r.query_id: [(c.train_id, c.similarity) for c in r.cases] for r in found.collect()}
    assert got == brute(query, train, spec, n, balanced, exclude)


def test_random_neighbors_are_distinct_and_never_self(spark, frame):
    df = spark.createDataFrame(frame[["_row_id", "y"]])
    rows = random_neighbors(df, df, 5, exclude_self=True).toPandas()
    assert (rows.groupby("query_id")["train_id"].nunique() == 5).all() and len(rows) == 5 * len(frame)
    assert (rows["query_id"] != rows["train_id"]).all()
    assert rows.groupby("train_id").size().max() < 60


def test_no_numbers_and_small_table(spark):
    df = spark.createDataFrame([(i, "a", "P") for i in range(4)], "_row_id bigint, c string, y string")
    spec = TableSpec("t", "y", "multiclass", ("c",), ())
    got = {r.query_id: [(c.train_id, c.similarity) for c in r.cases] for r in similar_rows(df, df, spec, 5, exclude_self=True).collect()}
    assert got[2] == [(0, 1.0), (1, 1.0), (3, 1.0)]


def test_random_neighbors_broadcast_no_rows(spark):
    """Only the counts per hash piece are small; walks, ranks and splits are not, whatever size Spark takes them for."""
    rows = spark.range(3000).select(F.col("id").alias("_row_id"))
    splits = materialize(rows.select("_row_id", F.lit("train").alias("split")))
    picked = random_neighbors(materialize(rows), with_split(rows, splits, "train"), 16, exclude_self=True)
    plan = picked._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("BroadcastHashJoin") <= 1 and plan.count("SortMergeJoin") >= 2
    assert picked.count() == 16 * 3000


def test_neighbours_on_a_circle_are_those_of_all_pairs():
    r = np.random.default_rng(5)
    x = r.normal(size=(4000, 2))
    x[:1500, 1] = 1e-8 * r.integers(0, 40, 1500)  # many sums that tie in the last bit
    x[:1500, 0] = np.where(r.random(1500) < 0.5, 1.0, -1.0)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[3990:] = 0.0
    summed = x[:, 0:1] * x[:, 0] + x[:, 1:2] * x[:, 1]
    compared = []

    def compare(q, t, ids, floor, k):
        compared.append(len(q))
        s = q[:, 0:1] * t[:, 0] + q[:, 1:2] * t[:, 1]
        by = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :k]
        rows = np.repeat(np.arange(len(q)), by.shape[1])
        return rows, s[rows, by.ravel()], ids[by.ravel()]

    for lo, hi, k in [(0, 4000, 17), (0, 4000, 1), (1500, 1700, 90), (3000, 4000, 6)]:
        t, ids = x[lo:hi], np.arange(lo, hi)
        rows, sims, found = circle.best(x, t, ids, np.full(len(x), -2.0), k, compare)
        want = np.lexsort((np.broadcast_to(ids, (len(x), len(ids))), -summed[:, lo:hi]), axis=1)[:, :k]
        got = [found[i] for i in np.split(np.argsort(rows, kind="stable"), np.arange(1, len(x)) * k)]
        assert np.array_equal(np.array(got), want + lo)
        assert np.array_equal(sims[np.argsort(rows, kind="stable")], np.take_along_axis(summed[:, lo:hi], want, 1).ravel())
    assert max(compared) <= 10  # vectors of length zero only


@pytest.mark.parametrize("many", [0, 10_000])
def test_rows_of_crowded_and_other_points_find_the_same(spark, frame, monkeypatch, many):
    monkeypatch.setattr(retrieval, "MANY_COPIES", many)
    spec = TableSpec("t", "y", "multiclass", ("c1",), ("a", "b"))
    pdf = frame[["_row_id", "c1", "a", "b", "y"]]
    df = spark.createDataFrame(pdf)
    got = {r.query_id: [(c.train_id, c.similarity) for c in r.cases] for r in similar_rows(df, df, spec, 5, True, True).collect()}
    assert got == brute(pdf, pdf, spec, 5, True, True)


def test_cases_are_neither_kept_in_lists_nor_sorted_for_their_texts(spark):
    """Texts of a query that come in several batches, null ones, and a plan with one sort of the many rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        near = spark.createDataFrame([(q, t, 0.5, t + 1) for q in range(40) for t in range(q % 12)], "query_id long, train_id long, similarity double, rank long")
        text = spark.createDataFrame([(t, f"x is {t}", None if t == 3 else "yes") for t in range(12)], "train_id long, features string, truth string")
        found = render.render_cases(near, text)
        got = {r.query_id: r.cases for r in found.collect()}
        plan = found._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    lines = [f"Example {t + 1} (similarity: 0.500):\n  Features: x is {t}\n  Ground truth: yes" for t in range(12)]
    assert got == {q: "\n".join(["=== Similar Historical Cases ===", *(x for t, x in enumerate(lines[: q % 12]) if t != 3)]) for q in range(40) if q % 12}
    assert "Aggregate" not in plan and "SortMergeJoin" not in plan
