"""A tiled search whose answers bring their points along."""

from __future__ import annotations

import random

from corpusforge.operators import retrieval
from corpusforge.operators.retrieval import similar_rows
from corpusforge.spec import TableSpec


def test_points_are_not_joined_with_their_answers(spark, monkeypatch):
    # before, points and answers met by a shuffle of both, twice
    r = random.Random(3)
    rows = [(i, "}/1#" if i % 3 else "{", r.gauss(0, 1) if i % 7 else 0.0, r.gauss(0, 1), r.gauss(0, 1), r.choice("xyz}")) for i in range(2_400)]
    df = spark.createDataFrame(rows, "_row_id long, c1 string, a double, b double, c double, y string")
    spec = TableSpec("t", "y", "multiclass", ("c1",), ("a", "b", "c"))

    def found(cell_rows):
        got = similar_rows(df, df.filter("_row_id % 5 > 0"), spec, 1, True, True, cell_rows=cell_rows).collect()
        return {x.query_id: [(c.train_id, c.similarity) for c in x.cases] for x in got}

    plans, score = [], retrieval._score
    monkeypatch.setattr(retrieval, "_score", lambda points, *a: plans.append(points._jdf.queryExecution().analyzed().toString()) or score(points, *a))
    tiled = found(1)
    assert len(plans) == 2 and "Join LeftOuter, ((pid" not in plans[1]
    assert tiled == found(1_000_000)
