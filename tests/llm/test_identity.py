"""Rows without a doc_id, or different texts under one: each is a document of its own."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from corpusforge.llm import lines, simhash, substrings
from corpusforge.llm.common import identified

from .test_operators import frame


def text(name, n=30):
    return " ".join(f"{name}{i}" for i in range(n))


def test_near_duplicates(spark):
    a, b, c = text("a"), text("b"), text("c")
    docs = frame(spark, [(None, a), (None, b), (None, None), (1, a), (2, b), (3, c), (3, text("d")), (3, text("d")), (4, text("d"))])
    found = {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.components(docs).collect()}
    assert len({f for _, f, _ in found}) == 5
    assert {(d, c) for d, _, c in found} == {(None, None), (1, None), (2, None), (3, 3), (4, 3)}
    kept = [r["text"] for r in simhash.keep_one(docs).collect()]
    assert Counter(kept) == Counter([a, b, None, c, text("d")])


def test_lines(spark):
    one, two, three = text("a"), text("b"), text("c")
    docs = frame(spark, [(None, f"{one}\n{two}"), (None, f"{three}\n{three}"), (5, f"{one}\nx"), (5, f"y\n{three}"), (5, f"y\n{three}")])
    want = Counter({f"{one}\n{two}": 1, three: 1, "x": 1, "y": 2})
    assert Counter(r["kept"] for r in lines.dedup_lines(docs).collect()) == want
    assert Counter(r["text"] for r in lines.replace_text(docs).collect()) == want


def test_substrings(spark):
    a, b, c = text("a"), text("b"), text("c")
    docs = frame(spark, [(None, f"{a} {b}"), (None, f"{c} x {c}"), (5, f"p {a}"), (5, f"{c} q"), (5, f"{c} q")])
    got = Counter((r["n_removed"], r["kept"]) for r in substrings.dedup_substrings(docs).collect())
    assert got == Counter({(0, f"{a} {b}"): 1, (30, f"{c} x"): 1, (30, "p"): 1, (30, "q"): 2})


def test_identity_keeps_the_order_of_keys(spark):
    rows = [(d, t) for d in (None, -3, 7, 2) for t in ("a", "b", "", None)] + [(2, "b")]
    got = identified(frame(spark, rows), "doc_id", "text").select("_key", "_doc.doc_id", "_doc.text").collect()
    assert len(got) == 17 and len({r["_key"] for r in got}) == 16
    ids = [r["doc_id"] for r in sorted(got, key=lambda r: r["_key"])]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))
    plain = identified(frame(spark, [(4, "a"), (None, "b"), (4, "a")]), "doc_id", "text")
    assert sorted(r["_key"] for r in plain.filter(F.col("_doc.doc_id").isNotNull()).collect()) == [4, 4]
