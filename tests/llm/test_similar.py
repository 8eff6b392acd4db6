"""Near-dedup by Jaccard similarity, against all pairs."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

import corpus_pipeline
from corpusforge.llm import lines, similar, simhash

from . import brute
from .test_operators import frame


def edited(text, share, r):
    """A copy with other line breaks and a share of its words changed."""
    words = [f"e{r.randrange(10**6)}" if r.random() < share else w for w in text.split()]
    return " ".join(w + ("\n" if r.random() < 0.1 else "") for w in words)


def groups(texts):
    """{doc_id: smallest doc_id} over pairs of Jaccard 0.8 on runs of five words, or 3 differing bits."""
    sets = {d: brute.line_tokens(" ".join(brute.words(t)).lower()) for d, t in texts}
    prints = {d: brute.simhash(t, 5) for d, t in texts}
    parent = {d: d for d, _ in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in parent:
        for b in parent:
            x, y = sets[a], sets[b]
            if a < b and ((prints[a] ^ prints[b]).bit_count() <= 3 or 9 * len(x & y) >= 4 * (len(x) + len(y)) > 0):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {d: find(d) for d in parent}


def texts_with_near_copies():
    r = random.Random(11)
    word = lambda: f"w{r.randrange(3000)}"
    texts = []
    for _ in range(25):
        base = " ".join(word() for _ in range(r.randint(100, 400)))
        texts += [base, edited(base, 0.01, r), edited(base, 0.02, r), edited(base, 0.05, r)]
    for _ in range(2):  # crowds of copies of copies
        base = " ".join(word() for _ in range(200))
        for _ in range(40):
            texts.append(edited(base, r.choice([0.0, 0.005, 0.02, 0.06]), r))
            base = r.choice([base, texts[-1]])
    texts += ["", None, "one two", "one two", "ONE two", "a b c d e f"]
    r.shuffle(texts)
    return list(enumerate(texts))


def test_stage_finds_what_fingerprints_miss(spark):
    texts = texts_with_near_copies()
    want = groups(texts)
    only_prints = brute.smallest_linked([(d, brute.simhash(t, 5)) for d, t in texts], 3)
    assert len(set(want.values())) < len(set(only_prints.values())) - 20
    got = corpus_pipeline.one_of_each_group(spark, frame(spark, texts), "")
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(set(want.values()))


def test_components_are_those_of_all_pairs(spark):
    texts = texts_with_near_copies()
    docs = frame(spark, texts).repartition(5)
    small = lambda *a: similar.more_links(*a, block_bytes=10_000, held_entries=500)
    got = simhash.components(docs, reach=3, shingle_words=5, more_links=small).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == groups(texts)


def test_one_group_of_a_token_costs_no_square(spark):
    crowd = spark.range(1000).select(F.lit(7).cast("long").alias("token"), F.col("id").alias("_key"), F.lit(0).alias("line"), F.lit(9).alias("n"), F.lit(0).alias("place"), F.lit(True).alias("more"))
    nodes = spark.range(1000).select(F.col("id").alias("_key"), F.col("id").alias("node"), F.col("id").alias("shingles"))
    roots = spark.range(1, 999).select(F.col("id").alias("a"), F.lit(0).cast("long").alias("b"))
    rest = similar._across(crowd, nodes, roots).collect()
    assert {(r["_key"], r["ref_key"]) for r in rest} == {(999, i) for i in range(999)}


def test_bitmap_holds_all_that_are_chosen(spark):
    docs = spark.range(-5000, 5000).select(F.col("id").alias("_key"), F.lit("x").alias("text"))
    chosen = docs.filter("_key % 7 = 0").select("_key", F.lit(0).alias("line"))
    got = {r["_key"] for r in similar._mostly(docs, chosen).collect()}
    want = {i for i in range(-5000, 5000) if i % 7 == 0}
    assert want <= got and len(got) < len(want) + 50


def test_rarity_counts_every_document(spark):
    docs = spark.range(1000).selectExpr("id as _key", "'one short line' as text")
    classes = lines.rarity_classes(docs)
    assert sorted(set(classes.tolist())) == [0, 10]  # 1000 of one token: the logarithm of 1001, rounded up
