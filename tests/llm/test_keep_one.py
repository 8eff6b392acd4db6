"""Near-dedup shuffles rows in doubt only."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from corpusforge.llm import simhash

from .test_operators import frame


def test_rows_that_stay_are_not_shuffled(spark):
    r = random.Random(7)
    texts = [(i, " ".join(f"w{r.randrange(5000)}" for _ in range(60))) for i in range(200)]
    docs = frame(spark, texts).repartition(3)
    docs = spark.createDataFrame(docs.rdd, docs.schema)  # as dealt, whatever the plan would do

    def together(df):
        found = df.groupBy(F.spark_partition_id()).agg(F.collect_set("doc_id").alias("ids")).collect()
        return {frozenset(x["ids"]) for x in found}

    assert together(simhash.keep_one(docs, reach=0)) == together(docs)


def test_of_doubtful_rows_one_stays(spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(1, text), (1, text), (2, text), (3, "another text of a few words"), (3, "another text of a few words"), (4, "alone it stands here"), (None, text)]
    got = [(x["doc_id"], x["text"]) for x in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), reach=0).collect()]
    assert sorted(got, key=str) == sorted([(None, text), (3, "another text of a few words"), (4, "alone it stands here")], key=str)
