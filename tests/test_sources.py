"""File order, shards with equal names, codes as text, splits that are not there, bounded windows."""

import pytest
from pyspark.sql import functions as F

from corpusforge import session
from corpusforge.operators import cleaning as C
from corpusforge.operators import joins as J
from corpusforge.operators import ranking as K
from corpusforge.operators.quantiles import exact_quantiles
from corpusforge.operators.splits import undersample_3to1
from corpusforge.sources import tables as IO
from corpusforge.spec import MULTICLASS, TableSpec

SPEC = TableSpec("t", "y", MULTICLASS, ("c",), ("x",))


def write(path, rows):
    path.write_text("encounter_id,patient_nbr,x,c,y\n" + "".join(f"{r}\n" for r in rows))


def test_row_ids_follow_file_names_and_first_rows_too(spark, tmp_path):
    write(tmp_path / "a.csv", [f"{i},p{i % 3},1,u,v" for i in (100, 99, 98)])
    write(tmp_path / "b.csv", [f"{i},p{i % 3},2,u,v" for i in range(400, 0, -1)])
    table = IO.read_table(spark, str(tmp_path), SPEC)
    rows = [(r["_row_id"], r["encounter_id"]) for r in table.orderBy("_row_id").collect()]
    assert rows == list(enumerate(["100", "99", "98", *map(str, range(400, 0, -1))]))
    first = C.first_encounter(table.select("_row_id", "patient_nbr", "encounter_id", "x"), "patient_nbr")
    assert sorted(r["_row_id"] for r in first.collect()) == [0, 1, 2]


def test_text_ids_order_as_numbers(spark):
    df = spark.createDataFrame([("p", "100"), ("p", "99"), ("q", "7"), ("q", None)], "patient_nbr string, encounter_id string")
    got = {r["patient_nbr"]: r["encounter_id"] for r in J.first_per_key(df, ["patient_nbr"], ["encounter_id"]).collect()}
    assert got == {"p": "99", "q": "7"}


def test_codes_as_text(spark):
    df = spark.createDataFrame([("11",), ("?",), ("12",), (None,), ("13.0",)], "code string")
    assert {r["code"] for r in C.exclude_codes(df, "code").collect()} == {"?", "12", None}
    dim = spark.createDataFrame([("12", "sent home to die"), ("x", "died")], "code string, text string")
    kept = C.exclude_by_keyword(df, "code", dim, "code", "text", ("die",))
    assert {r["code"] for r in kept.collect()} == {"?", "11", "13.0", None}


def test_shards_of_one_name_in_two_folders(spark, tmp_path):
    import json
    import os

    for when, folder, text in ((100, "old", "stale"), (200, "new", "fresh")):
        (tmp_path / folder).mkdir()
        for part in (1, 2):
            at = tmp_path / folder / f"a_mode_finetune_{part}_finetune_x_final.json"
            at.write_text(json.dumps([{"instruction": "i", "input": f"{part}.{k}", "output": text} for k in range(3)]))
            os.utime(at, (when, when))
    records = IO.read_corpus(spark, str(tmp_path), recursive=True)
    merged = IO.merge_shards(records, 2).orderBy("part", "pos").collect()
    assert [(r["part"], r["pos"], r["input"], r["output"]) for r in merged] == [
        (p, k, f"{p}.{k}", "fresh") for p in (1, 2) for k in range(3)
    ]
    with pytest.raises(ValueError, match="missing"):
        IO.merge_shards(records, 3)


def test_a_split_that_is_not_there(spark):
    df = spark.range(4).select(F.col("id").alias("_row_id"))
    splits = df.withColumn("split", F.lit("train"))
    with pytest.raises(ValueError, match="no split 'test'"):
        J.with_split(df, splits, "test")


def test_ranges_stay_bounded_for_one_group(spark, monkeypatch):
    df = spark.range(20_000).select((F.col("id") * 7919 % 20_011).cast("double").alias("x"))
    ranged = K.in_ranges(df, [], [F.col("x")], rows=1_000)
    largest = ranged.groupBy("_piece").count().agg(F.max("count")).first()[0]
    assert largest < 3_000
    placed = K.running_in_ranges(df, [], [F.col("x")], F.lit(1), "n", rows=1_000).orderBy("x").collect()
    assert [r["n"] for r in placed] == list(range(1, 20_001))
    monkeypatch.setattr(K.running_in_ranges, "__defaults__", (50,))
    row = exact_quantiles(df.withColumn("g", F.lit(0)), ["g"], "x", [0.25, 0.5]).first()
    values = sorted(r["x"] for r in df.collect())
    assert (row["q0"], row["q1"]) == (pytest.approx(values[4999] + 0.75 * (values[5000] - values[4999])), pytest.approx((values[9999] + values[10000]) / 2))


def test_undersampling_cuts_before_it_ranks(spark):
    df = spark.range(1000).select(F.col("id").alias("_row_id"), (F.col("id") % 5 == 0).cast("int").alias("y"))
    rows = undersample_3to1(df, "y", 403).orderBy("pos").collect()
    assert [r["pos"] for r in rows] == list(range(403)) and [r["y"] for r in rows[:8]] == [0, 0, 0, 1] * 2


def test_release_deletes_what_was_stored(spark, monkeypatch):
    monkeypatch.setattr(session, "_written", [])
    stored = session.materialize(spark.range(3).toDF("x"))
    assert stored.count() == 3 and session.release(spark) == 1 and session.release(spark) == 0


def shard_rows(spark, n, text, parts=(1, 2, 3)):
    rows = [(f"{p}_mode_finetune_{k}_finetune_x_final.json", "i", "x", f"{text}{p}{k}.{i}", i) for p in ("a", "b=c d") for k in parts for i in range(n)]
    return spark.createDataFrame(rows, "shard string, instruction string, input string, output string, i int").repartition(5)


def test_written_shards_merge_by_their_manifest(spark, tmp_path):
    path = str(tmp_path)
    IO.write_shards(shard_rows(spark, 70, "old "), path, 0, ["i"], rows=40)
    IO.write_shards(shard_rows(spark, 50, "", parts=(1, 3)), path, 2, ["i"], rows=40)
    manifest = IO.shard_manifest(spark, path).collect()
    assert len({(r["version"], r["shard"]) for r in manifest}) == 10 and len(manifest) > 10
    merged = IO.merge_written_shards(spark, path, 3).orderBy("prefix", "part", "pos").collect()
    want = [
        (p, k, i, f"{'old ' if k == 2 else ''}{p}{k}.{i}") for p in ("a", "b=c d") for k in (1, 2, 3) for i in range(70 if k == 2 else 50)
    ]
    assert [(r["prefix"], r["part"], r["pos"], r["output"]) for r in merged] == want
    # a version without its manifest is not there yet
    shard_rows(spark, 5, "half ").drop("i").withColumns({"at": F.lit(0), "piece": F.lit(0)}).write.partitionBy("shard", "piece").json(f"{path}/data/version=3")
    assert IO.merge_written_shards(spark, path, 3).count() == len(want)
    with pytest.raises(ValueError, match="missing"):
        IO.merge_written_shards(spark, path, 4)
