"""Small hand-made frames for the boundary cases."""

import json

import pytest
from pyspark.sql import functions as F

from corpusforge.functions import responses as R
from corpusforge.functions.numbers import is_close
from corpusforge.operators import metrics as M
from corpusforge.operators import splits as P
from corpusforge.operators import stats as S
from corpusforge.operators import verdicts as V
from corpusforge.operators.quantiles import exact_quantiles
from corpusforge.plans.corpus import build_corpus
from corpusforge.sources import tables as IO
from corpusforge.spec import CorpusSpec, TableSpec, project, table_spec, task_spec
from corpusforge.tasks import numeric_task


def test_one_row_class_and_empty_column(spark):
    df = spark.createDataFrame([(0, 1.0, None), (1, None, None)], "_row_id bigint, x double, z double")
    rows = S.num_stats(df, ["x", "z"]).collect()
    assert [(r["col"], r["n"], r["n_missing"], r["std"], r["p50"]) for r in rows] == [("x", 1, 1, None, 1.0)]


def test_quantiles_of_heavy_copies(spark):
    import numpy as np

    values = [5.0] * 40_000 + [float(i) for i in range(20_000)] + [None] * 100
    df = spark.createDataFrame([(v,) for v in values], "x double").select(F.lit("g").alias("g"), "x")
    row = exact_quantiles(df, ["g"], "x", [0.0, 0.1, 0.25, 0.5, 0.77, 0.9, 1.0]).first()
    want = np.quantile([v for v in values if v is not None], [0.0, 0.1, 0.25, 0.5, 0.77, 0.9, 1.0])
    assert row["n"] == 60_000
    assert [row[f"q{i}"] for i in range(7)] == pytest.approx(list(want))


def test_quartile_edges(spark):
    def bins(values):
        return S.target_bins(spark.createDataFrame([(float(v),) for v in values], "y double"), "y").orderBy("bin").collect()

    three = bins([1, 1, 1, 2, 3, 4, 5])  # percentiles 1, 1, 2, 3.5, 5
    assert [(r["bin"], r["pct_lo"], r["pct_hi"]) for r in three] == [(1, 25.0, 50.0), (2, 50.0, 75.0), (3, 75.0, 100.0)]
    with pytest.raises(ValueError):
        bins([1, 1, 1, 1, 1, 2])
    edge = bins([0, 1, 2, 3, 4])
    assert [r["cnt"] for r in edge] == [2, 1, 1, 1]


def test_split_is_exact_and_covering(spark):
    df = spark.range(1003).select(F.col("id").alias("_row_id"), (F.col("id") % 7 == 0).cast("string").alias("y"))
    rows = P.stratified_split(df, "y").groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in rows} == {"test": 101, "valid": 101, "train": 801}
    again = P.stratified_split(df.repartition(3), "y")
    assert again.exceptAll(P.stratified_split(df, "y")).isEmpty()


def test_undersampling_stops_at_first_empty_class(spark):
    df = spark.range(40).select(F.col("id").alias("_row_id"), (F.col("id") < 2).cast("int").alias("y"))
    rows = P.undersample_3to1(df, "y", 100).orderBy("pos").collect()
    assert [r["y"] for r in rows] == [0, 0, 0, 1, 0, 0, 0, 1, 0, 0, 0]
    assert [r["pos"] for r in rows] == list(range(11))
    with pytest.raises(ValueError):
        P.undersample_3to1(df.withColumn("y", F.col("_row_id") % 3), "y", 5)


def test_slices(spark):
    df = spark.range(50).select((F.col("id") * 3).alias("_row_id"))
    assert P.slice_corpus(df, test=True).count() == 10
    assert [r["pos"] for r in P.slice_corpus(df, 48).orderBy("pos").collect()] == [48, 49]
    with pytest.raises(ValueError):
        P.slice_corpus(df, 50)
    with pytest.raises(ValueError):
        P.slice_corpus(df, 0, -1, 0)


def test_parsers(spark):
    rows = [
        ("PREDICTION IS YES", "yes", None),
        ("**Prediction is no**.", "no", None),
        ("Prediction is yes.\nPrediction is no.", "no", None),
        ("Prediction is ：1", None, "yes"),
        ("", None, None),
    ]
    df = spark.createDataFrame([(a,) for a, _, _ in rows], "t string")
    got = df.select(R.parse_yes_no(F.col("t")).alias("a"), R.parse_yes_no_or_digit(F.col("t")).alias("b")).collect()
    assert [r["a"] for r in got] == [r[1] for r in rows]
    assert [r["b"] for r in got] == ["yes", "no", "no", "yes", None]


def test_isclose_boundary_is_inclusive(spark):
    row = spark.sql("select 0.0D a, 1e-6D b, 1.1e-6D c").select(is_close(F.col("a"), F.col("b")), is_close(F.col("a"), F.col("c"))).first()
    assert tuple(row) == (True, False)


def test_empty_expected_is_never_retried(spark):
    df = spark.createDataFrame([(1, "", "Prediction is yes"), (2, "yes", "hm")], "_row_id bigint, output string, final string")
    judged = V.verdict(df, R.parse_yes_no)
    assert {r["_row_id"]: r["status"] for r in judged.collect()} == {1: V.EMPTY, 2: V.UNREADABLE}
    assert [r["_row_id"] for r in V.retry_candidates(judged).collect()] == [2]


def test_generation_stops_when_stalled(spark):
    calls = spark.sparkContext.accumulator(0)

    def never(batches, heat):
        for pdf in batches:
            calls.add(len(pdf))
            yield pdf[["_row_id"]].assign(raw="hm")

    corpus = spark.range(20).select(
        F.col("id").alias("_row_id"), F.lit("i").alias("instruction"), F.lit("t").alias("input"), F.lit("yes").alias("output")
    )
    done = V.generate_until(corpus, never, R.parse_yes_no)
    assert done.filter(F.col("status") == V.UNREADABLE).count() == 20
    assert calls.value == 20 * 3  # first pass and two reruns without progress


def test_third_label_only_in_predictions(spark):
    df = spark.createDataFrame([(0, 0), (1, 1), (1, 2)], "y_true int, y_pred int")
    row = M.classification_metrics(df).first()
    assert row["precision"] is None and row["accuracy"] == pytest.approx(2 / 3)
    assert M.confusion(df).count() == 9


def test_many_labels_need_no_grid(spark):
    n = 100_000
    df = spark.range(n).select(F.col("id").alias("target"), (F.col("id") + (F.col("id") % 2)).cast("string").alias("label"))
    scored = M.evaluate(df, lambda text: text.try_cast("bigint")).first()
    assert scored["accuracy"] == 0.5 and scored["confusion_matrix"] is None and scored["confusion_matrix_labels"] is None
    pairs = M.valid_predictions(df, lambda text: text.try_cast("bigint"))
    assert M.confusion(pairs).count() == 0 and M.confusion_counts(pairs).count() == n


def test_a_grid_at_its_limit_and_labels_by_name(spark):
    df = spark.createDataFrame([(0, "0"), (1, "2"), (2, "2"), (2, None)], "target int, label string")
    named = M.evaluate(df, lambda t: t.try_cast("int"), render_target=lambda y: F.when(y > 0, F.concat(F.lit("n"), y)), grid_labels=3).first()
    assert named["confusion_matrix_labels"] == ["0", "n1", "n2"] and named["missing_count"] == 1
    assert [list(r) for r in named["confusion_matrix"]] == [[1, 0, 0], [0, 0, 1], [0, 0, 1]]
    assert M.evaluate(df, lambda t: t.try_cast("int"), grid_labels=2).first()["confusion_matrix"] is None
    nothing = M.evaluate(df.limit(0), lambda t: t.try_cast("int")).first()
    assert nothing["accuracy"] is None and [list(r) for r in nothing["confusion_matrix"]] == [[0, 0], [0, 0]]


def test_unknown_names_are_errors():
    with pytest.raises(ValueError, match="adult"):
        table_spec("nope")
    with pytest.raises(ValueError):
        CorpusSpec(variant="nope")


def test_csv_with_missing_marks(spark, tmp_path):
    path = tmp_path / "adult.csv"
    path.write_text("age,workclass,income\n39,?,<=50K\nNA,Private,>50K\n")
    df = IO.read_table(spark, str(path), table_spec("adult"))
    spec = table_spec("adult")
    rows = project(df, spec).orderBy("_row_id").collect()
    assert [(r["_row_id"], r["age"], r["workclass"], r["income"]) for r in rows] == [(0, 39.0, "missing", "<=50K"), (1, None, "Private", ">50K")]
    assert task_spec("adult").instructions["zeroshot"].startswith("You are an income classifier. Based on")


def test_corpus_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"instruction": "i", "input": "x", "output": "y"}] * 2))
    (tmp_path / "adult_train_stats_full.json").write_text("{}")
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "b.json").write_text(json.dumps([{"instruction": "i", "input": "x", "output": "z"}]))
    assert IO.read_corpus(spark, str(tmp_path)).count() == 2
    assert IO.read_corpus(spark, str(tmp_path), recursive=True).count() == 3
    df = IO.read_corpus(spark, str(tmp_path)).select("instruction", "input", "output").withColumn("reason", F.lit("kept"))
    for name, write in (("c", IO.write_corpus), ("f", IO.write_filtered), ("p", IO.write_predictions), ("m", IO.write_metrics), ("t", IO.write_table)):
        write(df, str(tmp_path / name))
        assert (tmp_path / name).exists()
    assert IO.read_corpus(spark, str(tmp_path / "c"), lines=True).count() == 2


def test_output_log_drops_bad_lines(spark, tmp_path):
    (tmp_path / "log.json").write_text('{"_row_id": 1, "attempt": 1, "raw": "a"}\nnot json\n{"_row_id": 1, "attempt": 2, "raw": "b"}\n')
    rows = IO.read_outputs(spark, str(tmp_path / "log.json")).collect()
    assert [(r["_row_id"], r["raw"]) for r in rows] == [(1, "b")]


def test_shards_merge_newest_and_complain(spark):
    rows = [("a_mode_finetune_1_finetune_x_final.json", 1, 0, "p1"), ("a_mode_finetune_2_finetune_x_final.json", 1, 0, "p2")]
    df = spark.createDataFrame(rows, "file string, mtime int, pos bigint, output string")
    assert IO.merge_shards(df, 2).count() == 2
    with pytest.raises(ValueError, match="missing"):
        IO.merge_shards(df, 3)
    with pytest.raises(ValueError, match="no shard"):
        IO.merge_shards(df.withColumn("file", F.lit("x.json")), 1)


def test_full_prompt(spark):
    """The whole text of one prompt, written by hand."""
    rows = [(i, float(i % 4), "ab"[i % 2], float(i)) for i in range(8)]
    df = spark.createDataFrame(rows, "_row_id bigint, x double, c string, y double")
    splits = df.select("_row_id", F.when(F.col("_row_id") < 7, "train").otherwise("test").alias("split"))
    spec = TableSpec("t", "y", "regression", ("c",), ("x",), descriptions={"x": "A number."})
    task = numeric_task(2, lambda y: F.concat(F.lit("Value "), y.cast("string")), {"zeroshot": "Guess.\n\n"})
    out = build_corpus(df, splits, spec, task, CorpusSpec(with_stats=True, variant="mean_only", top_k=1, with_cases=True, n_cases=1))
    row = out.filter("split = 'test'").first()
    assert row["instruction"] == (
        "Guess.\n\nFeature explanations & Feature importance (high to low):\n- x: A number. You are also provided with dataset "
        "statistics and similar historical cases to assist your reasoning."
    )
    assert row["output"] == "7.00"
    assert row["input"] == (
        "=== Dataset Statistics (from training set, overall) ===\nTotal training samples: 7\n\nNumerical features:\n  x:\n    mean=1.29\n\n"
        "Categorical features (top 1 values):\n  c (2 unique):\n    a(57.1%)\n    current_sample=b(42.9%)\n\n"
        "=== Similar Historical Cases ===\nExample 1 (similarity: 1.000):\n  Features: x is 3.0. c is b\n  Ground truth: Value 3.0\n\n"
        "--- Current Sample Features ---\nx is 3.0. c is b"
    )


def test_statistics_ignore_other_splits(spark):
    df = spark.range(100).select(F.col("id").alias("_row_id"), F.col("id").cast("double").alias("x"), (F.col("id") % 2).cast("string").alias("y"))
    splits = df.select("_row_id", F.when(F.col("_row_id") % 5 == 0, "test").otherwise("train").alias("split"))
    spec, task = TableSpec("t", "y", "multiclass", (), ("x",)), task_spec("okcupid_stem")
    options = CorpusSpec(with_stats=True, per_group=True)
    moved = df.withColumn("x", F.when(F.col("_row_id") % 5 == 0, F.lit(1e6)).otherwise(F.col("x")))
    a = build_corpus(df, splits, spec, task, options).filter("split = 'train'").select("input")
    b = build_corpus(moved, splits, spec, task, options).filter("split = 'train'").select("input")
    assert a.exceptAll(b).isEmpty()


def test_quantiles_equal_sql_in_the_last_bit(spark):
    """A quartile on a rounding tie reads 7230.74 in SQL; the other way to interpolate gives 7230.73."""
    import duckdb

    df = spark.createDataFrame([(0, 7228.47), (0, 7231.49)], "g int, x double")
    got = exact_quantiles(df, ["g"], "x", [0.75, 1.0]).first()
    want = duckdb.connect().execute("select quantile_cont(x, [0.75, 1.0]) from (values (7228.47::double), (7231.49::double)) t(x)").fetchone()[0]
    assert [got["q0"], got["q1"]] == want and f"{got['q0']:.2f}" == "7230.74"
