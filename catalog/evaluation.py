"""Verdicts on responses, retries, scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import query, rounded, table
from catalog.text import STATUS_TASK
from corpusforge.functions import responses as R
from corpusforge.operators import metrics as M
from corpusforge.operators import verdicts as V
from corpusforge.session import shared_folder
from corpusforge.sources.tables import append_outputs, read_outputs
from corpusforge.streaming.verdicts import (
    current_counts,
    current_verdicts,
    status_changes,
    stream_verdicts,
    write_counts,
    write_verdicts,
)

# Expected labels and responses derived from orders: a right line, a bold line, two conflicting lines,
# no line, another label; every 23rd row has no expected label.
WANT = "case when o_orderkey % 23 = 0 then ' ' else lower(o_orderstatus) end"
OTHER = "case o_orderstatus when 'P' then 'f' when 'F' then 'o' else 'p' end"
RAW = f"""case o_orderkey % 5 when 0 then 'think</think>Prediction is ' || o_orderstatus || '.' when 1 then '**Prediction is ' || o_orderstatus || '**.'
    when 2 then 'Prediction is ' || {OTHER} || '.{{nl}}Prediction is ' || o_orderstatus || '.' when 3 then 'I do not know' else 'Prediction is ' || {OTHER} || '.' end"""
FIXTURE = f"""select o_orderkey as _row_id, 'file' || cast(o_custkey % 3 as string) as file, 'Do it.' as instruction,
    'cust is ' || cast(o_custkey as string) as input, {WANT} as output, {RAW} as raw from """
SPARK_FIXTURE = FIXTURE.replace("{nl}", "\\n")
STATUS = "case when _row_id % 23 = 0 then 'expected_empty' when _row_id % 5 = 3 then 'predicted_parse_fail' when _row_id % 5 = 4 then 'label_mismatch' else 'kept' end"
PREDICTED = f"case when o_orderkey % 5 = 4 then {OTHER} when o_orderkey % 5 <> 3 then lower(o_orderstatus) end"
BASE = f"""with j as (select o_orderkey as _row_id, 'file' || cast(o_custkey % 3 as string) as file, o_custkey, {WANT} as output,
    {PREDICTED} as predicted, o_orderstatus from orders), v as (select *, {STATUS} as status from j)"""


def judged(spark, d):
    rows = spark.sql(f"{SPARK_FIXTURE} parquet.`{d}/orders.parquet`")
    return V.verdict(V.split_responses(rows), STATUS_TASK.parse)


@query("verdict", f"{BASE} select _row_id, output, predicted, status from v")
def _(spark, d):
    return judged(spark, d).select("_row_id", "output", "predicted", "status")


@query("verdict_numeric", """select o_orderkey as _row_id, case when o_orderkey % 7 = 0 then 'label_mismatch' when o_orderkey % 11 = 0 then
    'predicted_parse_fail' else 'kept' end as status from orders""")
def _(spark, d):
    rows = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("_row_id"),
        F.format_number("o_totalprice", 2).alias("output"),
        F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("Prediction is $"), F.format_number(F.col("o_totalprice") + 1, 2)))
        .when(F.col("o_orderkey") % 11 == 0, "no idea")
        .otherwise(F.concat(F.lit("**Prediction is $"), F.format_number("o_totalprice", 2), F.lit("**.")))
        .alias("final"),
    )
    return V.verdict(rows, R.parse_numeric, regression=True).select("_row_id", "status")


@query("verdict_counts", f"""{BASE} select file, count(*) as total, count(*) filter (where status = 'kept') as kept,
    count(*) filter (where status <> 'kept') as filtered, count(*) filter (where status = 'expected_empty') as expected_empty,
    count(*) filter (where status = 'predicted_parse_fail') as predicted_parse_fail,
    count(*) filter (where status = 'label_mismatch') as label_mismatch from v group by rollup (file)""")
def _(spark, d):
    return V.verdict_counts(judged(spark, d))


@query("retry_candidates", f"{BASE} select _row_id, status from v where status in ('predicted_parse_fail', 'label_mismatch')")
def _(spark, d):
    return V.retry_candidates(judged(spark, d)).select("_row_id", "status")


@query("unparsed_predictions", f"{BASE} select _row_id from v where predicted is null")
def _(spark, d):
    return V.unparsed(judged(spark, d), "predicted").select("_row_id")


@query("filtered_records", f"""{BASE} select _row_id, status as reason, output as expected_raw_output,
    case when status = 'label_mismatch' then output end as expected_parsed_output,
    case when status = 'label_mismatch' then predicted end as predicted_parsed_output from v where status <> 'kept'""")
def _(spark, d):
    audit = V.filtered_records(judged(spark, d))
    return audit.drop("teacher_output_final", "teacher_output_merged")


@query("final_corpus", f"""{BASE} select _row_id, 'Reason.' as instruction, 'cust is ' || o_custkey as input,
    case _row_id % 5 when 0 then 'Prediction is ' || o_orderstatus || '.' when 1 then '**Prediction is ' || o_orderstatus || '**.'
    else 'Prediction is ' || {OTHER} || '.' || chr(10) || 'Prediction is ' || o_orderstatus || '.' end as output
    from v where status = 'kept'""")
def _(spark, d):
    return V.final_corpus(judged(spark, d), "Reason.")


def status_corpus(spark, d):
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("_row_id"), F.lit("Do it.").alias("instruction"), F.lit("text").alias("input"),
        F.lower("o_orderstatus").alias("output"),
    )


def answer(batches, heat):
    """A stand-in for a model: even rows answer at once, the rest only when asked again at some heat."""
    for pdf in batches:
        label = pdf["messages"].map(lambda m: m[1]["content"].rsplit(" is ", 1)[-1].strip("."))
        right = (pdf["_row_id"] % 2 == 0) | (heat > 0)
        raw = ("Prediction is " + label + ".").where(right & (pdf["_row_id"] % 50 != 1), "hm")
        yield pdf[["_row_id"]].assign(raw=raw)


@query("generate_until", f"""select o_orderkey as _row_id, case when o_orderkey % 50 = 1 then 0 when o_orderkey % 2 = 0 then 0 else 1 end as attempt0,
    case when o_orderkey % 50 = 1 then 'predicted_parse_fail' else 'kept' end as status from orders""")
def _(spark, d):
    done = V.generate_until(status_corpus(spark, d), answer, STATUS_TASK.parse)
    first = F.when(F.col("status") == V.KEPT, F.col("attempt")).otherwise(0)
    return done.select("_row_id", first.alias("attempt0"), "status")


def answer_new(batches, heat):
    """A stand-in that must not be asked about rows divisible by 4."""
    for pdf in answer(batches, heat):
        yield pdf.assign(raw=pdf["raw"].where(pdf["_row_id"] % 4 != 0, "asked twice"))


@query("generate_resumed", f"""select o_orderkey as _row_id, case when o_orderkey % 50 = 1 then 'predicted_parse_fail' else 'kept' end as status,
    case when o_orderkey % 4 = 0 then 'logged' when o_orderkey % 2 = 0 then 'first' when o_orderkey % 50 = 1 then 'open' else 'again' end as asked
    from orders""")
def _(spark, d):
    corpus = status_corpus(spark, d)
    right = F.concat(F.lit("Prediction is "), "output", F.lit("."))
    known = corpus.filter("_row_id % 4 = 0").select("_row_id", F.lit(0).alias("attempt"), right.alias("raw"))
    path = response_log(spark, known)
    V.generate_until(corpus, answer_new, STATUS_TASK.parse, log=path)
    done = V.verdict(V.split_responses(read_outputs(spark, path)).join(corpus, "_row_id"), STATUS_TASK.parse)
    asked = F.when(F.col("_row_id") % 4 == 0, "logged").when(F.col("status") != V.KEPT, "open").when(F.col("attempt") == 0, "first").otherwise("again")
    return done.select("_row_id", "status", asked.alias("asked"))


def answer_wrong(batches, heat):
    """A stand-in that always names a label, often a wrong one, except where it is first asked about multiples of 3."""
    for pdf in batches:
        named = (heat > 0) | (pdf["_row_id"] % 3 != 0)
        yield pdf[["_row_id"]].assign(raw=named.map({True: "Prediction is p.", False: "well"}))


@query("predict_until_parsed", """select o_orderkey as _row_id, case when o_orderkey % 3 = 0 then 1 else 0 end as attempt, 'p' as predicted,
    case when o_orderstatus = 'P' then 'kept' else 'label_mismatch' end as status from orders""")
def _(spark, d):
    done = V.generate_until(status_corpus(spark, d), answer_wrong, STATUS_TASK.parse, failures=V.unparsed_verdicts)
    return done.select("_row_id", "attempt", "predicted", "status")


# ---------------------------------------------------------------- scores

PRED = """select o_orderkey as "index", {t} as target, case when o_orderkey % 29 = 0 then null when o_orderkey % 31 = 0 then 'nonsense'
    else case {p} when 0 then 'p' when 1 then 'f' else 'o' end end as label from orders"""
T3 = "case o_orderstatus when 'P' then 0 when 'F' then 1 else 2 end"
P3 = f"case when o_orderkey % 4 = 0 then ({T3} + 1) % 3 else {T3} end"
T2 = "case when o_orderstatus = 'P' then 1 else 0 end"
P2 = f"case when o_orderkey % 4 = 0 then 1 - ({T2}) else {T2} end"


def predictions_sql(t: str, p: str) -> str:
    return f"""with y as (select {t} as y_true, {p} as y_pred from orders where o_orderkey % 29 <> 0 and o_orderkey % 31 <> 0)"""


def predictions(spark, d, t, p):
    sql = PRED.format(t=t, p=p).replace('"index"', "index").replace("from orders", f"from parquet.`{d}/orders.parquet`")
    return spark.sql(sql)


PER = """, l as (select y_true as label from y union select y_pred from y),
    p as (select label, (select count(*) from y where y_true = label) as support, (select count(*) from y where y_pred = label) as said,
          (select count(*) from y where y_true = label and y_pred = label) as hit from l),
    q as (select *, case when said = 0 then 0 else hit / said end as precision, case when support = 0 then 0 else hit / support end as recall,
          case when support + said = 0 then 0 else 2 * hit / (support + said) end as f1 from p)"""
MCC = """(sum(hit)::double * sum(support) - sum(support::double * said)) /
    sqrt((sum(support)::double * sum(support) - sum(said::double * said)) * (sum(support)::double * sum(support) - sum(support::double * support)))"""


def scores_sql(binary: bool) -> str:
    b = lambda m: f"max(case when label = 1 then {m} end)" if binary else "cast(null as double)"
    return f"""select round(sum(hit) / sum(support), 6) as accuracy, round(avg(recall), 6) as balanced_accuracy,
    round({b('precision')}, 6) as precision, round({b('recall')}, 6) as recall, round({b('f1')}, 6) as f1,
    round(avg(precision), 6) as precision_macro, round(avg(recall), 6) as recall_macro, round(avg(f1), 6) as f1_macro,
    round({MCC}, 6) as mcc from q"""


def pairs(spark, d, t=T3, p=P3):
    return M.valid_predictions(predictions(spark, d, t, p), STATUS_TASK.to_target)


@query("confusion_matrix", predictions_sql(T3, P3) + """ select a.v as y_true, b.v as y_pred, (select count(*) from y where y_true = a.v and y_pred = b.v)
    as cnt from (select unnest([0, 1, 2])::bigint as v) a, (select unnest([0, 1, 2])::bigint as v) b""")
def _(spark, d):
    return M.confusion(pairs(spark, d))


@query("metrics_multiclass", predictions_sql(T3, P3) + PER + scores_sql(False))
def _(spark, d):
    return rounded(M.classification_metrics(pairs(spark, d)))


@query("metrics_binary", predictions_sql(T2, P2) + PER + scores_sql(True))
def _(spark, d):
    return rounded(M.classification_metrics(pairs(spark, d, T2, P2)))


@query("metrics_report", predictions_sql(T3, P3) + PER + """ select cast(label as varchar) as label, round(precision, 6) as precision,
    round(recall, 6) as recall, round(f1, 6) as f1, support from q union all
    select 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support)::bigint from q union all
    select 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
    round(sum(f1 * support) / sum(support), 6), sum(support)::bigint from q""")
def _(spark, d):
    return rounded(M.classification_report(pairs(spark, d)))


@query("metrics_regression", """with y as (select o_totalprice as y, o_totalprice + (o_custkey - 750) * 10.0 as p from orders)
    select round(sqrt(avg((y - p) * (y - p))), 4) as rmse, round(avg((y - p) * (y - p)), 2) as mse, round(avg(abs(y - p)), 4) as mae,
    round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(y)), 6) as r2 from y""")
def _(spark, d):
    y = table(spark, d, "orders").select(
        F.col("o_totalprice").alias("y_true"), (F.col("o_totalprice") + (F.col("o_custkey") - 750) * 10.0).alias("y_pred")
    )
    return rounded(M.regression_metrics(y), 4, mse=2, r2=6)


@query("missing_count", "select count(*) as missing_count from orders where o_orderkey % 29 = 0 or o_orderkey % 31 = 0")
def _(spark, d):
    return M.missing_count(predictions(spark, d, T3, P3), STATUS_TASK.to_target)


@query("label_distribution", f"select label, count(*) as cnt from ({PRED.format(t=T3, p=P3)}) where label is not null group by 1")
def _(spark, d):
    return M.label_distribution(predictions(spark, d, T3, P3))


@query("eval_targets", """select o_orderkey as _row_id, case when o_orderkey % 3 = 2 then null when o_orderstatus = 'P' then 0
    when o_orderstatus = 'F' then 1 else 2 end as target from orders""")
def _(spark, d):
    out = F.when(F.col("o_orderkey") % 3 == 0, F.lower("o_orderstatus")).when(
        F.col("o_orderkey") % 3 == 1, F.concat(F.lit("So. Prediction is "), "o_orderstatus", F.lit("."))
    ).otherwise("?")
    corpus = table(spark, d, "orders").select(F.col("o_orderkey").alias("_row_id"), out.alias("output"))
    return M.eval_frame(corpus, STATUS_TASK.to_target, STATUS_TASK.parse).select("_row_id", "target")


@query("evaluate_binary", predictions_sql(T2, P2) + PER + f""", s as ({scores_sql(True)}) select s.*,
    (select count(*) from y where y_true = 0 and y_pred = 0) as tn, (select count(*) from y where y_true = 0 and y_pred = 1) as fp,
    (select count(*) from y where y_true = 1 and y_pred = 0) as fn, (select count(*) from y where y_true = 1 and y_pred = 1) as tp,
    (select count(*) from orders where o_orderkey % 29 = 0 or o_orderkey % 31 = 0) as missing_count from s""")
def _(spark, d):
    scored = M.evaluate(predictions(spark, d, T2, P2), STATUS_TASK.to_target)
    return rounded(scored.drop("confusion_matrix", "confusion_matrix_labels"))


@query("evaluate_named_labels", predictions_sql(T3, P3) + """, n as (select * from (values (0, 'label 0'), (1, '1'), (2, 'label 2')) n(v, name))
    select a.v::bigint as place, a.name as name, string_agg((select count(*) from y where y_true = a.v and y_pred = b.v), ',' order by b.v) as cells
    from n a, n b group by 1, 2""")
def _(spark, d):
    names = lambda y: F.when(y != 1, F.concat(F.lit("label "), y.cast("string")))
    scored = M.evaluate(predictions(spark, d, T3, P3), STATUS_TASK.to_target, render_target=names)
    both = scored.select(F.posexplode(F.arrays_zip("confusion_matrix_labels", "confusion_matrix")).alias("place", "_e"))
    cells = F.array_join(F.transform("_e.confusion_matrix", lambda n: n.cast("string")), ",")
    return both.select(F.col("place").cast("bigint").alias("place"), F.col("_e.confusion_matrix_labels").alias("name"), cells.alias("cells"))


MANY = """with y as (select o_custkey as y_true, case when o_orderkey % 4 = 0 then o_custkey + 1 else o_custkey end as y_pred from orders)"""


def many_labels(spark, d):
    said = F.when(F.col("o_orderkey") % 4 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey"))
    return table(spark, d, "orders").select(F.col("o_custkey").alias("y_true"), said.alias("y_pred"))


@query("metrics_many_labels", MANY + """, t as (select y_true as label, count(*) as support, count(*) filter (where y_pred = y_true) as hit from y group by 1),
    g as (select y_pred as label, count(*) as said from y group by 1),
    p as (select label, coalesce(support, 0) as support, coalesce(said, 0) as said, coalesce(hit, 0) as hit from t full join g using (label)),
    q as (select *, case when said = 0 then 0 else hit / said end as precision, case when support = 0 then 0 else hit / support end as recall,
          case when support + said = 0 then 0 else 2 * hit / (support + said) end as f1 from p)"""
    + scores_sql(False).replace("avg(recall), 6) as balanced_accuracy", "avg(recall) filter (where support > 0), 6) as balanced_accuracy"))
def _(spark, d):
    return rounded(M.classification_metrics(many_labels(spark, d)))


@query("confusion_counts", MANY + " select y_true, y_pred, count(*) as cnt from y group by 1, 2")
def _(spark, d):
    return M.confusion_counts(many_labels(spark, d))


@query("evaluate_nothing_valid", """select cast(null as double) as rmse, cast(null as double) as mse, cast(null as double) as mae,
    cast(null as double) as r2, (select count(*) from orders) as missing_count""")
def _(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_totalprice").alias("target"), F.lit(None).cast("string").alias("label"))
    return M.evaluate(rows, lambda text: text.try_cast("double"), regression=True)


# ---------------------------------------------------------------- response log and streams


def corpus_of(spark, d):
    rows = spark.sql(f"{SPARK_FIXTURE} parquet.`{d}/orders.parquet`")
    return rows.select("_row_id", "file", "instruction", "input", "output"), rows.select("_row_id", F.lit(1).alias("attempt"), "raw")


def response_log(spark, outputs) -> str:
    import uuid

    path = f"{shared_folder(spark)}/log-{uuid.uuid4().hex}"
    append_outputs(outputs.repartition(4), path)
    return path


@query("output_log_roundtrip", f"select o_orderkey as _row_id, 2 as attempt, 'again ' || o_orderstatus as raw from orders")
def _(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("_row_id"), "o_orderstatus")
    path = response_log(spark, o.select("_row_id", F.lit(1).alias("attempt"), F.col("o_orderstatus").alias("raw")))
    append_outputs(o.select("_row_id", F.lit(2).alias("attempt"), F.concat(F.lit("again "), "o_orderstatus").alias("raw")), path)
    return read_outputs(spark, path)


def run_stream(df, mode: str, folder: str, name: str):
    stream = (
        df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", folder).trigger(availableNow=True)
    ).start()
    stream.awaitTermination()


def rerun_log(spark, d):
    """A log in which rows divisible by 3 failed at first, and one line is broken; and the corpus."""
    corpus, outputs = corpus_of(spark, d)
    failed = outputs.filter("_row_id % 3 = 0").select("_row_id", F.lit(0).alias("attempt"), F.lit("no answer").alias("raw"))
    path = response_log(spark, outputs.unionByName(failed))
    spark.createDataFrame([('{"_row_id": 1, "attempt": 9, "raw": "cut o',)], "value string").write.mode("append").text(path)
    return corpus, path


def judged_by_stream(spark, d):
    corpus, path = rerun_log(spark, d)
    verdicts = stream_verdicts(spark, path, corpus, STATUS_TASK.parse, files_per_trigger=2)
    write_verdicts(verdicts.select("_row_id", "attempt", "predicted", "status"), f"{path}-out", f"{path}-state").awaitTermination()
    return current_verdicts(spark, f"{path}-out")


@query("stream_verdicts", f"{BASE} select _row_id, predicted, status from v")
def _(spark, d):
    return judged_by_stream(spark, d).select("_row_id", "predicted", "status")


@query("stream_verdict_counts", f"{BASE} select status, count(*) as cnt from v group by 1")
def _(spark, d):
    """Running counters of a stream, corrected as the second attempts of failed rows arrive."""
    corpus, path = rerun_log(spark, d)
    verdicts = stream_verdicts(spark, path, corpus, STATUS_TASK.parse, files_per_trigger=3)
    write_counts(status_changes(verdicts), f"{path}-counts", f"{path}-state").awaitTermination()
    return current_counts(spark, f"{path}-counts").select("status", "cnt")


@query("log_verdicts", f"{BASE} select _row_id, predicted, status from v")
def _(spark, d):
    corpus, path = rerun_log(spark, d)
    outputs = read_outputs(spark, path)
    return V.verdict(V.split_responses(outputs).join(corpus, "_row_id"), STATUS_TASK.parse).select("_row_id", "predicted", "status")
