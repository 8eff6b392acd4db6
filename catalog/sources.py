"""Sources and sinks as round trips: written from the given tables, then read again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog.base import query, table
from corpusforge.session import shared_folder
from corpusforge.sources import tables as IO
from corpusforge.spec import MULTICLASS, TableSpec


def folder(spark) -> str:
    return f"{shared_folder(spark)}/trip-{uuid.uuid4().hex}"


CSV_SPEC = TableSpec("orders_csv", "o_orderstatus", MULTICLASS, ("o_orderpriority",), ("o_totalprice",))
PRIORITY = "case when o_orderkey % 17 = 0 then 'NA' when o_orderkey % 19 = 0 then '' else o_orderpriority end"


@query("csv_scan", f"""select o_orderkey - 1 as _row_id, o_orderkey % 1000 as k, case when o_orderkey % 13 <> 0 then o_totalprice end
    as o_totalprice, nullif(nullif({PRIORITY}, 'NA'), '') as o_orderpriority, o_orderstatus
    from (select * replace (row_number() over (order by o_orderkey) as o_orderkey), o_orderkey as old from orders)""")
def _(spark, d):
    from corpusforge.operators.ranking import dense_positions

    path = folder(spark)
    rows = dense_positions(table(spark, d, "orders"), "o_orderkey").withColumn("o_orderkey", F.col("pos") + 1)
    shown = rows.select(
        F.col("o_orderkey").alias("_at"),
        (F.col("o_orderkey") % 1000).alias("k"),
        F.when(F.col("o_orderkey") % 13 == 0, F.lit("n/a")).otherwise(F.col("o_totalprice").cast("string")).alias("o_totalprice"),
        F.expr(PRIORITY).alias("o_orderpriority"),
        "o_orderstatus",
    )
    IO.write_table(shown.repartitionByRange(6, "_at").sortWithinPartitions("_at").drop("_at"), path)
    back = IO.read_table(spark, path, CSV_SPEC)
    return back.withColumn("k", F.col("k").cast("bigint"))


CORPUS = """select c_custkey as _row_id, 'Do "it".' as instruction, 'line one' || chr(10) || c_name as input, c_mktsegment as output,
    case c_custkey % 3 when 0 then 'test' else 'train' end as split from """


@query("corpus_roundtrip", f"select instruction, input, output, split from ({CORPUS} customer)")
def _(spark, d):
    path = folder(spark)
    IO.write_corpus(spark.sql(f"{CORPUS} parquet.`{d}/customer.parquet`").drop("_row_id"), path, by_split=True)
    found = IO.read_corpus(spark, path, lines=True, recursive=True)
    split = F.regexp_extract("path", "split=([a-z]+)", 1).alias("split")
    return found.select("instruction", "input", "output", split)


@query("corpus_positions", """select part, row_number() over (partition by part order by c_custkey) - 1 as pos, c_name as output
    from (select *, c_custkey % 4 as part from customer)""")
def _(spark, d):
    path = folder(spark)
    rows = table(spark, d, "customer").withColumn("part", F.col("c_custkey") % 4)
    lines = rows.select("part", F.lit("i").alias("instruction"), F.lit("x").alias("input"), F.col("c_name").alias("output"), "c_custkey")
    ordered = lines.repartition(3, "part").sortWithinPartitions("part", "c_custkey").drop("c_custkey")
    ordered.write.partitionBy("part").json(path)
    spark.createDataFrame([('{"mean": 1}',)], "value string").write.text(f"{path}/part=0/train_stats.json")
    found = IO.read_corpus(spark, path, lines=True, recursive=True)
    part = F.regexp_extract("path", "part=([0-9]+)", 1).cast("bigint").alias("part")
    return found.select(part, "pos", "output")


@query("filtered_sink", """select c_mktsegment as reason, c_name as expected_raw_output from customer where c_custkey % 2 = 0""")
def _(spark, d):
    path = folder(spark)
    rows = table(spark, d, "customer").filter("c_custkey % 2 = 0")
    IO.write_filtered(rows.select(F.col("c_mktsegment").alias("reason"), F.col("c_name").alias("expected_raw_output")), path)
    return spark.read.json(path).select("reason", "expected_raw_output")


@query("prediction_sink", """select 'csv' as kind, 'a "b", ' || c_name as input, c_custkey as index, case when c_custkey % 9 <> 0
    then c_mktsegment end as label from customer union all select 'json', 'a "b", ' || c_name, c_custkey, case when c_custkey % 9 <> 0
    then c_mktsegment end from customer""")
def _(spark, d):
    path = folder(spark)
    rows = table(spark, d, "customer").select(
        F.concat(F.lit('a "b", '), "c_name").alias("input"),
        F.col("c_custkey").alias("index"),
        F.when(F.col("c_custkey") % 9 != 0, F.col("c_mktsegment")).alias("label"),
    )
    IO.write_predictions(rows, path)
    schema = "input string, index bigint, label string"
    flat = spark.read.schema(schema).option("header", True).option("escape", '"').csv(f"{path}/csv")
    full = spark.read.schema(schema).json(f"{path}/json")
    return flat.select(F.lit("csv").alias("kind"), "*").unionByName(full.select(F.lit("json").alias("kind"), "*"))


@query("metrics_sink", """select c_mktsegment as label, count(*) as support, cast(null as double) as auc, 'orders' as dataset
    from customer group by 1""")
def _(spark, d):
    path = folder(spark)
    rows = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("label")).agg(
        F.count(F.lit(1)).alias("support"), F.lit(None).cast("double").alias("auc")
    )
    IO.write_metrics(rows, path, dataset="orders")
    return spark.read.schema("label string, support bigint, auc double, dataset string").json(path)


@query("table_sink", "select c_custkey, 'x, \"' || c_name as c_name, c_acctbal from customer")
def _(spark, d):
    path = folder(spark)
    rows = table(spark, d, "customer").select("c_custkey", F.concat(F.lit('x, "'), "c_name").alias("c_name"), "c_acctbal")
    IO.write_table(rows, path)
    return spark.read.schema("c_custkey bigint, c_name string, c_acctbal double").option("header", True).option("escape", '"').csv(path)


@query("shard_merge", """select c_mktsegment as prefix, 'finetune' as mode, 'finetune_a_final.json' as tail, c_custkey % 3 + 1 as part,
    row_number() over (partition by c_mktsegment, c_custkey % 3 order by c_custkey) - 1 as pos, c_name as output from customer""")
def _(spark, d):
    """Two versions of every shard, each written in one go; the newer one has other texts."""
    path = folder(spark)
    name = F.concat("c_mktsegment", F.lit("_mode_finetune_"), (F.col("c_custkey") % 3 + 1).cast("string"), F.lit("_finetune_a_final.json"))
    rows = table(spark, d, "customer").select(
        name.alias("shard"), F.lit("i").alias("instruction"), F.lit("x").alias("input"), F.col("c_name").alias("output"), "c_custkey"
    )
    IO.write_shards(rows.withColumn("output", F.concat(F.lit("old "), "output")), path, 0, ["c_custkey"])
    IO.write_shards(rows, path, 1, ["c_custkey"])
    return IO.merge_written_shards(spark, path, 3).select("prefix", "mode", "tail", "part", "pos", "output")
