"""Statistics over training rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import SPECS, base, base_sql, cat_sql, query, rounded, split_sql, table, train_of, train_sql, union_all
from corpusforge.operators import stats as S
from corpusforge.operators.quantiles import exact_quantiles
from corpusforge.operators.retrieval import prefix_counts, scale_params
from corpusforge.operators.splits import stratified_split
from corpusforge.session import materialize

NUMBERS = """count(x) as n, count(*) - count(x) as n_missing, round(avg(x), 4) as mean, round(stddev_samp(x), 4) as std,
    round(quantile_cont(x, 0.25), 4) as p25, round(quantile_cont(x, 0.5), 4) as p50, round(quantile_cont(x, 0.75), 4) as p75,
    min(x) as min, max(x) as max"""


def num_sql(source: str, columns: list[str], by: str = "") -> str:
    lead = f"{by}, " if by else ""
    parts = [f"select {lead}'{c}' as col, cast({c} as double) as x from {source}" for c in columns]
    group = f"{lead}col"
    return f"select {group}, {NUMBERS} from ({' union all '.join(parts)}) group by {group} having count(x) > 0"


def cat_sql_top(source: str, columns: list[str], by: str = "", k: int | None = 5) -> str:
    lead = f"{by}, " if by else ""
    parts = [
        f"select {lead}_row_id, '{c}' as col, {cat_sql(c)} as value, ({c} is null or {c} = '?') as gone from {source}" for c in columns
    ]
    keep = f"where rnk <= {k}" if k else ""
    return f"""select * from (select {lead}col, value, count(*) as cnt,
        cast(sum(count(*)) over (partition by {lead}col) as bigint) as total,
        round(count(*) / sum(count(*)) over (partition by {lead}col), 6) as prop,
        row_number() over (partition by {lead}col order by count(*) desc, min(_row_id), value) as rnk,
        count(*) over (partition by {lead}col) as n_unique,
        cast(sum(count(*) filter (where gone)) over (partition by {lead}col) as bigint) as n_missing
        from ({' union all '.join(parts)}) group by {lead}col, value) {keep}"""


def whole(df):
    return rounded(df, 4, prop=6, share=6, rate=6)


@query("agg_num_stats", f"{train_sql('orders_status', 'status')} {num_sql('train', ['price', 'cust'])}")
def _(spark, d):
    return whole(S.num_stats(train_of(base(spark, d, "orders_status"), "status"), ["price", "cust"]))


@query("agg_num_stats_mean_std", f"""{train_sql('orders_status', 'status')}
    select col, n, n_missing, mean, std from ({num_sql('train', ['price', 'cust'])})""")
def _(spark, d):
    return whole(S.num_stats(train_of(base(spark, d, "orders_status"), "status"), ["price", "cust"], [], "mean_std"))


@query("agg_cat_topk", f"{train_sql('event_type', 'event_type')} {cat_sql_top('train', ['user_id'])}")
def _(spark, d):
    return whole(S.cat_stats(train_of(base(spark, d, "event_type"), "event_type"), ["user_id"]))


@query("agg_cat_all", f"{train_sql('orders_status', 'status')} {cat_sql_top('train', ['priority', 'yr'], k=None)}")
def _(spark, d):
    return whole(S.cat_stats(train_of(base(spark, d, "orders_status"), "status"), ["priority", "yr"], None))


@query("agg_cat_counts", f"""select 'priority' as col, {cat_sql('priority')} as value, count(*) as cnt, min(_row_id) as first_row,
    count(*) filter (where priority is null or priority = '?') as n_missing from ({base_sql('orders_status')}) group by 2""")
def _(spark, d):
    return S.cat_counts(base(spark, d, "orders_status"), ["priority"])


@query("agg_target_dist", f"""{train_sql('customer_segment', 'segment')}
    select segment as label, count(*) as cnt, round(count(*) / sum(count(*)) over (), 6) as prop, min(_row_id) as first_row
    from train group by 1""")
def _(spark, d):
    return rounded(S.target_dist(train_of(base(spark, d, "customer_segment"), "segment"), "segment"))


@query("agg_first_seen_classes", f"""select label, row_number() over (order by first_row) as position from
    (select event_type as label, min(_row_id) as first_row from ({base_sql('event_type')}) group by 1)""")
def _(spark, d):
    from pyspark.sql import Window

    dist = S.target_dist(base(spark, d, "event_type"), "event_type")
    return dist.select("label", F.row_number().over(Window.orderBy("first_row")).cast("bigint").alias("position"))


@query("agg_class_num_stats", f"""with base as ({base_sql('line_flag')})
    {num_sql('base', ['quantity', 'extendedprice', 'discount', 'tax'], 'returnflag').replace('select returnflag, col,',
    'select returnflag as label, col,', 1)}""")
def _(spark, d):
    return whole(S.class_num_stats(base(spark, d, "line_flag"), SPECS["line_flag"]))


@query("agg_class_cat_topk", f"""{train_sql('orders_status', 'status')}
    select status as label, * exclude (status) from ({cat_sql_top('train', ['priority', 'yr'], 'status')})""")
def _(spark, d):
    return whole(S.class_cat_stats(train_of(base(spark, d, "orders_status"), "status"), SPECS["orders_status"]))


BIN_SQL = f"""with raw as ({base_sql('orders_price')}), e as (select quantile_cont(price, [0.0, 0.25, 0.5, 0.75, 1.0]) as q from raw),
    base as (select raw.*, cast(1 + (price > q[2])::int + (price > q[3])::int + (price > q[4])::int as bigint) as bin from raw, e)"""


@query("agg_bin_num_stats", f"{BIN_SQL} {num_sql('base', ['cust'], 'bin')}")
def _(spark, d):
    return whole(S.bin_num_stats(base(spark, d, "orders_price"), SPECS["orders_price"]))


@query("agg_bin_cat_topk", f"{BIN_SQL} {cat_sql_top('base', ['priority', 'status'], 'bin')}")
def _(spark, d):
    return whole(S.bin_cat_stats(base(spark, d, "orders_price"), SPECS["orders_price"]))


@query("agg_target_bins", f"""{BIN_SQL} select bin, round(q[bin], 4) as lo, round(q[bin + 1], 4) as hi, (bin - 1) * 25.0::double as pct_lo,
    bin * 25.0::double as pct_hi, count(*) as cnt, round(count(*) / (select count(*) from base), 6) as prop from base, e group by bin, q""")
def _(spark, d):
    return whole(S.target_bins(base(spark, d, "orders_price"), "price"))


@query("agg_quantiles", """select user_id, count(value) as n, round(quantile_cont(value, 0.1), 6) as q0,
    round(quantile_cont(value, 0.5), 6) as q1, round(quantile_cont(value, 0.99), 6) as q2 from events group by 1""")
def _(spark, d):
    return rounded(exact_quantiles(table(spark, d, "events").select("user_id", "value"), ["user_id"], "value", [0.1, 0.5, 0.99]))


@query("agg_inline_num", f"""{train_sql('customer_segment', 'segment')}
    {num_sql('train', ['acctbal'], 'segment').replace('select segment, col,', 'select segment as label, col,', 1)}""")
def _(spark, d):
    return whole(S.inline_num(train_of(base(spark, d, "customer_segment"), "segment"), SPECS["customer_segment"]))


@query("agg_inline_cat_rates", f"""{train_sql('customer_segment', 'segment')},
    v as (select distinct nation from train), l as (select segment, count(*) as total from train group by 1),
    c as (select nation, segment, count(*) as cnt from train group by 1, 2)
    select 'nation' as col, v.nation as value, l.segment as label, round(coalesce(c.cnt, 0) / l.total, 6) as rate
    from v cross join l left join c on c.nation = v.nation and c.segment = l.segment""")
def _(spark, d):
    return whole(S.inline_cat_rates(train_of(base(spark, d, "customer_segment"), "segment"), SPECS["customer_segment"]))


@query("agg_regression_cat_rates", f"""with base as ({base_sql('part_price')})
    select col, value, prop as rate, rnk from ({cat_sql_top('base', ['type', 'brand'], k=None)})""")
def _(spark, d):
    return rounded(S.regression_cat_rates(base(spark, d, "part_price"), SPECS["part_price"]))


@query("agg_rollup_prefix", f"""select {cat_sql('priority')} as priority, yr, status, count(*) as cnt,
    cast(3 - bit_count(grouping_id({cat_sql('priority')}, yr, status)) as bigint) as depth
    from ({base_sql('orders_status')}) group by rollup ({cat_sql('priority')}, yr, status)""")
def _(spark, d):
    return prefix_counts(base(spark, d, "orders_status"), ["priority", "yr", "status"])


@query("agg_scale_params", f"""{train_sql('orders_status', 'status')} select round(avg(price), 4) as price_mean,
    round(stddev_samp(price), 4) as price_std, round(avg(cust), 4) as cust_mean, round(stddev_samp(cust), 4) as cust_std from train""")
def _(spark, d):
    return rounded(scale_params(train_of(base(spark, d, "orders_status"), "status"), ["price", "cust"]), 4)


@query("agg_n_classes", f"""select count(distinct priority) + max(case when priority is null then 1 else 0 end) as n_classes
    from ({base_sql('orders_status')})""")
def _(spark, d):
    return S.n_classes(base(spark, d, "orders_status"), "priority")


@query("agg_split_report", f"""with base as ({base_sql('customer_segment')}), {split_sql('base', 'segment')},
    j as (select s.split, b.segment as label from base b join splits s on b._row_id = s._row_id)
    select split, label, count(*) as cnt, round(count(*) / sum(count(*)) over (partition by split), 6) as share from j group by 1, 2
    union all select split, null, count(*), round(count(*) / sum(count(*)) over (), 6) from j group by 1""")
def _(spark, d):
    df = base(spark, d, "customer_segment")
    return rounded(S.split_report(df, stratified_split(df, "segment"), "segment"))


@query("agg_split_target_report", f"""with base as ({base_sql('orders_price')}), {split_sql('base', 'status')}
    select s.split, count(*) as n, min(price) as min, max(price) as max, round(avg(price), 4) as mean,
    round(median(price), 4) as median from base b join splits s on b._row_id = s._row_id group by 1""")
def _(spark, d):
    df = base(spark, d, "orders_price")
    return rounded(S.split_target_report(df, stratified_split(df, "status"), "price"), 4)


@query("agg_infer_task", """select 'orders.status' as source, 'classification' as task union all
    select 'orders.price', 'regression' union all select 'labels.toxic', case when (select count(distinct toxic) from labels) <= 20
    then 'classification' else 'regression' end union all select 'part.size',
    case when (select count(distinct p_size) from part) <= 20 then 'classification' else 'regression' end""")
def _(spark, d):
    from catalog.base import union_all

    cases = [
        ("orders.status", table(spark, d, "orders"), "o_orderstatus"),
        ("orders.price", table(spark, d, "orders"), "o_totalprice"),
        ("labels.toxic", table(spark, d, "labels"), "toxic"),
        ("part.size", table(spark, d, "part"), "p_size"),
    ]
    return union_all([S.infer_task(df, c).select(F.lit(n).alias("source"), "task") for n, df, c in cases])


@query("stats_document", f"""{train_sql('customer_segment', 'segment')}, v as (select nation, count(*) as cnt, row_number() over
    (order by count(*) desc, min(_row_id)) as rnk from train group by 1), n as (select count(*)::double as n from train),
    s as (select count(acctbal)::double as n, (count(*) - count(acctbal))::double as n_missing, avg(acctbal) as mean, stddev_samp(acctbal) as std,
        quantile_cont(acctbal, 0.25) as p25, quantile_cont(acctbal, 0.5) as p50, quantile_cont(acctbal, 0.75) as p75,
        min(acctbal) as min, max(acctbal) as max from train)
    select 'num' as part, 'acctbal' as name, stat as item, round(x, 6) as value from s unpivot (x for stat in (n, n_missing, mean, std, p25, p50, p75, min, max))
    union all select 'cat', 'nation', nation, cnt from v where rnk <= 5
    union all select 'cat_share', 'nation', nation, round(cnt / n, 6) from v, n where rnk <= 5
    union all select 'cat_unique', 'nation', 'n', count(*) from v
    union all select 'target', 'segment', segment, count(*) from train group by 3
    union all select 'target_share', 'segment', segment, round(count(*) / any_value(n), 6) from train, n group by 3
    union all select 'rows', 'train', 'n', n from n""")
def _(spark, d):
    train, spec = train_of(base(spark, d, "customer_segment"), "segment"), SPECS["customer_segment"]
    document = materialize(
        S.stats_document(S.num_stats(train, spec.num_cols), S.cat_stats(train, spec.cat_cols), S.target_dist(train, spec.target))
    )

    numbers = document.select(F.explode("num_stats").alias("name", "s"))
    stats = [f for f in document.schema["num_stats"].dataType.valueType.names]
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("item"), F.col(f"s.{c}").cast("double").alias("value")) for c in stats])).alias("e")
    cats = document.select(F.explode("cat_stats").alias("name", "s"))
    top = cats.select("name", F.explode(F.arrays_zip("s.top_values", "s.top_counts", "s.top_proportions")).alias("e"))
    target = document.select(F.lit("segment").alias("name"), "target_dist", "target_proportions")
    parts = [
        numbers.select(F.lit("num").alias("part"), "name", each).select("part", "name", "e.item", "e.value"),
        top.select(F.lit("cat"), "name", "e.top_values", "e.top_counts"),
        top.select(F.lit("cat_share"), "name", "e.top_values", "e.top_proportions"),
        cats.select(F.lit("cat_unique"), "name", F.lit("n"), "s.n_unique"),
        target.select(F.lit("target"), "name", F.explode("target_dist")),
        target.select(F.lit("target_share"), "name", F.explode("target_proportions")),
        document.select(F.lit("rows"), F.lit("train"), F.lit("n"), "n_train"),
    ]
    named = [x.toDF("part", "name", "item", "value").withColumn("value", F.col("value").cast("double")) for x in parts]
    return rounded(union_all(named))
