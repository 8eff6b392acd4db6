"""Cleaning, lookups, splits and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import SPECS, base, base_sql, cat_sql, query, rounded, split_sql, table, train_of, train_sql
from corpusforge.functions.clinical import age_bin3, icd9_group
from corpusforge.functions.numbers import bin_index, coerce_01, fmt_fixed, fmt_pct, is_close, parse_number, py_str
from corpusforge.operators import cleaning as C
from corpusforge.operators import joins as J
from corpusforge.operators import splits as P
from corpusforge.operators.stats import sample_freq
from corpusforge.sources import tables as IO
from corpusforge.spec import project
from corpusforge.tasks import label_ids


@query("project_table", f"""select _row_id, price, cust, {cat_sql('priority')} as priority, yr, status
    from ({base_sql('orders_status')})""")
def _(spark, d):
    return project(base(spark, d, "orders_status"), SPECS["orders_status"])


@query("clean_missing", f"""select _row_id, {cat_sql('priority')} as priority, price from ({base_sql('orders_status')})""")
def _(spark, d):
    return C.normalize_missing(base(spark, d, "orders_status"), ["priority"], ["price"]).select("_row_id", "priority", "price")


LABEL_NOISE = "case o_orderkey % 3 when 0 then lower(o_orderstatus) when 1 then ' ' || o_orderstatus || ' ' else o_orderstatus end"


@query("clean_keep_labels", f"""select o_orderkey, upper(trim({LABEL_NOISE})) as label from orders
    where upper(trim({LABEL_NOISE})) in ('P', 'F')""")
def _(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", F.expr(LABEL_NOISE).alias("label"))
    return C.keep_labels(df, "label", ("P", "F"))


CODE = "case when o_orderkey % 17 = 0 then null else o_orderkey % 28 + 1 end"


@query("clean_exclude_codes", f"""select o_orderkey, {CODE} as code from orders
    where coalesce({CODE} not in (11, 13, 14, 19, 20, 21), true)""")
def _(spark, d):
    return C.exclude_codes(table(spark, d, "orders").select("o_orderkey", F.expr(CODE).alias("code")), "code")


@query("clean_codes_by_keyword", """select distinct p_partkey from part
    where lower(p_name) like '%ring%' or lower(p_name) like '%widget%'""")
def _(spark, d):
    return C.codes_by_keyword(table(spark, d, "part"), "p_partkey", "p_name", ("ring", "widget"))


@query("clean_exclude_by_keyword", """select l_orderkey, l_partkey, l_quantity from lineitem where l_partkey not in
    (select p_partkey from part where lower(p_name) like '%ring%' or lower(p_name) like '%widget%')""")
def _(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    return C.exclude_by_keyword(lines, "l_partkey", table(spark, d, "part"), "p_partkey", "p_name", ("ring", "widget"))


@query("clean_exclude_default_codes", """select l_orderkey, l_partkey, l_quantity from lineitem where
    l_partkey not in (11, 13, 14, 19, 20, 21)""")
def _(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    return C.exclude_by_keyword(lines, "l_partkey", table(spark, d, "part"), "p_partkey", "p_name", ("no such word",))


TEXT_CODE = "case when o_orderkey % 17 = 0 then '?' when o_orderkey % 5 = 0 then cast(o_orderkey % 28 + 1 as string) || '.0' else cast(o_orderkey % 28 + 1 as string) end"


@query("clean_exclude_text_codes", f"""select o_orderkey, {TEXT_CODE} as code from orders
    where coalesce(try_cast({TEXT_CODE} as double) not in (11, 13, 14, 19, 20, 21), true)""")
def _(spark, d):
    return C.exclude_codes(table(spark, d, "orders").select("o_orderkey", F.expr(TEXT_CODE).alias("code")), "code")


@query("clean_drop_columns", "select c_custkey, c_nationkey, c_mktsegment from customer")
def _(spark, d):
    return C.drop_if_present(table(spark, d, "customer"), ["c_name", "c_acctbal", "weight", "payer_code"])


@query("clean_fill_missing", f"select _row_id, {cat_sql('priority')} as priority from ({base_sql('orders_status')})")
def _(spark, d):
    return C.fill_missing(base(spark, d, "orders_status").select("_row_id", "priority"), "priority")


ICD = """case o_orderkey % 6 when 0 then 'V' || cast(o_orderkey % 90 as string) when 1 then '?'
    when 2 then '250.' || cast(o_orderkey % 100 as string) else cast(o_orderkey % 1000 as string) end"""
ICD_GROUP = """case when code in ('', '?') or code like 'V%' or code like 'E%' or try_cast(code as double) is null then 'Other'
    when x >= 250 and x < 251 then 'Diabetes' when floor(x) = 785 then 'Circulatory' when floor(x) = 786 then 'Respiratory'
    when floor(x) = 787 then 'Digestive' when floor(x) = 788 then 'Genitourinary'
    when x >= 390 and x < 460 then 'Circulatory' when x >= 460 and x < 520 then 'Respiratory'
    when x >= 520 and x < 580 then 'Digestive' when x >= 580 and x < 630 then 'Genitourinary'
    when x >= 800 and x < 1000 then 'Injury' when x >= 710 and x < 740 then 'Musculoskeletal'
    when x >= 140 and x < 240 then 'Neoplasms' else 'Other' end"""


@query("clean_icd9", f"""select o_orderkey, code, {ICD_GROUP} as grp
    from (select *, try_cast(code as double) as x from (select o_orderkey, {ICD} as code from orders))""")
def _(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", F.expr(ICD).alias("code"))
    return df.withColumn("grp", icd9_group(F.col("code")))


AGE = """case when o_orderkey % 31 = 0 then '?' else
    '[' || cast((o_orderkey % 10) * 10 as string) || '-' || cast((o_orderkey % 10 + 1) * 10 as string) || ')' end"""


@query("clean_age", f"""select o_orderkey, case when o_orderkey % 31 = 0 then 'Unknown' when o_orderkey % 10 < 3 then '<30'
    when o_orderkey % 10 < 6 then '30-60' else '>60' end as age from orders""")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", age_bin3(F.expr(AGE)).alias("age"))


@query("clean_rare_merge", """with f as (select p_brand, count(*) / (select count(*) from part) as share from part group by 1)
    select p_partkey, case when share < 0.035 then 'Other' else p.p_brand end as p_brand from part p join f using (p_brand)""")
def _(spark, d):
    return C.merge_rare(table(spark, d, "part").select("p_partkey", "p_brand"), ["p_brand"])


ENCOUNTER = f"""select o_orderkey as encounter_id, o_custkey as patient_nbr, {ICD} as diag_1, {AGE} as age,
    {CODE} as discharge_disposition_id,
    case when o_orderkey % 7 = 0 then null when o_orderkey % 5 = 0 then '?' else o_orderpriority end as medical_specialty,
    case o_orderkey % 4 when 0 then ' no' when 1 then '>30' when 2 then '<30 ' else 'unknown' end as readmitted,
    o_totalprice as weight from """


@query("clean_encounters", f"""with raw as (select *, upper(trim(readmitted)) as r from ({ENCOUNTER} orders)),
    kept as (select * from raw where r in ('<30', '>30', 'NO')
             and coalesce(discharge_disposition_id not in (11, 13, 14, 19, 20, 21), true)),
    firsts as (select *, diag_1 as code, try_cast(diag_1 as double) as x from
               (select *, row_number() over (partition by patient_nbr order by encounter_id) as k from kept) where k = 1),
    grouped as (select *, {ICD_GROUP} as g from firsts),
    freq as (select g, count(*) / (select count(*) from grouped) as share from grouped group by 1)
    select case when share < 0.035 then 'Other' else g end as diag_1,
           case when encounter_id % 31 = 0 then 'Unknown' when encounter_id % 10 < 3 then '<30'
                when encounter_id % 10 < 6 then '30-60' else '>60' end as age,
           discharge_disposition_id, {cat_sql('medical_specialty')} as medical_specialty, r as readmitted
    from grouped join freq using (g)""")
def _(spark, d):
    return C.clean_encounters(spark.sql(f"{ENCOUNTER} parquet.`{d}/orders.parquet`"))


@query("clean_step_report", f"""with a as ({ENCOUNTER} orders),
    b as (select * from a where upper(trim(readmitted)) in ('<30', '>30', 'NO')),
    c as (select * from b where coalesce(discharge_disposition_id not in (11, 13, 14, 19, 20, 21), true))
    select 0 as step, 'load' as name, count(*) as rows from a union all select 1, 'labels', count(*) from b
    union all select 2, 'discharge', count(*) from c""")
def _(spark, d):
    a = spark.sql(f"{ENCOUNTER} parquet.`{d}/orders.parquet`")
    b = C.keep_labels(a, "readmitted")
    return C.step_report({"load": a, "labels": b, "discharge": C.exclude_codes(b, "discharge_disposition_id")})


@query("dedupe_first", """select o_custkey, o_orderdate, o_orderkey, o_orderstatus from (select *, row_number() over
    (partition by o_custkey order by o_orderdate, o_orderkey) as k from orders) where k = 1""")
def _(spark, d):
    df = table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus")
    return J.first_per_key(df, ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query("dedupe_first_encounter", """select event_id as _row_id, event_type from (select *, row_number() over
    (partition by user_id order by event_id) as k from events) where k = 1""")
def _(spark, d):
    df = table(spark, d, "events").select(F.col("event_id").alias("_row_id"), "user_id", "event_type")
    return C.first_encounter(df, "user_id")


@query("dedupe_report", """with a as (select * from events), b as (select * from (select *, row_number() over
    (partition by user_id order by event_id) as k from events) where k = 1)
    select 'before_rows' as measure, count(*) as value from a union all select 'before_keys', count(distinct user_id) from a
    union all select 'after_rows', count(*) from b union all select 'after_keys', count(distinct user_id) from b
    union all select 'label_' || event_type, count(*) from b group by event_type""")
def _(spark, d):
    df = table(spark, d, "events").select("event_id", "user_id", "event_type")
    return C.dedupe_report(df, J.first_per_key(df, ["user_id"], ["event_id"]), "user_id", "event_type")


@query("slice_rows", """select o_orderkey, pos from (select o_orderkey, row_number() over (order by o_orderkey) - 1 as pos
    from orders) where pos >= 100 and pos < 600""")
def _(spark, d):
    return P.slice_corpus(table(spark, d, "orders").select("o_orderkey"), 100, -1, 500, key="o_orderkey")


@query("dense_positions", "select o_orderkey, row_number() over (order by o_orderkey) - 1 as pos from orders")
def _(spark, d):
    return P.dense_positions(table(spark, d, "orders").select("o_orderkey"), "o_orderkey")


@query("limit_rows", "select o_orderkey, o_totalprice from orders order by o_orderkey limit 1000")
def _(spark, d):
    return P.limit_rows(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), 1000, "o_orderkey")


@query("threshold_label", "select o_orderkey, case when o_totalprice > 179700 then 1 else 0 end as label from orders")
def _(spark, d):
    return C.threshold_label(table(spark, d, "orders"), "o_totalprice", 179700).select("o_orderkey", "label")


@query("encode_target", f"""select o_orderkey, case upper(trim({LABEL_NOISE})) when 'P' then 0 when 'F' then 1 when 'O' then 2 end
    as target_id, upper(trim({LABEL_NOISE})) as decoded, case o_orderkey % 4 when 1 then 'F' when 2 then 'O' else 'P' end as from_id
    from orders""")
def _(spark, d):
    labels = ["P", "F", "O"]
    encode, decode = label_ids(labels, lambda v: F.when(F.upper(F.trim(v)).isin(*labels), F.upper(F.trim(v))))
    df = table(spark, d, "orders").select("o_orderkey", F.expr(LABEL_NOISE).alias("raw"))
    return df.select(
        "o_orderkey",
        encode(F.col("raw")).alias("target_id"),
        decode(F.col("raw")).alias("decoded"),
        decode(F.col("o_orderkey") % 4).alias("from_id"),
    )


MIXED = """case doc_id % 7 when 0 then '0' when 1 then '1' when 2 then ' 0.0' when 3 then '1.0 ' when 4 then 'yes'
    when 5 then '' else '2' end"""


@query("coerce_01", f"""select doc_id, case when trim({MIXED}) in ('0', '0.0') then 0 when trim({MIXED}) in ('1', '1.0') then 1 end
    as as_text, case when n_chars % 3 = 0 then 0 when n_chars % 3 = 1 then 1 end as as_number from documents""")
def _(spark, d):
    df = table(spark, d, "documents")
    return df.select(
        "doc_id",
        coerce_01(F.expr(MIXED)).alias("as_text"),
        coerce_01((F.col("n_chars") % 3).cast("double")).alias("as_number"),
    )


@query("features_frame", f"""select _row_id, cast(price as float) as price, cast(cust as float) as cust,
    coalesce(priority, 'missing') as priority, yr from ({base_sql('orders_status')})""")
def _(spark, d):
    return C.features_frame(base(spark, d, "orders_status"), "_row_id", ["priority", "yr"], ["price", "cust"])


@query("split_stratified", f"with base as ({base_sql('orders_status')}), {split_sql('base', 'status')} select * from splits")
def _(spark, d):
    return P.stratified_split(base(spark, d, "orders_status"), "status")


DECILES = f"""with raw as ({base_sql('orders_price')}),
    e as (select list_sort(list_distinct(quantile_cont(price, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) as q
          from raw),
    base as (select raw.*, cast(len(list_filter(q[2:len(q) - 1], lambda v: v < price)) as int) as stratum from raw, e)"""


@query("bins_decile", f"{DECILES} select _row_id, stratum from base")
def _(spark, d):
    return P.quantile_bins(base(spark, d, "orders_price"), "price").select("_row_id", "stratum")


@query("split_deciles", f"{DECILES}, {split_sql('base', 'stratum')} select * from splits")
def _(spark, d):
    return P.stratified_split(P.quantile_bins(base(spark, d, "orders_price"), "price"), "stratum")


@query("with_split_train", f"{train_sql('orders_status', 'status')} select _row_id, status, yr from train")
def _(spark, d):
    df = base(spark, d, "orders_status")
    return J.with_split(df, P.stratified_split(df, "status"), "train").select("_row_id", "status", "yr")


@query("largest_remainder", f"""with base as ({base_sql('event_type')}), {split_sql('base', 'event_type')}
    select s as event_type, c as cnt, cast(k1 as bigint) as n_test, cast(k2 as bigint) as n_valid from s6""")
def _(spark, d):
    return P.split_quotas(base(spark, d, "event_type"), "event_type")


@query("sample_stratified", f"""with base as ({base_sql('orders_status')}),
    c as (select status, count(*) as c, sum(count(*)) over () as n from base group by 1),
    b as (select status, c, (c * 1000) // n as b, (c * 1000) % n as r from c),
    k as (select status, b + case when row_number() over (order by r desc, status) <= 1000 - sum(b) over () then 1 else 0 end as k
          from b),
    r as (select _row_id, status, row_number() over (partition by status
          order by md5('42|limit|' || cast(_row_id as varchar)), _row_id) as o from base)
    select _row_id, status, row_number() over (order by md5('42|shuffle|' || cast(_row_id as varchar)), _row_id) - 1 as pos
    from r join k using (status) where o <= k.k""")
def _(spark, d):
    return P.stratified_limit(base(spark, d, "orders_status").select("_row_id", "status"), "status", 1000)


@query("shuffle", f"""select _row_id, row_number() over (order by md5('42|shuffle|' || cast(_row_id as varchar)), _row_id) - 1 as pos
    from ({base_sql('event_type')})""")
def _(spark, d):
    return P.shuffled(base(spark, d, "event_type").select("_row_id"))


@query("sample_undersample", f"""with base as ({base_sql('doc_toxic')}),
    r as (select _row_id, toxic, row_number() over (partition by toxic order by md5('42|under|' || cast(_row_id as varchar)),
          _row_id) - 1 as j from base),
    p as (select _row_id, toxic, case when toxic = 1 then 4 * j + 3 else 4 * (j // 3) + j % 3 end as pos from r),
    n as (select count(*) filter (where toxic = 0) as neg, count(*) filter (where toxic = 1) as pos from base)
    select p._row_id, p.toxic, p.pos from p, n where p.pos < least(1000, 4 * (n.neg // 3) + n.neg % 3, 4 * n.pos + 3)""")
def _(spark, d):
    return P.undersample_3to1(base(spark, d, "doc_toxic").select("_row_id", "toxic"), "toxic", 1000)


@query("resolve_binary", """select '0' as negative, '1' as positive, false as by_majority union all
    select arg_max(lang_is, c), arg_min(lang_is, c), true from (select case when lang = 'en' then 'en' else 'other' end as lang_is,
    count(*) as c from documents group by 1)""")
def _(spark, d):
    df = base(spark, d, "doc_lang").withColumn("is_en", F.when(F.col("lang") == "en", "en").otherwise("other"))
    return P.resolve_binary(base(spark, d, "doc_toxic"), "toxic").unionByName(P.resolve_binary(df, "is_en"))


# ---------------------------------------------------------------- lookups


@query("attach_targets", """select o_orderkey as "index", o_orderstatus as label,
    case when o_orderkey % 3 > 0 then o_custkey end as target from orders""")
def _(spark, d):
    o = table(spark, d, "orders")
    pred = o.select(F.col("o_orderkey").alias("index"), F.col("o_orderstatus").alias("label"))
    targets = o.select(F.col("o_orderkey").alias("index"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_custkey")).alias("target"))
    return J.attach_targets(pred, targets)


@query("align_outputs", """select o.o_orderkey as _row_id, o.o_totalprice as input, c.c_name as raw
    from orders o join customer c on o.o_orderkey = c.c_custkey""")
def _(spark, d):
    corpus = table(spark, d, "orders").select(F.col("o_orderkey").alias("_row_id"), F.col("o_totalprice").alias("input"))
    outputs = table(spark, d, "customer").select(F.col("c_custkey").alias("_row_id"), F.col("c_name").alias("raw"))
    return J.align(corpus, outputs)


@query("unaligned_rows", """select o_orderkey as _row_id, 'corpus' as side from orders
    where o_orderkey not in (select c_custkey from customer) union all
    select c_custkey, 'outputs' from customer where c_custkey not in (select o_orderkey from orders)""")
def _(spark, d):
    corpus = table(spark, d, "orders").select(F.col("o_orderkey").alias("_row_id"))
    return J.unaligned(corpus, table(spark, d, "customer").select(F.col("c_custkey").alias("_row_id")))


@query("overlay_latest", """select o_orderkey as _row_id, case when o_orderkey % 3 = 0 then 3 when o_orderkey % 2 = 0 then 2 else 1 end
    as attempt, 'a' || cast(case when o_orderkey % 3 = 0 then 3 when o_orderkey % 2 = 0 then 2 else 1 end as varchar) || '-' ||
    o_orderstatus as raw from orders""")
def _(spark, d):
    o = table(spark, d, "orders")

    def attempt(rows, n):
        return rows.select(
            F.col("o_orderkey").alias("_row_id"), F.lit(n).alias("attempt"), F.concat(F.lit(f"a{n}-"), "o_orderstatus").alias("raw")
        )

    reruns = attempt(o.filter("o_orderkey % 2 = 0"), 2).unionByName(attempt(o.filter("o_orderkey % 3 = 0"), 3))
    return J.overlay_latest(attempt(o, 1), reruns)


@query("sample_freq", f"""{train_sql('orders_status', 'status')},
    l as (select _row_id, 'priority' as col, {cat_sql('priority')} as value from base union all
          select _row_id, 'yr', yr from base),
    f as (select col, value, count(*) / sum(count(*)) over (partition by col) as prop from
          (select 'priority' as col, {cat_sql('priority')} as value from train union all select 'yr', yr from train)
          group by 1, 2)
    select l._row_id, l.col, l.value, round(coalesce(f.prop, 0), 6) as prop from l left join f using (col, value)""")
def _(spark, d):
    from corpusforge.operators.stats import cat_stats

    df = base(spark, d, "orders_status")
    stats = cat_stats(train_of(df, "status"), ["priority", "yr"], None)
    return rounded(sample_freq(df, stats, ["priority", "yr"]))


@query("pending_rows", f"""with base as ({base_sql('orders_status')}), {split_sql('base', 'status')}
    select b._row_id, b.status from base b join splits s on b._row_id = s._row_id where s.split <> 'test'""")
def _(spark, d):
    df = base(spark, d, "orders_status")
    done = P.stratified_split(df, "status").filter("split = 'test'")
    return J.pending(df.select("_row_id", "status"), done)


@query("minus_keys", """select c_custkey, c_nationkey from customer where c_nationkey not in
    (select s_nationkey from supplier where s_acctbal < 5000)""")
def _(spark, d):
    s = table(spark, d, "supplier").filter("s_acctbal < 5000").select(F.col("s_nationkey").alias("c_nationkey"))
    return J.minus(table(spark, d, "customer").select("c_custkey", "c_nationkey"), s, ["c_nationkey"])


@query("attach_block", """select c_custkey, c_mktsegment, (select count(*) from customer) as n_train,
    (select round(avg(c_acctbal), 6) from customer) as mean_balance from customer""")
def _(spark, d):
    c = table(spark, d, "customer")
    block = c.agg(F.count(F.lit(1)).alias("n_train"), F.round(F.avg("c_acctbal"), 6).alias("mean_balance"))
    return J.attach_block(c.select("c_custkey", "c_mktsegment"), block)


@query("resume_pending", """select o_orderkey as _row_id from orders where o_orderkey not in (select c_custkey from customer)""")
def _(spark, d):
    corpus = table(spark, d, "orders").select(F.col("o_orderkey").alias("_row_id"))
    log = table(spark, d, "customer").select(F.col("c_custkey").alias("_row_id"))
    return IO.resume_outputs(corpus, log.unionByName(log))


# ---------------------------------------------------------------- shards

SHARDS = """select c_custkey as pos, c_name as output, 1000 + c_custkey % 2 as mtime,
    case when c_nationkey = 24 then 'notes.json' else c_mktsegment || '_mode_' ||
    case when c_nationkey % 2 = 0 then 'finetune' else 'normal_finetune' end || '_' || cast(c_nationkey % 4 + 1 as string) ||
    '_finetune_run' || cast(c_custkey % 2 as string) || '_final.json' end as file from """
SHARD_SQL = f"""with r as ({SHARDS} customer),
    k as (select *, regexp_extract(file, '^(.+)_mode_(finetune|normal_finetune)_(\\d+)_(finetune_[^/]+?_final\\.json)$',
          ['prefix', 'mode', 'part', 'tail']) as m from r where file <> 'notes.json')"""


@query("shard_keys", f"""{SHARD_SQL} select distinct file, m.prefix as prefix, m.mode as mode, cast(m.part as bigint) as part,
    m.tail as tail from k""")
def _(spark, d):
    return IO.shard_keys(spark.sql(f"{SHARDS} parquet.`{d}/customer.parquet`").select("file").distinct())


@query("shard_latest", f"""{SHARD_SQL}, u as (select distinct m.prefix || case when m.mode = 'finetune' then '' else '' end as prefix,
    m.mode as mode, 'final' as tail, cast(m.part as bigint) as part, mtime, file from k)
    select prefix, mode, tail, part, arg_max(file, mtime) as file from u group by 1, 2, 3, 4""")
def _(spark, d):
    files = IO.shard_keys(spark.sql(f"{SHARDS} parquet.`{d}/customer.parquet`").select("file", "mtime").distinct())
    return IO.latest_part(files.withColumn("tail", F.lit("final")))


@query("shard_missing", f"""{SHARD_SQL}, g as (select distinct m.prefix as prefix, m.mode as mode, m.tail as tail from k),
    w as (select g.*, p.part from g, (select unnest(range(1, 7)) as part) p)
    select prefix, mode, tail, part from w where not exists (select 1 from k where k.m.prefix = w.prefix and k.m.mode = w.mode
    and k.m.tail = w.tail and cast(k.m.part as bigint) = w.part)""")
def _(spark, d):
    files = IO.shard_keys(spark.sql(f"{SHARDS} parquet.`{d}/customer.parquet`").select("file").distinct())
    return IO.missing_parts(files, 6)


# ---------------------------------------------------------------- scalars

TEXT_NUMBER = """case o_orderkey % 5 when 0 then ' ' || cast(o_custkey as string) || ',000.5' when 1 then '' when 2 then 'n/a'
    when 3 then '-' || cast(o_custkey as string) else '1e3' end"""


@query("parse_number", f"""select o_orderkey, try_cast(nullif(replace(trim({TEXT_NUMBER}), ',', ''), '') as double) as x from orders""")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", parse_number(F.expr(TEXT_NUMBER)).alias("x"))


@query("is_close", """select o_orderkey, abs(o_totalprice - b) <= greatest(1e-9 * greatest(abs(o_totalprice), abs(b)), 1e-6) as same
    from (select *, o_totalprice + case o_orderkey % 4 when 0 then 0.0 when 1 then 0.0000005 when 2 then 0.0001 else 0.01 end as b
    from orders)""")
def _(spark, d):
    shift = "o_totalprice + case o_orderkey % 4 when 0 then 0.0D when 1 then 0.0000005D when 2 then 0.0001D else 0.01D end"
    return table(spark, d, "orders").select("o_orderkey", is_close(F.col("o_totalprice"), F.expr(shift)).alias("same"))


@query("bin_index", """select p_partkey, case when p_size < 1 or p_size > 50 then null when p_size <= 10 then 0 when p_size <= 20 then 1
    when p_size <= 30 then 2 else 3 end as bin from part""")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", bin_index(F.col("p_size").cast("double"), [1, 10, 20, 30, 50]).alias("bin"))


@query("format_numbers", """select o_orderkey, printf('%.2f', x) as two, printf('%.3f', x / 8) as three, printf('%.0f', x) as whole,
    printf('%.1f', x / 700) || '%' as pct, cast(x as varchar) as shortest, cast(x * 1e7 as varchar) as large
    from (select o_orderkey, (o_totalprice - 250000) / 4 as x from orders)""")
def _(spark, d):
    x = (F.col("o_totalprice") - 250000) / 4
    return table(spark, d, "orders").select(
        "o_orderkey",
        fmt_fixed(x, 2).alias("two"),
        fmt_fixed(x / 8, 3).alias("three"),
        fmt_fixed(x, 0).alias("whole"),
        F.concat(fmt_fixed(x / 700, 1), F.lit("%")).alias("pct"),
        py_str(x).alias("shortest"),
        py_str(x * 1e7).alias("large"),
    )


@query("format_percent", "select o_orderkey, printf('%.1f', o_custkey / 1499.0 * 100.0) || '%' as share from orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", fmt_pct(F.col("o_custkey") / 1499.0).alias("share"))


@query("format_four_digits", """select o_orderkey, printf('%.4f', x) as four, printf('%.6f', x) as six, printf('%.1f', x) as one
    from (select o_orderkey, (o_custkey - 700) / cast(pow(2, o_orderkey % 20 + 3) as double) as x from orders)""")
def _(spark, d):
    x = (F.col("o_custkey") - 700) / F.pow(F.lit(2.0), F.col("o_orderkey") % 20 + 3)
    return table(spark, d, "orders").select(
        "o_orderkey", fmt_fixed(x, 4).alias("four"), fmt_fixed(x, 6).alias("six"), fmt_fixed(x, 1).alias("one")
    )
