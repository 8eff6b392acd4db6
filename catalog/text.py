"""Rendered text: rows, blocks, prompts, and the responses that come back."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import SPECS, base, base_sql, cat_sql, query, splits_of, table, train_of, train_sql
from catalog.retrieval import many_class_sql, pairs_sql, two_class_sql, vectors_sql
from corpusforge.functions import responses as R
from corpusforge.functions.numbers import fmt_fixed, fmt_thousands
from corpusforge.operators import render as T
from corpusforge.operators.retrieval import neighbors
from corpusforge.operators.verdicts import split_responses, to_messages
from corpusforge.plans.corpus import build_corpus
from corpusforge.session import materialize
from corpusforge.spec import CorpusSpec, project, task_spec
from corpusforge.tasks import (
    JOB_LABELS,
    JOB_TOKEN,
    READMISSION_LABELS,
    READMISSION_TOKEN,
    default_sentence,
    multiclass_task,
    numeric_task,
)

STATUS_LABELS = ["p", "f", "o"]
STATUS_TASK = multiclass_task(
    STATUS_LABELS,
    lambda v: R.normalize_class(v, STATUS_LABELS),
    JOB_TOKEN,
    lambda label: F.concat(F.lit("The order status is: "), label, F.lit(".")),
    {"zeroshot": "You are an order clerk. ", "finetune": "Explain the given status. ", "reasoning": "Reason. ", "normal_finetune": "Why? "},
)
SEGMENT_LABELS = ["automobile", "building", "furniture", "household", "machinery"]
SEGMENT_TASK = multiclass_task(
    SEGMENT_LABELS,
    lambda v: R.normalize_class(v, SEGMENT_LABELS),
    JOB_TOKEN,
    lambda label: F.concat(F.lit("The segment is: "), label, F.lit(".")),
    {"zeroshot": "You are an order clerk. "},
)
PRICE_TASK = numeric_task(
    2, lambda y: F.concat(F.lit("The price is $"), fmt_thousands(y), F.lit(".")), {"zeroshot": "You price parts. "}
)

ORDER_TEXT = f"""'price is ' || coalesce(cast(price as varchar), 'missing') || '. cust is ' || cast(cust as varchar) ||
    '. priority is ' || {cat_sql('priority')} || '. yr is ' || yr"""


@query("render_row", f"select _row_id, {ORDER_TEXT} as text from ({base_sql('orders_status')})")
def _(spark, d):
    df = base(spark, d, "orders_status")
    return df.select("_row_id", T.render_row(df, SPECS["orders_status"]).alias("text"))


@query("render_row_plain", f"""select _row_id, 'price: ' || coalesce(cast(price as varchar), 'missing') || ', cust: ' ||
    cast(cust as varchar) || ', priority: ' || {cat_sql('priority')} || ', yr: ' || yr as text from ({base_sql('orders_status')})""")
def _(spark, d):
    df = base(spark, d, "orders_status")
    return df.select("_row_id", T.render_row(df, SPECS["orders_status"], style="plain").alias("text"))


@query("render_target", """select o_orderkey, case when o_orderkey % 2 = 0 then 'yes' else 'no' end as yes_no,
    printf('%.4f', o_totalprice / 3) as four, printf('%.2f', o_totalprice / 3) as two from orders""")
def _(spark, d):
    o = table(spark, d, "orders")
    return o.select(
        "o_orderkey",
        task_spec("adult").render_target(F.when(F.col("o_orderkey") % 2 == 0, ">50K").otherwise("<=50K")).alias("yes_no"),
        task_spec("california").render_target(F.col("o_totalprice") / 3).alias("four"),
        task_spec("diamonds").render_target(F.col("o_totalprice") / 3).alias("two"),
    )


@query("render_label_sentence", """select o_orderkey,
    case when o_orderkey % 3 = 0 then 'This person has income > $50K.' else 'This person has income ≤ $50K.' end as income,
    'The median house value for this area is $' || printf('%.0f', o_totalprice) || '.' as house,
    'The price of this diamond is $' || format('{:,}', round_even(o_totalprice, 0)::bigint) || '.' as diamond,
    case when o_orderkey % 2 = 1 then 'This applicant will default on the loan.' else
    'This applicant will not default on the loan.' end as credit,
    'This profile belongs to job category: ' || case o_orderkey % 3 when 1 then 'stem' when 2 then 'student' else 'non_stem' end || '.' as job,
    case o_orderkey % 3 when 1 then 'This patient is readmitted after 30 days.' when 2 then 'This patient is readmitted within 30 days.'
    else 'This patient has no readmission.' end as readmitted,
    'The label is: ' || o_orderstatus as plain, 'The target value is: ' || cast(o_custkey as varchar) as value from orders""")
def _(spark, d):
    key = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        "o_orderkey",
        task_spec("adult").sentence(F.when(key % 3 == 0, " >50K").otherwise("<=50K")).alias("income"),
        task_spec("california").sentence(F.col("o_totalprice")).alias("house"),
        task_spec("diamonds").sentence(F.col("o_totalprice")).alias("diamond"),
        task_spec("home_credit").sentence(key % 2).alias("credit"),
        task_spec("okcupid_stem").sentence(key % 3).alias("job"),
        task_spec("diabetes_130US").sentence(key % 3).alias("readmitted"),
        default_sentence(F.col("o_orderstatus")).alias("plain"),
        default_sentence(F.col("o_custkey"), None, True).alias("value"),
    )


# ---------------------------------------------------------------- statistics blocks

PCT = "printf('%.1f', {} * 100.0) || '%'"


def numbers_text(c: str, indent: str) -> str:
    def p(label, e):
        return f"'{label}=' || printf('%.2f', {e})"

    return (
        f"'{indent}' || {p('mean', f'avg({c})')} || ', ' || {p('std', f'stddev_samp({c})')} || chr(10) || '{indent}' || "
        f"{p('p25', f'quantile_cont({c}, 0.25)')} || ', ' || {p('p50', f'quantile_cont({c}, 0.5)')} || ', ' || "
        f"{p('p75', f'quantile_cont({c}, 0.75)')} || chr(10) || '{indent}' || {p('min', f'min({c})::double')} || ', ' || {p('max', f'max({c})::double')}"
    )


OVERALL_SQL = f"""{train_sql('customer_segment', 'segment')}, n as (select count(*) as n from train),
    v as (select nation, count(*) as cnt, row_number() over (order by count(*) desc, min(_row_id)) as rnk from train group by 1),
    t as (select string_agg(nation || '(' || {PCT.format('cnt / n')} || ')', ', ' order by rnk) filter (where rnk <= 5) as top,
          count(*) as uniq from v, n),
    dist as (select segment, count(*) as cnt, min(_row_id) as f from train group by 1),
    h as (select string_agg('  ' || segment || ': ' || cnt || ' (' || {PCT.format('cnt / n')} || ')', chr(10) order by cnt desc, f) as x
          from dist, n),
    num as (select {numbers_text('acctbal', '    ')} as x from train)
    select b._row_id, '=== Dataset Statistics (from training set, overall) ===' || chr(10) || 'Total training samples: ' || n.n || chr(10) ||
    chr(10) || 'Target distribution (segment):' || chr(10) || h.x || chr(10) || chr(10) || 'Numerical features:' || chr(10) || '  acctbal:' ||
    chr(10) || num.x || chr(10) || chr(10) || 'Categorical features (top 5 values):' || chr(10) || '  nation (' || t.uniq || ' unique):' ||
    chr(10) || '    ' || t.top || chr(10) || '    current_sample=' || b.nation || '(' || {PCT.format('coalesce(v.cnt, 0) / n.n')} || ')' as block
    from base b left join v on v.nation = b.nation, n, t, h, num"""


@query("render_stats_overall", OVERALL_SQL)
def _(spark, d):
    df = base(spark, d, "customer_segment")
    text = T.StatsText(train_of(df, "segment"), SPECS["customer_segment"], CorpusSpec(with_stats=True))
    return text.add_block(df, "block").select("_row_id", "block")


@query("render_stats_per_class", f"""{train_sql('customer_segment', 'segment')}, n as (select count(*) as n from train),
    v as (select segment, nation, count(*) as cnt, row_number() over (partition by segment order by count(*) desc, min(_row_id)) as rnk
          from train group by 1, 2),
    dist as (select segment, count(*) as cnt, min(_row_id) as f, {numbers_text('acctbal', '      ')} as num from train group by 1),
    t as (select v.segment, string_agg(nation || '(' || {PCT.format('v.cnt / dist.cnt')} || ')', ', ' order by rnk) filter (where rnk <= 3)
          as top from v join dist using (segment) group by 1),
    h as (select string_agg('  ' || segment || ': ' || cnt || ' (' || {PCT.format('cnt / n')} || ')', chr(10) order by cnt desc, f) as x
          from dist, n),
    parts as (select b._row_id, string_agg(chr(10) || '[segment = ' || d.segment || '] (n=' || d.cnt || ', ' || {PCT.format('d.cnt / n.n')} ||
              '):' || chr(10) || '  Numerical features:' || chr(10) || '    acctbal:' || chr(10) || d.num || chr(10) ||
              '  Categorical features (top 3):' || chr(10) || '    nation: ' || t.top || chr(10) || '    current_sample=' || b.nation || '(' ||
              {PCT.format('coalesce(v.cnt, 0) / d.cnt')} || ')', chr(10) order by d.f) as x
              from base b cross join dist d join t on t.segment = d.segment left join v on v.segment = d.segment and v.nation = b.nation, n group by 1)
    select parts._row_id, '=== Dataset Statistics (from training set, per-class) ===' || chr(10) || 'Total training samples: ' || n.n || chr(10) ||
    chr(10) || 'Target distribution (segment):' || chr(10) || h.x || chr(10) || chr(10) || '--- Statistics by Target Class ---' || chr(10) ||
    parts.x as block from parts, n, h""")
def _(spark, d):
    df = base(spark, d, "customer_segment")
    text = T.StatsText(train_of(df, "segment"), SPECS["customer_segment"], CorpusSpec(with_stats=True, per_group=True, top_k=3))
    return text.add_block(df, "block").select("_row_id", "block")


@query("render_stats_per_bin", f"""with raw as ({base_sql('part_price')}), e as (select quantile_cont(price, [0.0, 0.25, 0.5, 0.75, 1.0]) as q from raw),
    base as (select raw.*, 1 + (price > q[2])::int + (price > q[3])::int + (price > q[4])::int as bin from raw, e),
    n as (select count(*) as n from base),
    b as (select bin, count(*) as cnt, {numbers_text('size', '      ')} as num from base group by 1),
    vt as (select bin, type as v, count(*) as cnt, row_number() over (partition by bin order by count(*) desc, min(_row_id)) as rnk from base group by 1, 2),
    vb as (select bin, brand as v, count(*) as cnt, row_number() over (partition by bin order by count(*) desc, min(_row_id)) as rnk from base group by 1, 2),
    tt as (select vt.bin, string_agg(v || '(' || {PCT.format('vt.cnt / b.cnt')} || ')', ', ' order by rnk) filter (where rnk <= 5) as x from vt join b using (bin) group by 1),
    tb as (select vb.bin, string_agg(v || '(' || {PCT.format('vb.cnt / b.cnt')} || ')', ', ' order by rnk) filter (where rnk <= 5) as x from vb join b using (bin) group by 1),
    parts as (select r._row_id, string_agg(chr(10) || 'Q' || b.bin || ' (' || (b.bin - 1) * 25 || '%-' || b.bin * 25 || '%): price in (' ||
       printf('%.1f', q[b.bin]) || ', ' || printf('%.1f', q[b.bin + 1]) || '] (n=' || b.cnt || ', ' || {PCT.format('b.cnt / n.n')} || ')' || chr(10) ||
       '  Numerical features:' || chr(10) || '    size:' || chr(10) || b.num || chr(10) || '  Categorical features (top 5):' || chr(10) ||
       '    type: ' || tt.x || chr(10) || '    current_sample=' || r.type || '(' || {PCT.format('coalesce(vt.cnt, 0) / b.cnt')} || ')' || chr(10) ||
       '    brand: ' || tb.x || chr(10) || '    current_sample=' || r.brand || '(' || {PCT.format('coalesce(vb.cnt, 0) / b.cnt')} || ')', chr(10) order by b.bin) as x
       from base r cross join b join tt on tt.bin = b.bin join tb on tb.bin = b.bin left join vt on vt.bin = b.bin and vt.v = r.type
       left join vb on vb.bin = b.bin and vb.v = r.brand, n, e group by 1)
    select parts._row_id, '=== Dataset Statistics (from training set, per-bin) ===' || chr(10) || 'Total training samples: ' || n.n || chr(10) || chr(10) ||
    '--- Statistics by price Percentile Bin (p0=' || printf('%.2f', q[1]) || ', p25=' || printf('%.2f', q[2]) || ', p50=' || printf('%.2f', q[3]) ||
    ', p75=' || printf('%.2f', q[4]) || ', p100=' || printf('%.2f', q[5]) || ') ---' || chr(10) || parts.x as block from parts, n, e""")
def _(spark, d):
    df = base(spark, d, "part_price")
    text = T.StatsText(df, SPECS["part_price"], CorpusSpec(with_stats=True, per_group=True))
    return text.add_block(df, "block").select("_row_id", "block")


ALL_VALUES_SQL = f"""{train_sql('customer_segment', 'segment')}, n as (select count(*) as n from train),
    v as (select nation, count(*) as cnt, row_number() over (order by count(*) desc, min(_row_id)) as rnk from train group by 1),
    t as (select string_agg(nation || '(' || {PCT.format('cnt / n')} || ')', ', ' order by rnk) as x, count(*) as uniq from v, n)
    select b._row_id, chr(10) || 'Numerical features:' || chr(10) || '  acctbal:' || chr(10) || num.x || chr(10) || chr(10) ||
    'Categorical features (all values):' || chr(10) || '  nation (' || t.uniq || ' unique):' || chr(10) || '    ' || t.x || chr(10) ||
    '    current_sample=' || b.nation || '(' || {PCT.format('coalesce(v.cnt, 0) / n.n')} || ')' as block
    from base b left join v on v.nation = b.nation, n, t, (select {numbers_text('acctbal', '    ')} as x from train) num"""


@query("render_stats_all_values", ALL_VALUES_SQL)
def _(spark, d):
    df = base(spark, d, "customer_segment")
    text = T.StatsText(train_of(df, "segment"), SPECS["customer_segment"], CorpusSpec(with_stats=True, top_k=None))
    return text.add_block(df, "block", include_header=False).select("_row_id", "block")


@query("render_inline", f"""{train_sql('doc_quality', 'quality')},
    n as (select string_agg('when quality=' || quality || ': ' || x, '; ' order by quality) as x from (select quality,
          'mean=' || printf('%.3f', avg(n_chars)) || ', std=' || printf('%.3f', stddev_samp(n_chars)) as x from train group by 1)),
    l as (select quality, count(*) as total from train group by 1),
    r as (select v.lang, l.quality, count(t._row_id) / any_value(l.total) as rate from (select distinct lang from train) v cross join l
          left join train t on t.lang = v.lang and t.quality = l.quality group by 1, 2),
    c as (select string_agg('when quality=' || quality || ': ' || x, '; ' order by quality) as x from (select quality,
          string_agg(lang || '=' || printf('%.3f', rate), ', ' order by lang) as x from r group by 1)),
    r2 as (select v.source, l.quality, count(t._row_id) / any_value(l.total) as rate from (select distinct source from train) v cross join l
          left join train t on t.source = v.source and t.quality = l.quality group by 1, 2),
    c2 as (select string_agg('when quality=' || quality || ': ' || x, '; ' order by quality) as x from (select quality,
          string_agg(source || '=' || printf('%.3f', rate), ', ' order by source) as x from r2 group by 1))
    select _row_id, 'n_chars is ' || n_chars || ' (' || n.x || '). lang is ' || lang || ' (per-class proportions: ' || c.x || '). source is ' ||
    source || ' (per-class proportions: ' || c2.x || ')' as text from base, n, c, c2""")
def _(spark, d):
    df, spec = base(spark, d, "doc_quality"), SPECS["doc_quality"]
    contexts = T.inline_contexts(train_of(df, "quality"), spec, "mean_std")
    return T.add_inline(df, spec, contexts, "text").select("_row_id", "text")


@query("render_inline_regression", f"""with base as ({base_sql('part_price')}), n as (select 'train stats: mean=' || printf('%.2f', avg(size)) as x from base),
    t as (select string_agg(v || '(' || {PCT.format('cnt / total')} || ')', ', ' order by rnk) as x from (select type as v, count(*) as cnt,
          sum(count(*)) over () as total, row_number() over (order by count(*) desc, min(_row_id)) as rnk from base group by 1) where rnk <= 3),
    b as (select string_agg(v || '(' || {PCT.format('cnt / total')} || ')', ', ' order by rnk) as x from (select brand as v, count(*) as cnt,
          sum(count(*)) over () as total, row_number() over (order by count(*) desc, min(_row_id)) as rnk from base group by 1) where rnk <= 3)
    select _row_id, 'size is ' || size || ' (' || n.x || '). type is ' || type || ' (top categories: ' || t.x || '). brand is ' || brand ||
    ' (top categories: ' || b.x || ')' as text from base, n, t, b""")
def _(spark, d):
    df, spec = base(spark, d, "part_price"), SPECS["part_price"]
    return T.add_inline(df, spec, T.inline_contexts(df, spec, "mean_only"), "text").select("_row_id", "text")


# ---------------------------------------------------------------- cases and prompts

CASES = f"""{train_sql('orders_status', 'status')}, {vectors_sql('train', 'train', ['price', 'cust'], ['priority', 'yr'], 'status')},
    {vectors_sql('base', 'train', ['price', 'cust'], ['priority', 'yr'], 'status')}, {pairs_sql('basev', 'trainv', 2, 2, 16)},
    knn as (with {many_class_sql(16)}),
    txt as (select _row_id as tid, {ORDER_TEXT} as features, 'The order status is: ' || lower(status) || '.' as truth from train),
    cases as (select query_id, '=== Similar Historical Cases ===' || chr(10) || string_agg('Example ' || rank || ' (similarity: ' ||
       printf('%.3f', sim) || '):' || chr(10) || '  Features: ' || features || chr(10) || '  Ground truth: ' || truth, chr(10) order by rank) as cases
       from (select knn.*, p.sim from knn join pairs p on p.qid = knn.query_id and p.tid = knn.train_id) k
       join txt on txt.tid = k.train_id group by 1)"""


@query("attach_case_text", f"{CASES} select knn.query_id, knn.rank, txt.features, txt.truth from knn join txt on txt.tid = knn.train_id")
def _(spark, d):
    df, spec = base(spark, d, "orders_status"), SPECS["orders_status"]
    train = materialize(train_of(df, "status"))  # read by the scales, the search and the texts
    near = neighbors(df, train, spec, 16, balanced=True, exclude_self=True)
    text = T.train_text(train, spec, STATUS_TASK.sentence)
    return T.attach_case_text(near, text).select("query_id", "rank", "features", "truth")


@query("render_cases", f"{CASES} select query_id, cases from cases")
def _(spark, d):
    df, spec = base(spark, d, "orders_status"), SPECS["orders_status"]
    train = materialize(train_of(df, "status"))  # read by the scales, the search and the texts
    near = neighbors(df, train, spec, 16, balanced=True, exclude_self=True)
    return T.render_cases(near, T.train_text(train, spec, STATUS_TASK.sentence))


@query("corpus_cases", f"""{CASES} select s._row_id, s.split, s._row_id as pos, 'Explain the given status. ' as instruction,
    c.cases || chr(10) || chr(10) || '--- Current Sample Features ---' || chr(10) || {ORDER_TEXT} || chr(10) || chr(10) ||
    'THE GIVEN PREDICTION LABEL is ' || lower(b.status) || '.' as input, lower(b.status) as output
    from base b join splits s on s._row_id = b._row_id join
    (select query_id, replace(regexp_replace(cases, 'Example \\d+ \\(similarity', '(similarity', 'g'), '', '') as cases from cases) c
    on c.query_id = b._row_id""")
def _(spark, d):
    table_, spec = project(base(spark, d, "orders_status"), SPECS["orders_status"]), SPECS["orders_status"]
    options = CorpusSpec(mode="finetune", with_cases=True, balanced=True)
    return build_corpus(table_, splits_of(table_, "status"), spec, STATUS_TASK, options)


@query("corpus_stats", f"""with blocks as ({OVERALL_SQL}), {train_sql('customer_segment', 'segment')[5:]}
    select b._row_id, s.split, b._row_id as pos,
    'You are an order clerk. You are also provided with dataset statistics to assist your reasoning.' as instruction,
    k.block || chr(10) || chr(10) || '--- Sample Features ---' || chr(10) || 'acctbal is ' || cast(b.acctbal as varchar) || '. nation is ' || b.nation
    as input, lower(b.segment) as output from base b join splits s on s._row_id = b._row_id join blocks k on k._row_id = b._row_id""")
def _(spark, d):
    table_, spec = project(base(spark, d, "customer_segment"), SPECS["customer_segment"]), SPECS["customer_segment"]
    return build_corpus(table_, splits_of(table_, "segment"), spec, SEGMENT_TASK, CorpusSpec(with_stats=True))


def top_sql(name: str, source: str, group: str, value: str) -> str:
    """CTEs ``{name}v(group, v, cnt, rnk)`` and ``{name}t(group, x)``: counts and the five most frequent values."""
    return f"""{name}v as (select {group} as g, {value} as v, count(*) as cnt, row_number() over (partition by {group}
        order by count(*) desc, min(_row_id)) as rnk from {source} group by 1, 2),
    {name}t as (select {name}v.g, string_agg(v || '(' || {PCT.format(f'{name}v.cnt / dist.cnt')} || ')', ', ' order by rnk)
        filter (where rnk <= 5) as x from {name}v join dist on dist.g = {name}v.g group by 1)"""


def own_sql(column: str, name: str, value: str) -> str:
    """Lines of a categorical column: its frequent values, and how common the row's own is."""
    return f"""'    {column}: ' || {name}t.x || chr(10) || '    current_sample=' || {value} || '(' ||
        {PCT.format(f'coalesce({name}v.cnt, 0) / dist.cnt')} || ')'"""


BOTH = " You are also provided with dataset statistics and similar historical cases to assist your reasoning."
SAMPLE_TITLE = "'--- Current Sample Features ---' || chr(10) || "
GAP = " || chr(10) || chr(10) || "


@query("corpus_full", f"""{CASES}, n as (select count(*) as n from train),
    tr as (select *, {cat_sql('priority')} as pr from train), bs as (select *, {cat_sql('priority')} as pr from base),
    dist as (select status as g, count(*) as cnt, min(_row_id) as f, {numbers_text('price', '      ')} as num1,
        {numbers_text('cust', '      ')} as num2 from train group by 1),
    {top_sql('p', 'tr', 'status', 'pr')}, {top_sql('y', 'tr', 'status', 'yr')},
    h as (select string_agg('  ' || g || ': ' || cnt || ' (' || {PCT.format('cnt / n')} || ')', chr(10) order by cnt desc, f) as x
          from dist, n),
    parts as (select bs._row_id, string_agg(chr(10) || '[status = ' || dist.g || '] (n=' || dist.cnt || ', ' ||
        {PCT.format('dist.cnt / n.n')} || '):' || chr(10) || '  Numerical features:' || chr(10) || '    price:' || chr(10) || num1 ||
        chr(10) || '    cust:' || chr(10) || num2 || chr(10) || '  Categorical features (top 5):' || chr(10) ||
        {own_sql('priority', 'p', 'bs.pr')} || chr(10) || {own_sql('yr', 'y', 'bs.yr')}, chr(10) order by dist.f) as x
        from bs cross join dist join pt on pt.g = dist.g join yt on yt.g = dist.g
        left join pv on pv.g = dist.g and pv.v = bs.pr left join yv on yv.g = dist.g and yv.v = bs.yr, n group by 1)
    select b._row_id, s.split, b._row_id as pos, 'You are an order clerk.{BOTH}' as instruction,
    '=== Dataset Statistics (from training set, per-class) ===' || chr(10) || 'Total training samples: ' || n.n || chr(10) ||
    chr(10) || 'Target distribution (status):' || chr(10) || h.x || chr(10) || chr(10) || '--- Statistics by Target Class ---' ||
    chr(10) || parts.x{GAP}{SAMPLE_TITLE}{ORDER_TEXT}{GAP}c.cases as input, lower(b.status) as output
    from base b join splits s on s._row_id = b._row_id join parts on parts._row_id = b._row_id
    join cases c on c.query_id = b._row_id, n, h""")
def _(spark, d):
    table_, spec = project(base(spark, d, "orders_status"), SPECS["orders_status"]), SPECS["orders_status"]
    options = CorpusSpec(with_stats=True, per_group=True, with_cases=True, balanced=True, cases_after_query=True)
    return build_corpus(table_, splits_of(table_, "status"), spec, STATUS_TASK, options)


PART_TEXT = "'size is ' || cast(size as varchar) || '. type is ' || type || '. brand is ' || brand"
PART_CASES = f"""{train_sql('part_price', 'type')}, {vectors_sql('train', 'train', ['size'], ['type', 'brand'], 'price')},
    {vectors_sql('base', 'train', ['size'], ['type', 'brand'], 'price')}, {pairs_sql('basev', 'trainv', 1, 2, 5)},
    knn as (with {two_class_sql(5, 'y > median(y) over (partition by qid)')}),
    txt as (select _row_id as tid, {PART_TEXT} as features, 'The price is $' || format('{{:,}}', round_even(price, 0)::bigint) || '.' as truth
        from train),
    cases as (select query_id, '=== Similar Historical Cases ===' || chr(10) || string_agg('Example ' || rank || ' (similarity: ' ||
       printf('%.3f', sim) || '):' || chr(10) || '  Features: ' || features || chr(10) || '  Ground truth: ' || truth, chr(10) order by rank) as cases
       from (select knn.*, p.sim from knn join pairs p on p.qid = knn.query_id and p.tid = knn.train_id) k
       join txt on txt.tid = k.train_id group by 1)"""


@query("corpus_regression", f"""{PART_CASES}, e as (select quantile_cont(price, [0.0, 0.25, 0.5, 0.75, 1.0]) as q from train),
    tr as (select train.*, 1 + (price > q[2])::int + (price > q[3])::int + (price > q[4])::int as bin from train, e),
    n as (select count(*) as n from tr), dist as (select bin as g, count(*) as cnt, {numbers_text('size', '      ')} as num from tr group by 1),
    {top_sql('t', 'tr', 'bin', 'type')}, {top_sql('b', 'tr', 'bin', 'brand')},
    parts as (select r._row_id, string_agg(chr(10) || 'Q' || dist.g || ' (' || (dist.g - 1) * 25 || '%-' || dist.g * 25 || '%): price in (' ||
       printf('%.1f', q[dist.g]) || ', ' || printf('%.1f', q[dist.g + 1]) || '] (n=' || dist.cnt || ', ' || {PCT.format('dist.cnt / n.n')} || ')' ||
       chr(10) || '  Numerical features:' || chr(10) || '    size:' || chr(10) || dist.num || chr(10) || '  Categorical features (top 5):' || chr(10) ||
       {own_sql('type', 't', 'r.type')} || chr(10) || {own_sql('brand', 'b', 'r.brand')}, chr(10) order by dist.g) as x
       from base r cross join dist join tt on tt.g = dist.g join bt on bt.g = dist.g left join tv on tv.g = dist.g and tv.v = r.type
       left join bv on bv.g = dist.g and bv.v = r.brand, n, e group by 1)
    select b._row_id, s.split, b._row_id as pos, 'You price parts.{BOTH}' as instruction,
    '=== Dataset Statistics (from training set, per-bin) ===' || chr(10) || 'Total training samples: ' || n.n || chr(10) || chr(10) ||
    '--- Statistics by price Percentile Bin (p0=' || printf('%.2f', q[1]) || ', p25=' || printf('%.2f', q[2]) || ', p50=' || printf('%.2f', q[3]) ||
    ', p75=' || printf('%.2f', q[4]) || ', p100=' || printf('%.2f', q[5]) || ') ---' || chr(10) || parts.x{GAP}c.cases{GAP}{SAMPLE_TITLE}
    {PART_TEXT} as input, printf('%.2f', price) as output from base b join splits s on s._row_id = b._row_id
    join parts on parts._row_id = b._row_id join cases c on c.query_id = b._row_id, n, e""")
def _(spark, d):
    table_, spec = project(base(spark, d, "part_price"), SPECS["part_price"]), SPECS["part_price"]
    options = CorpusSpec(with_stats=True, per_group=True, with_cases=True, balanced=True, n_cases=5)
    return build_corpus(table_, splits_of(table_, "type"), spec, PRICE_TASK, options)


# ---------------------------------------------------------------- label lines and responses

LINE = "THE GIVEN PREDICTION LABEL is "
NL = "chr(10)"
PROMPT = f"""case o_orderkey % 4 when 0 then 'Stats' || {NL} || {NL} || '--- Current Sample Features ---' || {NL} || 'a is ' || o_custkey ||
    {NL} || {NL} || '{LINE}' || o_orderstatus || '.' when 1 then 'a is ' || o_custkey || {NL} when 2 then '' else
    'x' || {NL} || {NL} || {NL} || {NL} || 'y is ' || o_custkey || {NL} || '{LINE}old.' || {NL} || 'z ' end"""
PROMPT_SPARK = PROMPT.replace("chr(10)", "'\\n'").replace("|| o_custkey", "|| cast(o_custkey as string)")


APPENDED = f"""select o_orderkey, case when p = '' then '{LINE}' || o_orderstatus || '.' when p like '%{LINE}%' then p
    when p like '%' || chr(10) then p || '{LINE}' || o_orderstatus || '.' else p || chr(10) || chr(10) || '{LINE}' || o_orderstatus || '.' end as text
    from (select *, {PROMPT} as p from orders)"""


@query("append_label", APPENDED)
def _(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", R.append_label(F.expr(PROMPT_SPARK), F.col("o_orderstatus")).alias("text"))


@query("strip_label", f"""select o_orderkey, trim(regexp_replace(regexp_replace(p, '(?m)^\\s*{LINE}.*$', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'),
    chr(10) || ' ') as text from (select *, {PROMPT} as p from orders)""")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", R.strip_label(F.expr(PROMPT_SPARK)).alias("text"))


@query("extract_features_text", """select o_orderkey, case when o_orderkey % 4 = 0 then 'a is ' || o_custkey end as text from orders""")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", R.features_text(F.expr(PROMPT_SPARK)).alias("text"))


RAW = """case o_orderkey % 8
    when 0 then '<|channel|>analysis<|message|> deep ' || o_orderstatus || ' <|end|><|start|>assistant<|channel|>final<|message|> Prediction is ' || o_orderstatus || '. '
    when 1 then 'analysis think ' || o_orderstatus || ' assistantfinal Prediction is P.'
    when 2 then '<think> why </think>' || chr(13) || chr(10) || 'Prediction is ' || o_orderstatus || '.'
    when 3 then 'Analysis so Prediction is O.'
    when 4 then 'said assistant Final: Prediction is F.'
    when 5 then 'x <|channel|> final Prediction is P.'
    when 6 then ' nothing here ' else 'why <\\/think> ok' end"""
RAW_SPARK = RAW.replace("chr(13) || chr(10)", "'\\r\\n'").replace("<\\/think>", "<\\\\/think>")
FINAL_SQL = """case o_orderkey % 8 when 0 then 'Prediction is ' || o_orderstatus || '.' when 1 then 'Prediction is P.'
    when 2 then 'Prediction is ' || o_orderstatus || '.' when 3 then 'so Prediction is O.' when 4 then ': Prediction is F.'
    when 5 then 'Prediction is P.' when 6 then 'nothing here' else 'ok' end"""
THINK_SQL = """case o_orderkey % 8 when 0 then 'deep ' || o_orderstatus when 1 then 'think ' || o_orderstatus when 2 then '<think> why'
    when 7 then 'why' end"""


@query("split_response", f"""select o_orderkey, {THINK_SQL} as think, {FINAL_SQL} as final, case when {THINK_SQL} is null then {FINAL_SQL} else
    '<|channel|>analysis<|message|>' || {THINK_SQL} || '<|end|><|start|>assistant<|channel|>final<|message|>' || {FINAL_SQL} end as merged from orders""")
def _(spark, d):
    raw = table(spark, d, "orders").select("o_orderkey", F.expr(RAW_SPARK).alias("raw"))
    return split_responses(raw).drop("raw")


def said(words: list[str], default: str) -> str:
    """Response text cycling through the given forms by row."""
    whens = " ".join(f"when {i} then {w}" for i, w in enumerate(words))
    return f"case o_orderkey % {len(words) + 1} {whens} else {default} end"


YN = "case when o_custkey % 2 = 0 then 'Yes' else 'no' end"
YES_NO_TEXT = said(
    [
        f"'Why' || chr(10) || '  **Prediction is ** ' || {YN} || '.'",
        f"'prediction is no' || chr(10) || 'PREDICTION  IS ' || {YN} || '.'",
        f"'so my prediction is ' || {YN} || '!'",
        "'Prediction is nobody.'",
    ],
    "'no line'",
)


@query("parse_yes_no", f"""select o_orderkey, case when o_orderkey % 5 < 3 then lower({YN}) end as label from orders""")
def _(spark, d):
    text = F.expr(YES_NO_TEXT.replace("chr(10)", "'\\n'"))
    return table(spark, d, "orders").select("o_orderkey", R.parse_yes_no(text).alias("label"))


BIT = "cast(o_custkey % 2 as string)"
DIGIT_TEXT = said(
    [f"'Prediction is: ' || {BIT}", f"'Prediction is **：** ' || {BIT} || '.'", f"'Prediction is yes' || chr(10) || 'prediction is ' || {BIT}",
     f"'a prediction is ' || {BIT} || ' or not'", "'Prediction is 10'"],
    "''",
)


@query("parse_yes_no_digit", """select o_orderkey, case o_orderkey % 6 when 2 then 'yes' when 4 then null when 5 then null else
    case when o_custkey % 2 = 1 then 'yes' else 'no' end end as label from orders""")
def _(spark, d):
    text = F.expr(DIGIT_TEXT.replace("chr(10)", "'\\n'"))
    return table(spark, d, "orders").select("o_orderkey", R.parse_yes_no_or_digit(text).alias("label"))


@query("parse_multiclass", """select o_orderkey, case o_orderkey % 5 when 0 then 'non_stem' when 1 then 'student' when 2 then 'stem' when 3 then 'stem' end as job,
    case o_orderkey % 4 when 0 then '<30' when 1 then '>30' when 2 then 'NO' end as readmitted from orders""")
def _(spark, d):
    job = said(["'Prediction is Non-STEM.'", "'Prediction is stem.\\nprediction is **Student**'", "'I say prediction is stem'",
                "'Prediction is stem.\\nPrediction is lawyer.'"], "'Prediction is unknown'")
    stay = "case o_orderkey % 4 when 0 then 'Prediction is <30.' when 1 then 'well\\n**Prediction is >30**' when 2 then 'my prediction is no.' else 'Prediction is 30.' end"
    return table(spark, d, "orders").select(
        "o_orderkey",
        R.parse_class(F.expr(job), JOB_TOKEN, lambda v: R.normalize_class(v, JOB_LABELS)).alias("job"),
        R.parse_class(F.expr(stay), READMISSION_TOKEN, lambda v: R.normalize_exact(v, READMISSION_LABELS)).alias("readmitted"),
    )


@query("parse_numeric", """select o_orderkey, case o_orderkey % 6 when 0 then o_custkey + 0.5 when 1 then 1000000.0 + o_custkey % 10 when 2 then -1200.0
    when 3 then 7.0 when 4 then cast(o_custkey as double) end as x from orders""")
def _(spark, d):
    text = said(["'Prediction is $' || cast(o_custkey as string) || '.5.'", "'(1) 5\\nvalue: 1,000,00' || cast(o_custkey % 10 as string)",
                 "'**Estimate** is 3\\n**Estimate = -1.2e3'", "'the output is 6 then output is 7'", "'Prediction is ' || cast(o_custkey as string) || '.'"],
                "'about 12 dollars'")
    return table(spark, d, "orders").select("o_orderkey", R.parse_numeric(F.expr(text)).alias("x"))


@query("chat_messages", f"""select o_orderkey as _row_id, 2 as n, 'system' as first_role, 'Explain.' as first, 'user' as second_role,
    text as second from ({APPENDED})""")
def _(spark, d):
    o = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("_row_id"), F.lit("Explain.").alias("instruction"), F.expr(PROMPT_SPARK).alias("input"),
        F.col("o_orderstatus").alias("output"),
    )
    said_, first, second = F.col("messages"), F.get("messages", F.lit(0)), F.get("messages", F.lit(1))
    return to_messages(o).select(
        "_row_id",
        F.size(said_).alias("n"),
        first["role"].alias("first_role"),
        first["content"].alias("first"),
        second["role"].alias("second_role"),
        second["content"].alias("second"),
    )


@query("render_similarity_format", "select o_orderkey, '(similarity: ' || printf('%.3f', o_custkey / 1500.0) || '):' as text from orders")
def _(spark, d):
    s = F.concat(F.lit("(similarity: "), fmt_fixed(F.col("o_custkey") / 1500.0, 3), F.lit("):"))
    return table(spark, d, "orders").select("o_orderkey", s.alias("text"))
