"""Similar training rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import SPECS, base, base_sql, cat_sql, query, rounded, train_of, train_sql
from corpusforge.operators.retrieval import (
    choose_prefix,
    neighbors,
    random_neighbors,
    scale_params,
    similar_rows,
    unit_vectors,
)
from corpusforge.spec import TableSpec

# ---------------------------------------------------------------- SQL pieces


def vectors_sql(source: str, train: str, nums: list[str], cats: list[str], target: str) -> str:
    """CTE ``{source}v``: normalised categories ``c0..``, unit vector ``u0..``, target."""
    mean = ", ".join(
        f"printf('%.10e', avg({c}))::double as m{i}, "
        f"coalesce(nullif(printf('%.10e', stddev_samp({c}))::double, 0), 1) as d{i}"
        for i, c in enumerate(nums)
    )
    z = ", ".join(f"(coalesce(cast({c} as double), m{i}) - m{i}) / d{i} as z{i}" for i, c in enumerate(nums))
    norm = " + ".join(f"z{i} * z{i}" for i in range(len(nums)))
    u = ", ".join(f"z{i} / n as u{i}" for i in range(len(nums)))
    c = ", ".join(f"{cat_sql(x)} as c{i}" for i, x in enumerate(cats))
    lead = f"{c}, " if cats else ""
    names = "".join(f"c{i}, " for i in range(len(cats)))
    return f"""{source}p as (select {mean} from {train}),
    {source}z as (select _row_id, {lead}{z}, {target} as y from {source}, {source}p),
    {source}n as (select *, coalesce(nullif(sqrt({norm}), 0), 1) as n from {source}z),
    {source}v as (select _row_id, {names}{u}, y from {source}n)"""


def pairs_sql(queries: str, train: str, dims: int, cats: int, n: int) -> str:
    """CTEs ``depths`` and ``pairs(qid, tid, sim, y, qy)`` for vectors of queries and training rows."""
    counts, when, joins = "", "", ""
    for k in range(cats, 0, -1):
        cols = ", ".join(f"c{i}" for i in range(k))
        counts += f"g{k} as (select {cols}, count(*) as cnt from {train} group by {cols}),\n"
        when += f" when g{k}.cnt > {n} then {k}"
        joins += f" left join g{k} on " + " and ".join(f"g{k}.c{i} = q.c{i}" for i in range(k))
    depth = f"case{when} else 0 end" if cats else "0"
    dot = " + ".join(f"q.u{i} * t.u{i}" for i in range(dims))
    parts = []
    for k in range(cats + 1):
        same = "".join(f" and q.c{i} = t.c{i}" for i in range(k))
        parts.append(
            f"select q._row_id as qid, t._row_id as tid, {dot} as sim, t.y as y, q.y as qy from depths q join {train} t "
            f"on q._row_id <> t._row_id{same} where q.depth = {k}"
        )
    return f"""{counts} depths as (select q.*, {depth} as depth from {queries} q{joins}),
    pairs as ({' union all '.join(parts)})"""


OUT = "select qid as query_id, tid as train_id, round(sim, 9) as similarity, rank from"
ORDER = "order by sim desc, tid"


def top_sql(n: int) -> str:
    return f"{OUT} (select *, row_number() over (partition by qid {ORDER}) as rank from pairs) where rank <= {n}"


def two_class_sql(n: int, is_one: str) -> str:
    """Class-balanced selection over ``pairs``; ``is_one`` may use windows over a query's candidates."""
    return f"""classed as (select *, {is_one} as one from pairs),
    r as (select *, row_number() over (partition by qid, one {ORDER}) as r from classed),
    m as (select *, r <= case when one then {n // 2} else {n // 2 + n % 2} end as inside from r),
    f as (select *, row_number() over (partition by qid order by not inside, sim desc, tid) as o from m),
    s as (select * from f where o <= {n})
    {OUT} (select *, row_number() over (partition by qid {ORDER}) as rank from s)"""


def many_class_sql(n: int) -> str:
    return f"""valid as (select * from pairs where y is not null),
    k as (select qid, count(distinct y) as k from valid group by 1),
    r as (select v.*, k.k, row_number() over (partition by v.qid, v.y {ORDER}) as r from valid v join k using (qid)),
    a as (select *, r <= {n} // k as inside, r = {n} // k + 1 as candidate from r),
    b as (select *, row_number() over (partition by qid, candidate {ORDER}) as cr from a),
    c as (select *, case when inside then 0 when candidate and cr <= {n} % k then 1 else 2 end as turn from b),
    f as (select *, row_number() over (partition by qid order by case when k <= 1 then 0 else turn end, sim desc, tid) as o from c),
    s as (select * from f where o <= {n})
    {OUT} (select *, row_number() over (partition by qid {ORDER}) as rank from s)"""


def knn_sql(name: str, strata: str, n: int, selection: str, nums: list[str], cats: list[str], target: str) -> str:
    return f"""{train_sql(name, strata)}, {vectors_sql('train', 'train', nums, cats, target)},
    {pairs_sql('trainv', 'trainv', len(nums), len(cats), n)}{', ' if not selection.startswith('select') else ' '}{selection}"""


def found(df):
    return rounded(df, 9)


# ---------------------------------------------------------------- queries


@query("knn_unit_vectors", f"""{train_sql('orders_status', 'status')}, {vectors_sql('train', 'train', ['price', 'cust'], [], 'status')}
    select _row_id, round(u0, 9) as u0, round(u1, 9) as u1 from trainv""")
def _(spark, d):
    train = train_of(base(spark, d, "orders_status"), "status")
    params = scale_params(train, ["price", "cust"]).first().asDict()
    vec = unit_vectors(train, params, ["price", "cust"])
    return rounded(vec.select("_row_id", F.get("vec", F.lit(0)).alias("u0"), F.get("vec", F.lit(1)).alias("u1")), 9)


@query("knn_prefix_depth", f"""{train_sql('orders_status', 'status')},
    {vectors_sql('train', 'train', ['cust'], ['priority', 'yr'], 'status')}, {pairs_sql('trainv', 'trainv', 1, 2, 200)}
    select distinct c0 as priority, c1 as yr, cast(depth as bigint) as depth from depths""")
def _(spark, d):
    train = train_of(base(spark, d, "orders_status"), "status")
    return choose_prefix(train, train, ["priority", "yr"], 200)[0].drop("group")


@query("knn_topn", knn_sql("orders_status", "status", 16, top_sql(16), ["price", "cust"], ["priority", "yr"], "status"))
def _(spark, d):
    train = train_of(base(spark, d, "orders_status"), "status")
    return found(neighbors(train, train, SPECS["orders_status"], 16, exclude_self=True))


@query("knn_balanced_multi", knn_sql("orders_status", "status", 16, many_class_sql(16), ["price", "cust"], ["priority", "yr"], "status"))
def _(spark, d):
    train = train_of(base(spark, d, "orders_status"), "status")
    return found(neighbors(train, train, SPECS["orders_status"], 16, balanced=True, exclude_self=True))


@query("knn_balanced_median", knn_sql("part_price", "type", 5, two_class_sql(5, "y > median(y) over (partition by qid)"),
                                      ["size"], ["type", "brand"], "price"))
def _(spark, d):
    train = train_of(base(spark, d, "part_price"), "type")
    return found(neighbors(train, train, SPECS["part_price"], 5, balanced=True, exclude_self=True))


@query("knn_balanced_binary", knn_sql("doc_quality", "quality", 6, two_class_sql(6, "y > median(y) over (partition by qid)"),
                                      ["n_chars"], ["lang", "source"], "quality"))
def _(spark, d):
    train = train_of(base(spark, d, "doc_quality"), "quality")
    return found(neighbors(train, train, SPECS["doc_quality"], 6, balanced=True, exclude_self=True))


LABEL_SPLIT_SQL = two_class_sql(6, "y = w").replace("from pairs)", "from pairs join w using (qid))", 1)


@query("knn_balanced_labels", knn_sql("doc_lang", "lang", 6, f"""lab as (select qid, y, count(*) as cnt from pairs group by 1, 2),
    w as (select qid, case when count(*) = 2 then max(y) else arg_min(y, (-cnt, y)) end as w from lab group by 1),
    {LABEL_SPLIT_SQL}""", ["n_chars"], ["source"], "lang"))
def _(spark, d):
    train = train_of(base(spark, d, "doc_lang"), "lang")
    return found(neighbors(train, train, SPECS["doc_lang"], 6, balanced=True, exclude_self=True))


OTHER_SQL = f"""{train_sql('customer_segment', 'segment')}, {vectors_sql('train', 'train', ['acctbal'], ['nation'], 'segment')},
    {vectors_sql('base', 'train', ['acctbal'], ['nation'], 'segment')},
    {pairs_sql('basev', 'trainv', 1, 1, 16)} {top_sql(16)}"""


@query("knn_all_splits", OTHER_SQL)
def _(spark, d):
    df = base(spark, d, "customer_segment")
    return found(neighbors(df, train_of(df, "segment"), SPECS["customer_segment"], 16, exclude_self=True))


@query("knn_keep_empty", f"""{train_sql('customer_segment', 'segment')}, {vectors_sql('train', 'train', ['acctbal'], ['nation'], 'segment')},
    {vectors_sql('base', 'train', ['acctbal'], ['nation'], 'segment')}, {pairs_sql('basev', 'trainv', 1, 1, 16)},
    k as (select qid, count(*) as c from pairs group by 1)
    select q._row_id as query_id, cast(q.depth as bigint) as depth, least(coalesce(k.c, 0), 16) as cases
    from depths q left join k on q._row_id = k.qid""")
def _(spark, d):
    df = base(spark, d, "customer_segment")
    cases = similar_rows(df, train_of(df, "segment"), SPECS["customer_segment"], 16, exclude_self=True)
    return cases.select("query_id", "depth", F.size("cases").cast("bigint").alias("cases"))


@query("knn_no_numbers", f"""{train_sql('orders_status', 'status')},
    v as (select _row_id, {cat_sql('priority')} as c0, yr as c1 from train), g as (select c0, c1, count(*) as n from v group by 1, 2),
    g1 as (select c0, count(*) as n from v group by 1),
    p as (select q._row_id as qid, t._row_id as tid, 1.0::double as sim from v q join g on g.c0 = q.c0 and g.c1 = q.c1 join v t
          on t.c0 = q.c0 and t.c1 = q.c1 and t._row_id <> q._row_id where g.n > 8
          union all select q._row_id, t._row_id, 1.0::double from v q join g on g.c0 = q.c0 and g.c1 = q.c1 join g1 on g1.c0 = q.c0
          join v t on t.c0 = q.c0 and t._row_id <> q._row_id where g.n <= 8 and g1.n > 8),
    pairs as (select * from p) {top_sql(8)}""")
def _(spark, d):
    train = train_of(base(spark, d, "orders_status"), "status").select("_row_id", "priority", "yr", "status")
    return found(neighbors(train, train, TableSpec("o", "status", "multiclass", ("priority", "yr"), ()), 8, exclude_self=True))


VECTOR_DIMS = 64
VECTORS = f"""select vec_id as _row_id, label, {', '.join(f'cast(embedding[{{first}} + {i}] as double) as e{i}' for i in range(VECTOR_DIMS))}
    from """


def embedding_sql() -> str:
    names = [f"e{i}" for i in range(VECTOR_DIMS)]
    return f"""with train as ({VECTORS.format(first=1)} embeddings), {vectors_sql('train', 'train', names, [], 'label')},
    {pairs_sql('trainv', 'trainv', VECTOR_DIMS, 0, 16)}, {many_class_sql(16)}"""


@query("knn_embeddings", embedding_sql())
def _(spark, d):
    df = spark.sql(f"{VECTORS.format(first=0)} parquet.`{d}/embeddings.parquet`")
    names = tuple(f"e{i}" for i in range(VECTOR_DIMS))
    spec = TableSpec("vectors", "label", "multiclass", (), names)
    return found(neighbors(df, df, spec, 16, balanced=True, exclude_self=True))


@query("knn_random", f"""{train_sql('orders_status', 'status')},
    r as (select _row_id as tid, row_number() over (order by md5('42|random|' || cast(_row_id as varchar)), _row_id) - 1 as pos from train),
    size as (select count(*) as n from train),
    stride as (select min(s) as step from (select n, unnest(range(greatest(1, floor(n * 0.618::double))::bigint, 2 * n + 2)) as s from size)
        where gcd(s, n) = 1),
    walk as (select b._row_id as qid, t.i, (('0x' || substr(md5('42|start|' || cast(b._row_id as varchar)), 1, 12))::bigint % n + t.i * step) % n as pos
        from base b, size, stride, range(0, 17) t(i)),
    picked as (select qid, tid, row_number() over (partition by qid order by i) as rank from walk join r using (pos) where tid <> qid)
    select qid as query_id, tid as train_id, 1.0::double as similarity, rank from picked where rank <= 16""")
def _(spark, d):
    df = base(spark, d, "orders_status").select("_row_id", "status")
    return random_neighbors(df, train_of(df, "status"), 16, exclude_self=True)
