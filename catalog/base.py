"""Registry and the fixture tables shared by queries and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.operators.joins import with_split
from corpusforge.operators.splits import stratified_split
from corpusforge.session import materialize
from corpusforge.spec import BINARY, MULTICLASS, REGRESSION, TableSpec

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# Fixture tables: plain SELECTs valid in Spark and DuckDB. Some values are made missing by formula,
# because the generated tables have no NULLs.
BASES = {
    "orders_status": """
        select o_orderkey as _row_id,
               case when o_orderkey % 13 = 0 then null else o_totalprice end as price,
               o_custkey as cust,
               case when o_orderkey % 17 = 0 then null when o_orderkey % 19 = 0 then '?' else o_orderpriority end as priority,
               cast(year(o_orderdate) as string) as yr,
               o_orderstatus as status
        from {orders}""",
    "orders_price": """
        select o_orderkey as _row_id, o_custkey as cust,
               case when o_orderkey % 17 = 0 then null when o_orderkey % 19 = 0 then '?' else o_orderpriority end as priority,
               o_orderstatus as status, o_totalprice as price
        from {orders}""",
    "customer_segment": """
        select c_custkey as _row_id, c_acctbal as acctbal, cast(c_nationkey as string) as nation, c_mktsegment as segment
        from {customer}""",
    "part_price": """
        select p_partkey as _row_id, p_size as size, p_type as type, p_brand as brand, p_retailprice as price
        from {part}""",
    "doc_quality": """
        select d.doc_id as _row_id, d.n_chars as n_chars, d.lang as lang, d.source as source, l.quality as quality
        from {labels} l join {documents} d on l.doc_id = d.doc_id""",
    "doc_toxic": """
        select d.doc_id as _row_id, d.n_chars as n_chars, d.lang as lang, d.source as source, l.toxic as toxic
        from {labels} l join {documents} d on l.doc_id = d.doc_id""",
    "doc_lang": """
        select doc_id as _row_id, n_chars, source, lang from {documents}""",
    "event_type": """
        select event_id as _row_id, value, cast(user_id as string) as user_id, event_type from {events}""",
    "line_flag": """
        select l_orderkey as _row_id, l_quantity as quantity, l_extendedprice as extendedprice, l_discount as discount,
               l_tax as tax, l_linestatus as linestatus, l_returnflag as returnflag
        from {lineitem}""",
}

SPECS = {
    "orders_status": TableSpec("orders_status", "status", MULTICLASS, ("priority", "yr"), ("price", "cust")),
    "orders_price": TableSpec("orders_price", "price", REGRESSION, ("priority", "status"), ("cust",)),
    "customer_segment": TableSpec("customer_segment", "segment", MULTICLASS, ("nation",), ("acctbal",)),
    "part_price": TableSpec("part_price", "price", REGRESSION, ("type", "brand"), ("size",)),
    "doc_quality": TableSpec("doc_quality", "quality", BINARY, ("lang", "source"), ("n_chars",)),
    "doc_toxic": TableSpec("doc_toxic", "toxic", BINARY, ("lang", "source"), ("n_chars",)),
    "doc_lang": TableSpec("doc_lang", "lang", BINARY, ("source",), ("n_chars",)),
    "event_type": TableSpec("event_type", "event_type", MULTICLASS, ("user_id",), ("value",)),
    "line_flag": TableSpec(
        "line_flag", "returnflag", MULTICLASS, ("linestatus",), ("quantity", "extendedprice", "discount", "tax")
    ),
}


def base(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.sql(BASES[name].format(**{t: f"parquet.`{folder}/{t}.parquet`" for t in TABLES}))


def base_sql(name: str) -> str:
    return BASES[name].format(**{t: t for t in TABLES})


def train_of(df: DataFrame, strata: str) -> DataFrame:
    """Training rows of the seeded stratified split."""
    return with_split(df, splits_of(df, strata), "train").drop("split")


def splits_of(df: DataFrame, strata: str) -> DataFrame:
    """The split table, stored as a user would store it."""
    return materialize(stratified_split(df, strata))


def split_sql(source: str, strata: str, prefix: str = "") -> str:
    """CTEs ending in ``{prefix}splits(_row_id, split)`` for the stratified split of CTE ``source``."""
    p = prefix
    return f"""
    {p}s0 as (select {strata} as s, count(*) as c from {source} group by 1),
    {p}s1 as (select *, (sum(c) over () + 9) // 10 as t, sum(c) over () as n from {p}s0),
    {p}s2 as (select s, c, t, (c * t) // n as b, (c * t) % n as r from {p}s1),
    {p}s3 as (select s, c, b + case when row_number() over (order by r desc, s) <= t - sum(b) over () then 1 else 0 end as k1
              from {p}s2),
    {p}s4 as (select *, c - k1 as c2, sum(c - k1) over () as n2, (sum(c - k1) over () + 8) // 9 as t2 from {p}s3),
    {p}s5 as (select s, c, k1, t2, (c2 * t2) // n2 as b2, (c2 * t2) % n2 as r2 from {p}s4),
    {p}s6 as (select s, c, k1,
                     b2 + case when row_number() over (order by r2 desc, s) <= t2 - sum(b2) over () then 1 else 0 end as k2
              from {p}s5),
    {p}ranked as (select _row_id, {strata} as s,
                         row_number() over (partition by {strata} order by md5('42|split|' || cast(_row_id as varchar)), _row_id)
                         as k from {source}),
    {p}splits as (select a._row_id, case when a.k <= q.k1 then 'test' when a.k <= q.k1 + q.k2 then 'valid' else 'train' end
                         as split from {p}ranked a join {p}s6 q on a.s is not distinct from q.s)"""


def train_sql(name: str, strata: str) -> str:
    """CTEs ``base`` and ``train``."""
    return f"""with base as ({base_sql(name)}), {split_sql('base', strata)},
    train as (select b.* from base b join splits p on b._row_id = p._row_id where p.split = 'train')"""


def cat_sql(col: str) -> str:
    return f"coalesce(nullif({col}, '?'), 'missing')"


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Doubles rounded, so that the order of partial sums cannot show."""
    doubles = [c for c, t in df.dtypes if t == "double"]
    return df.withColumns({c: F.round(F.col(c), special.get(c, digits)) for c in doubles}) if doubles else df


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)
