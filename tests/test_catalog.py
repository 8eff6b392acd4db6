"""Every query that has SQL agrees with it (a tenth of the driver's scale, to stay quick)."""

import pytest

import catalog
from catalog import ORACLES, QUERIES, base
from catalog.verify import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.fixture(scope="module", autouse=True)
def shared_splits():
    """Queries over one fixture table share its stored split table here; the driver runs them one by one."""
    plain, kept = base.splits_of, {}

    def once(df, strata):
        at = (df.semanticHash(), strata)
        if at not in kept:
            kept[at] = plain(df, strata)
        return kept[at]

    modules = [m for m in vars(catalog).values() if getattr(m, "splits_of", None) is plain]
    for m in modules:
        m.splits_of = once
    yield
    for m in modules:
        m.splits_of = plain


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    rows = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        assert rows
        return
    cur = duck.execute(ORACLES[name])
    want, columns = cur.fetchall(), [c[0] for c in cur.description]
    assert compare(df.columns, rows, columns, want) == ""


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
