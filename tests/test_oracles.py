"""Every query with oracle SQL against DuckDB, on the smallest tables."""

import math
import os
from collections import Counter

import duckdb
import pytest

from examloom.plans.registry import ORACLE_SQL, QUERIES

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def flat(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, list | tuple):
        return tuple(map(flat, v))
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, D)
    cols = sorted(df.columns)
    rows = df.collect()
    if name not in ORACLE_SQL:
        assert cols and (rows or name in ("fuzzy_pairs", "fuzzy_greedy_dedup"))
        return
    got = Counter(repr(tuple(flat(r[c]) for c in cols)) for r in rows)
    cur = duck.execute(ORACLE_SQL[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == Counter(repr(tuple(flat(r[i]) for i in at)) for r in cur.fetchall())


def test_entry_without_training_data_operators():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
