"""Every registered query against its DuckDB twin on the smallest driver tables
(the driver repeats this at sf0.01): same columns, rows and value hash."""
import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF
from tools.oracle_compare import TABLES, digest

QUERIES = E.queries()
ORACLE = E.oracle_sql()
SLOW = {"o_m4_train_classifier", "o_m5_candidate_models"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF['0.001']}/{t}.parquet')")
    return con


def test_every_query_registered_with_oracle_or_rows_only():
    missing = set(ORACLE) - set(QUERIES)
    assert not missing
    own = {q for q in QUERIES if q.startswith("o_")}
    assert own - set(ORACLE) == SLOW


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and df.columns[0] == "label"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF["0.001"])
    rows = [tuple(r) for r in df.collect()]
    res = duck.execute(ORACLE[name])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert digest(df.columns, rows)[0] == digest(ocols, orows)[0]
