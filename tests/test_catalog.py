"""Every registered query against its SQL."""

import duckdb
import pytest

from corpusloom import catalog

SLOW_SQL = {"trigram_similarity", "hybrid_search", "search_in_library", "search_by_role", "search_progressive", "local_sources", "harvest"}


def norm(rows):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, name):
    got = catalog.QUERIES[name](spark, sf)
    cols = sorted(got.columns)
    rows = got.select(*cols).collect()
    assert rows  # a match of nothing with nothing would show nothing
    if name in catalog.ORACLE_SQL:
        con = duckdb.connect()
        for t in ("documents", "pages", "benchmark", "events", "part"):
            con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
        want = con.execute("select " + ", ".join(f'"{c}"' for c in cols) + f" from ({catalog.ORACLE_SQL[name]})").fetchall()
        assert norm(map(tuple, rows)) == norm(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
