"""Queries over tables in which track ids recur among albums, against their SQL."""

import os

import duckdb
import pytest

from test_oracles import DIR, ORACLES, QUERIES, rows

#: Orders and parts of such numbers that an id of an order and a part is also that of its neighbour.
RECURRING = """select * from '{0}/lineitem.parquet' union all select * replace (l_orderkey - 1 as l_orderkey, l_partkey + 1000000 as l_partkey, l_extendedprice * 1.5 as l_extendedprice, 'A' as l_returnflag)
    from '{0}/lineitem.parquet' where l_orderkey % 3 = 1"""


@pytest.fixture(scope="module")
def recurring(tmp_path_factory):
    out, con = str(tmp_path_factory.mktemp("recurring")), duckdb.connect()
    con.execute("set timezone = 'UTC'")
    part = "select * from '{0}/part.parquet' union all select * replace (p_partkey + 1000000 as p_partkey) from '{0}/part.parquet'"
    for f in os.listdir(DIR):
        name = f.removesuffix(".parquet")
        sql = {"lineitem": RECURRING, "part": part}.get(name, f"select * from '{{0}}/{f}'")
        con.execute(f"copy ({sql.format(DIR)}) to '{out}/{f}'")
        con.execute(f"create view {name} as select * from '{out}/{f}'")
    return out, con


def same(spark, recurring, name):
    out, con = recurring
    assert rows(QUERIES[name](spark, out).toPandas()) == rows(con.execute(ORACLES[name]).df())


@pytest.mark.parametrize("name", ["combined_stats", "write_stats_json", "albums_untagged"])
def test_statistics(spark, recurring, name):
    same(spark, recurring, name)


def test_matches_of_pills(spark, recurring):
    same(spark, recurring, "pill_match")


@pytest.mark.parametrize("name", ["precheck_status", "precheck_tracks"])
def test_prechecks(spark, recurring, name):
    same(spark, recurring, name)


@pytest.mark.parametrize("name", ["rescore_merge", "rescore_stale", "score_tracks"])
def test_rescoring(spark, recurring, name):
    same(spark, recurring, name)
