import os
import re

import duckdb
import pytest

SOURCE = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

pytestmark = pytest.mark.skipif(not os.path.isdir(SOURCE), reason="no tables")


def copies(folder, **more):
    """The tables twice, the second time with shifted keys; names stay, so that customers and suppliers share ids. more: what is selected instead of a table."""
    shift = {"customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey, o_custkey", "lineitem": "l_orderkey, l_partkey, l_suppkey", "events": "user_id"}
    for t in TABLES:
        both = ", ".join(f"{c} + 1000000 * k as {c}" for c in shift.get(t, "").split(", ") if c)
        sql = f"select * exclude (k) replace ({both}) from '{SOURCE}/{t}.parquet', range(2) r(k)" if both else f"select * from '{SOURCE}/{t}.parquet'"
        duckdb.execute(f"copy ({more[t].format(f'({sql})') if t in more else sql}) to '{folder}/{t}.parquet'")
    return str(folder)


@pytest.fixture(scope="module")
def twice(tmp_path_factory):
    return copies(tmp_path_factory.mktemp("twice"))


@pytest.fixture(scope="module")
def moved(tmp_path_factory):
    """Customers of equal names are in different nations."""
    return copies(tmp_path_factory.mktemp("moved"), customer="select * replace (case when c_custkey < 1000000 then (c_nationkey + 2) % 25 else c_nationkey end as c_nationkey) from {}")


def same(spark, name, folder):
    from arcwright.plans import catalog_more

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    found = catalog_more.QUERIES[name](spark, folder)
    columns = sorted(found.columns)
    want = con.execute(f"select {', '.join(chr(34) + c + chr(34) for c in columns)} from ({catalog_more.SQL[name]})").fetchall()
    assert sorted(map(str, (tuple(r) for r in found.select(columns).collect()))) == sorted(map(str, want))


@pytest.mark.parametrize("name", ["sample_whole", "external_filter"])
def test_edges_of_equal_ids(spark, twice, name):
    same(spark, name, twice)


def test_edges_of_odd_tables(spark, tmp_path):
    """Names that are missing, a brand that differs by a sign that ids replace, and a supplier's key with two names."""
    odd = copies(
        tmp_path, customer="select * replace (case when c_custkey % 7 = 0 then null else c_name end as c_name) from {}", part="select * from {0} union all select * replace (replace(p_brand, '#', '_') as p_brand) from {0}",
        supplier="select * from {0} union all select * replace (s_name || 'b' as s_name, s_acctbal + 1 as s_acctbal) from {0} where s_suppkey % 3 = 0",
    )
    same(spark, "sample_whole", odd)


def written(spark):
    from arcwright.operators.durable import shared_folder

    return {f for f in os.listdir(shared_folder(spark).removeprefix("file:")) if f.startswith(("graph-", "edges-"))}


def test_queries_derive_what_they_read(spark):
    """No graph is written for one scan, edges between ids aren't sorted or spread by id, and types that are left out aren't derived."""
    from arcwright.plans.catalog import QUERIES

    before = written(spark)
    for name, exchanges in (("split_project", 4), ("external_filter", 40)):
        plan = QUERIES[name](spark, SOURCE)._jdf.queryExecution().executedPlan().toString()
        assert "rangepartitioning" not in plan and plan.count("Exchange hashpartitioning") <= exchanges, plan
    plan = QUERIES["view_links"](spark, SOURCE)._jdf.queryExecution().executedPlan().toString()
    assert "l_orderkey" not in plan and "l_partkey#" not in plan
    assert written(spark) == before


@pytest.mark.parametrize("name", ["diff_counts", "diff_added_edges"])
def test_snapshots_are_told_apart_by_keys(spark, twice, name):
    """Edges of snapshots of one table aren't compared, nor joined with the nodes that went."""
    from arcwright.plans.catalog import QUERIES

    assert not re.search(r"Join \[[^\]]*(from_id|to_id)", QUERIES[name](spark, twice)._jdf.queryExecution().executedPlan().toString())
    same(spark, name, twice)


@pytest.mark.parametrize("name, which", [("rank_topk_seeds", "twice"), ("rank_topk_seeds", "moved"), ("trunc_edges", "moved"), ("unranked_trunc", "twice")])
def test_ranking_of_several_seeds(spark, request, name, which):
    """Seeds of equal ids are listed once, and the project that ranks first doesn't depend on their number."""
    same(spark, name, request.getfixturevalue(which))
