"""Catalogue queries over small tables: all kinds of edges take part."""

import pytest

from loomgraph.plans.catalog import QUERIES


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    rows = {
        "region": ([(1, "R")], "r_regionkey int, r_name string"),
        "nation": ([(1, "N", 1)], "n_nationkey int, n_name string, n_regionkey int"),
        "customer": ([(1, "C", 1, "X")], "c_custkey bigint, c_name string, c_nationkey int, c_mktsegment string"),
        "supplier": ([(k, f"S{k}", 1) for k in (1, 2)], "s_suppkey bigint, s_name string, s_nationkey int"),
        # part 1 is a seed of the walks by its name; part 4 has no edge
        "part": ([(1, "region::1 part", "B#1", 1), (2, "P2", "B#1", 1), (3, "P3", "B#1", 1), (4, "P4", "B#1", 1)], "p_partkey bigint, p_name string, p_brand string, p_size int"),
        "lineitem": ([(1, 1, 1), (1, 2, 1), (2, 3, 2)], "l_orderkey bigint, l_partkey bigint, l_suppkey bigint"),
    }
    for name in ("orders", "events", "documents", "pages"):
        rows[name] = ([(1,)], "k int")
    for name, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(f"{at}/{name}.parquet")
    return str(at)


def test_communities_join_parts_to_suppliers(spark, tables):
    got = {r.id: r.community for r in QUERIES["louvain"](spark, tables).collect()}
    assert len(got) == 9
    assert got["part::1"] == got["part::2"] == got["supplier::1"]
    assert got["part::3"] == got["supplier::2"]
    assert list(got.values()).count(got["part::4"]) == 1


@pytest.mark.parametrize("name", ["bfs_context", "dfs_context"])
def test_walks_follow_calls(spark, tables, name):
    lines = {r.id: r.line for r in QUERIES[name](spark, tables).collect()}
    # both seeds, and what they reach
    assert set(lines) == {"region::1", "nation::1", "customer::1", "supplier::1", "supplier::2", "part::1"}
    assert lines["part::1"].endswith("S1")
