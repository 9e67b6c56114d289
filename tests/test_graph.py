"""Assembly, walks, measures and communities on small graphs."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from loomgraph.functions.join import contains_join
from loomgraph.functions.text import normalize_path, pascal_case
from loomgraph.operators import analytics, assemble, communities, traverse
from loomgraph.operators.communities import assign_communities, louvain
from loomgraph.operators.components import connected_components
from loomgraph.schema import EDGES, NODES


def make(spark, labels, links, kind="Calls"):
    nodes = spark.createDataFrame([(x, x, "Function", f"src/{x}.rs", i, 0, i) for i, x in enumerate(labels)], NODES)
    edges = spark.createDataFrame([(a, b, kind, "Extracted", 1.0, i) for i, (a, b) in enumerate(links)], EDGES)
    return nodes, edges


def test_build_graph_keeps_the_last_of_an_id_and_drops_dangling_edges(spark):
    nodes, edges = make(spark, ["src/a.rs::users", "x"], [("x", "src/a.rs::users"), ("x", "gone"), ("x", "x"), ("x", "x")])
    nodes = nodes.unionByName(spark.createDataFrame([("x", "later", "Struct", "f", 1, 0, 99)], NODES))
    routes = spark.createDataFrame([("GET", "/api/users", "src/a.rs", "Axum", ["api", "users"], "Regex", 0)], "method string, path string, file string, framework string, tags array<string>, confidence string, ord bigint")
    models = spark.createDataFrame([("User", "Users", 1), ("Post", None, 2)], "name string, table_name string, ord bigint")
    n, e = assemble.build_graph((nodes, edges), routes, models)
    assert {r.id: r.label for r in n.collect()} == {"src/a.rs::users": "src/a.rs::users", "x": "later", "src/a.rs::route::GET::/api/users": "GET /api/users", "schema::users": "User", "schema::post": "Post"}
    assert sorted((r.from_id, r.to_id, r.conf_class) for r in e.collect()) == [("src/a.rs::route::GET::/api/users", "src/a.rs::users", "Inferred"), ("x", "src/a.rs::users", "Extracted"), ("x", "x", "Extracted"), ("x", "x", "Extracted")]


def test_degrees_count_loops_twice_and_parallel_edges(spark):
    nodes, edges = make(spark, "abcd", [("a", "b"), ("a", "b"), ("c", "c")])
    assert [(r.id, r.degree) for r in analytics.god_nodes(nodes, edges, 4).collect()] == [("a", 2), ("b", 2), ("c", 2), ("d", 0)]
    assert [r.id for r in analytics.orphan_nodes(nodes, edges).collect()] == ["d"]


def test_callers_end_on_a_cycle(spark):
    nodes, edges = make(spark, "abcd", [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")])
    got = traverse.symbol_callers(nodes, edges, "C", 5)
    assert [(r.id, r.depth) for r in got.collect()] == [("b", 1), ("a", 2), ("d", 3)]
    assert traverse.symbol_callers(nodes, edges, "zzz", 2).count() == 0


@pytest.mark.parametrize("tokens", [1, 12, 25, 40, 1000])
def test_bfs_budget(spark, tokens):
    nodes, edges = make(spark, ["é→seed", "b", "c", "d"], [("é→seed", "b"), ("b", "c"), ("d", "b")])
    rows = traverse.bfs_context(nodes, edges, "SEED nothing", tokens).collect()
    lines = {"é→seed": "  [fn] é→seed [src/é→seed.rs] → b", "b": "  [fn] b [src/b.rs:1] → c", "c": "  [fn] c [src/c.rs:2]", "d": "  [fn] d [src/d.rs:3] → b"}
    want, used = [], 0
    for x in ("é→seed", "b", "c", "d"):
        used += len(lines[x].encode()) + 1
        if used > 3 * tokens and want:
            break
        want.append(lines[x])
    assert [r.line for r in rows] == want
    assert rows[0].truncated == (len(want) < 4)


def test_bfs_out_and_fallback(spark):
    nodes, edges = make(spark, "abcd", [("a", "b"), ("c", "a")])
    assert [r.id for r in traverse.bfs_context(nodes, edges, "src/a", 500, "out").collect()] == ["a", "b"]
    assert {r.id for r in traverse.bfs_context(nodes, edges, "zzz", 500).collect()} == set("abcd")


def test_dfs_visits_each_node_once(spark):
    nodes, edges = make(spark, ["s", "l", "r", "ll", "rr"], [("s", "l"), ("s", "r"), ("l", "ll"), ("r", "rr"), ("rr", "s"), ("ll", "r")])
    got = [r.id for r in traverse.dfs_context(nodes, edges, "src/s.", 1000).orderBy("visit").collect()]
    assert got == ["s", "r", "rr", "l", "ll"]


def test_blast_models(spark):
    files = spark.createDataFrame([("src/User/a.ts", 0), ("x.ts", 0)], "file string, depth int")
    models = spark.createDataFrame([("user",), ("X",), ("Order",)], "name string")
    assert sorted(r.name for r in traverse.blast_models(models, files).collect()) == ["X", "user"]


def test_contains_join_is_exact(spark):
    random.seed(3)
    word = lambda n: "".join(random.choice("ab/") for _ in range(random.randrange(n)))
    hay, needles = [word(9) for _ in range(60)], [word(6) for _ in range(60)] + [""]
    df = lambda xs, c: spark.createDataFrame([(x,) for x in xs], f"{c} string")
    got = {tuple(r) for r in contains_join(df(hay, "h"), "h", df(needles, "n"), "n").collect()}
    assert got == {(h, n) for h in hay for n in needles if n in h}


def test_communities_of_two_cliques(spark):
    clique = lambda xs: [(a, b) for a in xs for b in xs if a < b]
    names = ["a1", "a2", "a3", "a4", "b1", "b2", "b3", "b4", "z"]
    nodes, edges = make(spark, names, clique(names[:4]) + clique(names[4:8]) + [("a4", "b1")])
    for local in (50, 0):
        done = assign_communities(nodes, edges, local)
        got = {r.id: r.community for r in done.collect()}
        assert len({got[x] for x in names[:4]}) == len({got[x] for x in names[4:8]}) == 1, got
        assert len(set(got.values())) == 3
        assert (got["a1"], got["b1"], got["z"]) == (0, 1, 2)
        q = analytics.modularity(done, edges).first().q
        assert q > 0.3
        assert [(r.id, r["size"], r.label) for r in analytics.community_summary(done).collect()] == [(0, 4, "src (4)"), (1, 4, "src (4)"), (2, 1, "src (1)")]
        assert [(r.from_id, r.to_id) for r in analytics.cross_community_edges(done.withColumn("community", done.community + 1), edges).collect()] == [("a4", "b1")]


def test_communities_of_a_large_component_and_of_repeated_edges(spark, monkeypatch):
    # a path of 60,000 nodes, each link twice, once either way
    n, name = 60_000, lambda x: F.format_string("n%06d", x)
    nodes = spark.range(n).select(name(F.col("id")).alias("id"), F.col("id").alias("ord"), F.lit(0).cast("bigint").alias("community"))
    hops = spark.range(n - 1).select(name(F.col("id")).alias("from_id"), name(F.col("id") + 1).alias("to_id"))
    edges = hops.union(hops.select("to_id", "from_id"))

    def apart(*_):
        raise AssertionError("rounds of joins")

    monkeypatch.setattr(communities, "_distributed", apart)
    got = [r.community for r in assign_communities(nodes, edges).orderBy("ord").collect()]
    assert got == louvain(n, [(i, i + 1) for i in range(n - 1)] * 2)


def test_communities_of_many_links_go_by_rounds(spark, monkeypatch):
    monkeypatch.setattr(communities, "LOCAL_LINKS", 5)
    monkeypatch.setattr(communities, "_distributed", lambda nodes, links, m: nodes.select("id", F.lit(f"a{links.count() - 6}").alias("c")))
    names = [f"a{i}" for i in range(4)] + [f"b{i}" for i in range(3)]
    nodes, edges = make(spark, names, list(itertools.combinations(names[:4], 2)) + list(itertools.combinations(names[4:], 2)))
    got = [r.community for r in assign_communities(nodes, edges).orderBy("ord").collect()]
    assert got == [0] * 4 + [1] * 3


def test_communities_of_many_nodes_go_by_blocks(spark, monkeypatch):
    # too many nodes for one task: no rounds of joins, and about as good as moving one by one
    draw, n = random.Random(3), 600
    links = [(draw.randrange(n), draw.randrange(n)) for _ in range(600)] + [(g * 60 + draw.randrange(60), g * 60 + draw.randrange(60)) for g in range(10) for _ in range(300)]
    nodes, edges = make(spark, [f"n{i:03d}" for i in range(n + 1)], [(f"n{a:03d}", f"n{b:03d}") for a, b in links])

    def apart(*_):
        raise AssertionError("rounds of joins")

    monkeypatch.setattr(communities, "_distributed", apart)
    at = spark.createDataFrame([(f"n{i:03d}", c) for i, c in enumerate(louvain(n + 1, links))], "id string, community bigint")
    q = lambda found: analytics.modularity(found, edges).first().q
    best = q(at)
    for block in (500_000, 1500):
        monkeypatch.setattr(communities, "BLOCK", block)
        done = assign_communities(nodes, edges, 0).cache()
        got = [r.community for r in done.orderBy("ord").collect()]
        first = list(dict.fromkeys(got))
        assert len(got) == n + 1 and first == list(range(len(first))) and got.count(got[n]) == 1
        assert q(done) > 0.9 * best
    # few links: the same as one by one
    assert [r.community for r in communities._by_number(nodes, edges, 1000).orderBy("ord").collect()] == louvain(n + 1, links)


def test_communities_of_very_many_nodes_go_by_rounds(spark, monkeypatch):
    monkeypatch.setattr(communities, "NUMBERED", 0)
    nodes, edges = make(spark, "abcdef", [*itertools.combinations("abc", 2), *itertools.combinations("def", 2), ("c", "d")])
    assert [r.community for r in assign_communities(nodes, edges, 0).orderBy("ord").collect()] == [0, 0, 0, 1, 1, 1]


def test_communities_without_edges(spark):
    nodes, edges = make(spark, "ab", [])
    assert [r.community for r in assign_communities(nodes, edges).orderBy("id").collect()] == [0, 1]
    assert analytics.graph_stats(nodes, edges).first().asDict() == {"node_count": 2, "edge_count": 0, "function_count": 2, "route_count": 0, "schema_count": 0, "community_count": 0}


def test_louvain_never_loses_modularity():
    random.seed(1)
    for _ in range(20):
        n = random.randrange(2, 15)
        edges = [(random.randrange(n), random.randrange(n)) for _ in range(2 * n)]
        at = louvain(n, edges)
        degree = [sum((a == i) + (b == i) for a, b in edges) for i in range(n)]

        def q(of):
            m = len(edges)
            return sum(of[a] == of[b] for a, b in edges) / m - sum(sum(d for d, c in zip(degree, of) if c == k) ** 2 for k in set(of)) / (4 * m * m)

        assert q(at) >= q(list(range(n))) - 1e-9
        assert sorted(set(at)) == list(range(len(set(at))))


def test_components_match_union_find(spark):
    random.seed(5)
    links = [(random.randrange(400), random.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(500, 560)] + [(700, x) for x in range(701, 780)]
    parent = {x: x for e in links for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "u bigint, v bigint")).collect()}
    assert got == {x: root(x) for x in parent if any(x in e and e[0] != e[1] for e in links)}


def test_text_functions(spark):
    df = spark.createDataFrame([("a/../../b/./c//d", "blog_post_x")], "p string, n string")
    assert tuple(df.select(normalize_path(df.p), pascal_case(df.n)).first()) == ("b/c/d", "BlogPostX")


def test_upsert_keeps_the_place(spark):
    nodes, _ = make(spark, "ab", [])
    new = spark.createDataFrame([("a", "A2", "Struct", "f", 9, 0, 50), ("c", "C", "Struct", "f", 9, 0, 51)], NODES)
    assert [(r.id, r.label, r.ord) for r in assemble.upsert_nodes(nodes, new).orderBy("id").collect()] == [("a", "A2", 0), ("b", "b", 1), ("c", "C", 51)]


def test_ambiguous_nodes(spark):
    nodes, edges = make(spark, "ab", [("a", "b")])
    assert analytics.ambiguous_nodes(nodes, edges).count() == 0
    doubtful = spark.createDataFrame([("a", "b", "Calls", "Ambiguous", 0.2, 0)], EDGES)
    assert [r.id for r in analytics.ambiguous_nodes(nodes, doubtful).collect()] == ["b"]
