"""Joins of derived texts: what they find, and that no side of unknown size goes through the driver."""

from loomgraph.functions.join import contains_join
from loomgraph.llm import simhash
from loomgraph.operators import assemble
from loomgraph.operators.imports import import_edges
from loomgraph.sources import corpus, scratch
from loomgraph.sources.files import files_of


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_import_edges_broadcast_no_files(spark):
    for files in (corpus.files(spark, "/root/testdata/sf0.001"), corpus.kit(spark, "/root/testdata/sf0.001")):
        edges = import_edges(files)
        assert "BroadcastHashJoin" not in plan(edges)
        valid = assemble.valid_edges(edges.selectExpr("from_file as from_id", "to_file as to_id"), files.selectExpr("relative as id"))
        assert "BroadcastHashJoin" not in plan(valid)


def test_contains_join_agrees_with_all_pairs(spark):
    hay = ["", "a", "ab", "abc", "xabcx", "日本語", "x日本", None, "abab"]
    needles = ["", "b", "ab", "abc", "本語", "日本", "zzz", "bab", None]
    one = lambda rows, name: spark.createDataFrame([(x,) for x in rows], f"{name} string")
    got = {(r.hay, r.needle) for r in contains_join(one(hay, "h"), "h", one(needles, "n"), "n").collect()}
    assert got == {(h, n) for h in hay for n in needles if h is not None and n is not None and n in h}
    assert contains_join(one(hay, "h"), "h", one([], "n"), "n").count() == 0


def test_rust_paths_by_grams(spark):
    files = files_of(spark, {"src/a.rs": "use crate::store::db;\nuse super::é::日;\n", "lib/store/db.rs": "", "lib/é/日.rs": ""})
    assert {(r.from_file, r.to_file) for r in import_edges(files).collect()} == {("src/a.rs", "lib/store/db.rs"), ("src/a.rs", "lib/é/日.rs")}


def test_tables_are_written_without_large_broadcasts(spark, monkeypatch):
    seen, write = [], type(spark.range(1).write).parquet
    one, two = scratch._BROADCAST
    monkeypatch.setattr(type(spark.range(1).write), "parquet", lambda self, *a, **k: (seen.append((spark.conf.get(one), spark.conf.get(two, None))), write(self, *a, **k))[1])
    before = spark.conf.get(one)
    try:
        for value, other, wanted in ((before, None, str(256 << 10)), ("-1", None, "-1"), ("1k", "1m", "1024")):
            spark.conf.set(one, value)
            if other:
                spark.conf.set(two, other)
            assert scratch.save(spark.range(3), "x").count() == 3
            assert seen.pop() == (wanted, other and str(256 << 10))
            assert spark.conf.get(one) == value and spark.conf.get(two, None) == other
    finally:
        spark.conf.set(one, before)
        spark.conf.unset(two)
    assert "BroadcastHashJoin" not in plan(simhash.near_duplicates(spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")))
