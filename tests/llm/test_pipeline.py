import os
import shutil
import subprocess
import sys

import public_tokenizers
import pytest

import corpus_pipeline
from loomgraph.llm import queries

from .odd import NAMES, clashing, odd_docs
from .test_packing import check

DATA = "/root/testdata/sf0.001"


def test_stages_bear_odd_rows(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0), (6, 1, 0), (9, 0, 0), (None, None, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (odd_docs(spark), odd_docs(spark).limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns
            assert out.dtypes == docs.dtypes
            at = f"{tmp_path}/{len(os.listdir(tmp_path))}"
            out.write.parquet(at)
            docs = spark.read.parquet(at)
        pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
        check(pieces, docs.collect(), 2048)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the tables")
def test_decisions_take_effect(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    kept = {r.doc_id for r in corpus_pipeline.quality_stage(spark, docs, DATA).collect()}
    assert sum(labels[d] for d in kept if d in labels) / sum(d in labels for d in kept) > 0.95
    good = [d in kept for d, q in labels.items() if q]
    assert sum(good) / len(good) > 0.9  # learned from some 50 rows here
    fewer = corpus_pipeline.line_stage(spark, docs, DATA).collect()
    before = {r.doc_id: set(r.text.split("\n")) for r in docs.collect()}
    assert all(set(r.text.split("\n")) <= before[r.doc_id] for r in fewer)
    assert sum(len(r.text) for r in fewer) < sum(len(r.text) for r in docs.collect())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the tables")
def test_near_dup_stage_against_brute_force(spark):
    """One document stays of each component of all pairs with a Jaccard similarity of 0.8 of their shingles of five words."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    words = {r.doc_id: (r.text or "").lower().split() for r in docs.collect()}
    shingles = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, w in words.items()}
    by = {}
    for d, found in shingles.items():
        for x in found:
            by.setdefault(x, set()).add(d)
    root = {d: d for d in shingles}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    pairs = {(a, b) for some in by.values() if len(some) > 1 for a in some for b in some if a < b}
    similar = [(a, b) for a, b in pairs if len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b])]
    for a, b in similar:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    wanted = {top(d) for d in root}
    kept = {r.doc_id for r in corpus_pipeline.near_dup_stage(spark, docs, DATA).collect()}
    near = [(a, b) for a, b in similar if words[a] != words[b]]
    assert wanted <= kept and len(near) > 10
    # what stays beyond them are pairs that no key brings together
    assert len(kept - wanted) <= 0.05 * len(root.keys() - wanted)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the tables")
def test_run(spark):
    pieces = corpus_pipeline.run(spark, DATA).collect()
    assert len(pieces) > 50
    assert public_tokenizers.path("word_bpe_49k.json")


def test_queries_are_registered_once_each():
    names = sorted(n for n in queries.queries() if n.startswith("op"))
    assert len(names) == 10 and set(queries.oracle_sql()) <= set(queries.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))


def test_the_rest_works_without_this_folder(tmp_path):
    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    shutil.copytree(f"{root}/loomgraph", tmp_path / "loomgraph", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert not any(n.startswith('op') for n in e.queries() if n[2:3].isdigit()) and 'pipeline' not in e.queries() and len(e.queries()) > 30"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_stages_bear_columns_of_any_name(spark, tmp_path):
    docs = clashing(spark)
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        for r in out.collect():
            assert all(r[n] == f"{n}{r.doc_id}" for n in NAMES), name
