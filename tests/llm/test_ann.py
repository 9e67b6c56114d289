import itertools
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import ann, queries

DATA = "/root/testdata/sf0.1"


@pytest.mark.parametrize(("axes", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_hilbert_curve_visits_every_cell_and_moves_one_step(axes, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=axes)))
    keys = ann.hilbert(cells, bits)
    assert sorted(keys.tolist()) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def slow(rows, k=20, every=20):
    good = {}
    width = None
    for i, v in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        good[i, tuple(v)] = None
    sizes = [len(v) for _, v in good]
    width = min(sorted(set(sizes)), key=lambda w: (-sizes.count(w), w)) if sizes else 0
    good = [(i, np.float64(np.float32(v))) for i, v in good if len(v) == width]
    out = []
    for q, x in good:
        if q % every == 0:
            found = sorted((-float(x @ y), i) for i, y in good if i != q)[:k]
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(found, 1)]
    return sorted(out)


def compare(got, want):
    assert [g[:2] for g in got] == [w[:2] for w in want]
    for g, w in zip(got, want):
        assert g[3] == pytest.approx(w[3], abs=1e-9)
        assert g[2] == w[2], (g, w)


def test_odd_rows(spark):
    random.seed(1)
    rows = [(i, [float(np.float32(random.gauss(0, 1))) for _ in range(5)]) for i in range(90)]
    rows += [(i, [1.0, 2.0, 0.0, 0.0, 1.0]) for i in range(100, 141)]  # equal vectors: ties to the smaller id
    rows += [(200, None), (220, [0.0] * 5), (240, [1.0, None, 0.0, 0.0, 0.0]), (260, [float("nan")] * 5), (280, [float("inf")] + [0.0] * 4), (300, [1.0]), (320, []), (None, [1.0] * 5), (0, rows[0][1]), (40, rows[40][1])]
    df = spark.createDataFrame([(i, v, 1, 0.5, "x") for i, v in rows], "vec_id bigint, embedding array<float>, rank int, score double, vector string")
    got = sorted(tuple(r) for r in ann.search(df, F.col("vec_id") % 20 == 0).collect())
    compare(got, slow(rows))
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = ann.search(df.where("vec_id in (0, 1, 2)"), F.col("vec_id") % 20 == 0).collect()
    assert [(r.query_id, r["rank"]) for r in sorted(few)] == [(0, 1), (0, 2)]


def test_vectors_of_any_length_by_inner_product(spark):
    random.seed(2)
    rows = [(i, [float(np.float32(random.gauss(0, 1) * (1 + i % 7))) for _ in range(6)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    compare(sorted(tuple(r) for r in ann.search(df, F.col("vec_id") % 20 == 0).collect()), slow(rows))


@pytest.mark.parametrize("n", [3_000, 30_000])
def test_recall_does_not_fall_with_the_rows(monkeypatch, n):
    monkeypatch.setattr(ann, "BLOCK", 300)
    random = np.random.default_rng(3)
    x = random.normal(size=(n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    curves = ann.Curves(64, 1.0, np.append(x.mean(axis=0), 0.0), 1 / 8)
    data, asked = curves.keys(x, False), curves.keys(x[:50], True)
    seen = np.zeros((50, n), bool)
    for c in range(ann.CURVES):
        order = np.argsort(data[:, c], kind="stable")
        block = np.empty(n, int)
        block[order] = np.arange(n) // ann.block_size(n)
        own = np.searchsorted(data[order, c], asked[:, c]) // ann.block_size(n)
        seen |= abs(block - own[:, None]) <= 1
    best = np.argsort(-(x[:50] @ x.T), axis=1)[:, 1:21]
    assert np.take_along_axis(seen, best, axis=1).mean() >= 0.85


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the tables")
def test_recall_with_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 160)  # 24 % of 2000 vectors a curve
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    got = {(r.query_id, r.vec_id) for r in queries.op7_nearest_neighbours(spark, DATA).collect()}
    want = {(q, i) for q, _, i, _ in slow(rows)}
    assert len(got & want) / len(want) >= 0.9
