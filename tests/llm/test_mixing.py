import random
import re

import pytest

from loomgraph.llm import mixing

from .odd import odd_docs, rows_of


def slow_targets(sizes):
    """Shares by weight, what is above a cap handed to the rest until none is."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, left = dict.fromkeys(names, 0.0), set(names), float(sum(sizes.values()))
    while free and left > 1e-9:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 3 * sizes[s]}
        if not full:
            return target | {s: level * weight[s] for s in free}
        for s in full:
            target[s] = 3.0 * sizes[s]
            left -= 3 * sizes[s]
        free -= full
    return target


def make(spark, sizes, seed=0):
    random.seed(seed)
    rows, i = [], 0
    for source, (n, most) in sizes.items():
        for _ in range(n):
            rows.append((i, " ".join(["w"] * random.randrange(most)), source))
            i += 1
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string")


@pytest.mark.parametrize("sizes", [{"a": (300, 40), "b": (20, 30), "c": (5, 10), "d": (100, 80), None: (30, 9)}, {"z": (1, 50)}, {"é": (3, 1), "Z": (40, 30), "a": (40, 30)}])
def test_mix(spark, sizes):
    docs = make(spark, sizes)
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count()
    text = {r.doc_id: r for r in docs.collect()}
    total = {s: 0 for s in sizes}
    for r in text.values():
        total[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    want = slow_targets(total)
    taken = dict.fromkeys(sizes, 0)
    most = dict.fromkeys(sizes, 0)
    for r in got:
        source = text[r.doc_id].source
        assert r.size == len(text[r.doc_id].text.split())
        assert r.source_size == total[source]
        assert r.target == pytest.approx(want[source])
        assert 0 <= r.taken <= 3 * r.size
        assert r.size == 0 or abs(r.taken - r.target / r.source_size * r.size) < r.size + 1e-6
        taken[source] += r.taken
        most[source] = max(most[source], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= most[s] / 2 + 1e-6
    assert rows_of(mixing.mix(docs.repartition(5))) == sorted((tuple(r) for r in got), key=str)


def test_rounding_is_random_by_key(spark):
    # one place in a source under many keys: neither always nor never taken
    total, n = 0, 12
    for k in range(n):
        docs = spark.createDataFrame([(1000 * k + i, "w " * (i % 7 + 1), s) for i, s in [(j, "ab"[j % 3 == 0]) for j in range(200)]], "doc_id bigint, text string, source string")
        total += sum(r.copies for r in mixing.mix(docs).where("doc_id % 1000 = 17").collect())
    assert 0 < total < 3 * n


def test_odd_rows(spark):
    docs = odd_docs(spark)
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count()
    assert all(r.taken == r.copies == 0 for r in got if r.size == 0)
    assert mixing.mix(docs.limit(0)).count() == 0
    taken = mixing.take(docs)
    assert taken.columns == docs.columns
    assert taken.count() == sum(r.copies for r in got)
    assert taken.where("text is null").count() == 0
    assert mixing.take(docs.limit(0)).count() == 0


def test_take_repeats_rows_as_the_mix_says(spark):
    docs = make(spark, {"a": (60, 30), "b": (10, 20), "c": (30, 5)}, 3)
    copies = {r.doc_id: r.copies for r in mixing.mix(docs).collect() if r.size}
    got = {}
    for r in mixing.take(docs).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    size = {r.doc_id: len(r.text.split()) for r in docs.collect()}
    words = lambda found: sum(size[d] * n for d, n in found.items())
    assert abs(words(got) - words(copies)) <= 3 * 30
    assert max(got.values()) <= 3
