import random
import re

import pytest
import xxhash

from loomgraph.llm import simhash

from .odd import odd_docs, rows_of


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", [None, "", "one", "One tWo", "a b c", "É a\x0bb\x0cc\rd\x1ce   f", " ".join(f"w{i % 40}" for i in range(900))])
def test_fingerprint(text):
    assert simhash.fingerprint(text) % (1 << 64) == slow_fingerprint(text)


def slow_roots(prints):
    prints = sorted(set(prints))
    root = {x: x for x in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[i + 1 :]:
            if ((a ^ b) % (1 << 64)).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {x: find(x) for x in prints}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_classes_of_sparse_and_dense_groups(spark):
    random.seed(7)
    prints = [random.getrandbits(64) for _ in range(60)]
    for _ in range(200):
        x = random.choice(prints)
        for _ in range(random.choice([1, 2, 2, 3])):
            x ^= 1 << random.randrange(64)
        prints.append(x)
    centre = random.getrandbits(64)
    prints += [centre ^ (1 << a) ^ (1 << b) for a in range(6) for b in range(32, 40)]  # a dense bucket
    prints = [signed(x) for x in prints]
    got = {r.fp: r.root for r in simhash.classes(spark.createDataFrame([(x,) for x in prints], "fp bigint")).collect()}
    assert got == slow_roots(prints)


def test_near_duplicates(spark):
    docs = odd_docs(spark)
    want = slow_roots([signed(slow_fingerprint(r.text)) for r in docs.collect()])
    ids = {}
    for r in docs.collect():
        root = want[signed(slow_fingerprint(r.text))]
        if r.doc_id is not None:
            ids[root] = min(r.doc_id, ids.get(root, r.doc_id))
    expected = sorted(((r.doc_id, f"{slow_fingerprint(r.text):016x}", ids.get(want[signed(slow_fingerprint(r.text))])) for r in docs.collect()), key=str)
    assert rows_of(simhash.near_duplicates(docs)) == expected
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_keep_one(spark):
    kept = simhash.keep_one(odd_docs(spark))
    assert kept.columns == odd_docs(spark).columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 3, 6, 7, 8, 9, None]
    assert simhash.keep_one(odd_docs(spark).limit(0)).count() == 0
