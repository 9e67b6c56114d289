import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loomgraph.llm import packing

from .odd import odd_docs

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(pieces, docs, window, end_id=1):
    tokenizer = Tokenizer.from_file(PATH)
    want = defaultdict(int)
    for r in docs:
        want[r.doc_id, tuple([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, end_id])] += 1
    parts = defaultdict(list)
    for p in pieces:
        parts[p.doc_id, p.doc_tokens].append((p.start, p.length, p.ids_crc32))
    for (doc, ids), n in want.items():
        found = sorted(parts[doc, len(ids)])
        same = sum(m for (d, x), m in want.items() if d == doc and len(x) == len(ids))
        # of rows that share id and length, the pieces cover each place as often as there are rows
        cover = np.zeros(len(ids) + 1, np.int64)
        for start, length, crc in found:
            cover[start] += 1
            cover[start + length] -= 1
            if same == n:
                assert crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
        assert (np.cumsum(cover)[:-1] == same).all()
    assert sum(p.length for p in pieces) == sum(len(ids) * n for (_, ids), n in want.items())
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
    for found in sequences.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at == window or at & (at - 1) == 0 and at < window
    assert sum(sum(n for _, n in x) < window for x in sequences.values()) <= window.bit_length()


@pytest.mark.parametrize("window", [64, 2048])
def test_pack_odd_rows(spark, window):
    docs = odd_docs(spark)
    check(packing.pack(docs, PATH, window).collect(), docs.collect(), window)
    assert packing.pack(docs.limit(0), PATH, window).count() == 0


def test_patterns_place_most_of_a_large_histogram(spark):
    random.seed(2)
    docs = spark.createDataFrame([(i, " ".join(["cat"] * random.randrange(1, 64))) for i in range(3000)], "doc_id bigint, text string").repartition(7)
    pieces = packing.pack(docs, PATH, 64).collect()
    check(pieces, docs.collect(), 64)
    whole = sum(p.length == p.doc_tokens for p in pieces)
    assert whole > 0.9 * 3000


def test_solve_draws_no_length_too_often():
    rng = np.random.default_rng(1)
    for window in (16, 64, 256):
        for scale in (0, 1, 30):
            histogram = rng.poisson(scale, window + 1)
            histogram[0] = histogram[window] = 0
            combos, repeats = packing.solve(histogram, window)
            used = np.bincount(np.repeat(combos, repeats, axis=0).ravel().astype(int), minlength=window + 1)
            used[0] = 0
            assert (used <= histogram).all()
            if len(combos):
                assert (combos.sum(axis=1) == window).all()


def test_words_have_the_ids_of_the_text():
    words, plain = packing.WordIds(PATH), Tokenizer.from_file(PATH)
    texts = ["Don't stop, can't WON'T i'm we'll", "ΣΑΣ ΟΔΟΣ. İstanbul Ǆ ﬁne", "a\x1cb c d été É.", "<|endoftext|> x<|startoftext|>y", "12.5% $3,000 #tag @me", "x" * 5000 + " yy", "", "  ", "a​b ﻿z", "Ünïcode, ÉÉ!! ??? ..."]
    for _ in range(2):
        for text, ids in zip(texts, words.of_texts(texts)):
            assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
