"""Language ID, the quality model and quality rules."""

import math
import os
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import langid, quality, queries, rules

from .odd import odd_docs

DATA = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the tables")


def slow_mass(word, pieces, p):
    """The mass of every segmentation, one by one."""
    if not word:
        return 1.0
    total = 0.0
    for n in range(1, len(word) + 1):
        if word[:n] in pieces:
            total += p[pieces[word[:n]]] * slow_mass(word[n:], pieces, p)
        elif n == 1:
            total += p[len(pieces)] * slow_mass(word[n:], pieces, p)
    return total


def test_forward_sums_all_segmentations():
    pieces = {x: i for i, x in enumerate(["▁", "▁a", "a", "b", "ab", "ba", "▁ab", "abab"])}
    p = np.random.default_rng(0).uniform(0.01, 0.2, (len(pieces) + 1, 2))
    words = ["a", "ab", "abab", "zab", "ababba"]
    words += ["abba" * 400]  # far below what a float holds
    logs = langid.Lattices(words, langid.Pieces(list(pieces))).logs(np.log(p))
    assert np.isfinite(logs).all() and (logs[-1] < -700).all()
    for word, row in zip(words[:-1], logs):
        for k in range(2):
            assert row[k] == pytest.approx(math.log(slow_mass("▁" + word, pieces, p[:, k])))


def test_expected_counts_are_the_slope_of_the_log_mass():
    pieces = langid.Pieces(["▁", "▁a", "a", "b", "ab"])
    p = np.full((6, 1), 0.15)
    words, weights = ["abab", "b"], np.array([[2.0], [3.0]])
    lattice = langid.Lattices(words, pieces)
    used = lattice.expected(np.log(p), weights)
    for i in range(6):
        more = p.copy()
        more[i] *= math.exp(1e-6)
        slope = ((lattice.logs(np.log(more)) - lattice.logs(np.log(p))) * weights).sum() / 1e-6
        assert used[i, 0] == pytest.approx(slope, abs=1e-4)


def test_words_are_scored_alike_in_any_company():
    pieces = langid.Pieces(["▁", "▁a", "a", "b", "ab", "ba"])
    model = langid.uniform(["x"], pieces).learned(np.arange(7.0)[:, None])
    words = ["ab" * n for n in range(1, 40)] + ["zz", "b"] * 50
    assert np.allclose(model.logs(words), np.concatenate([model.logs([w]) for w in words]))
    assert sorted(np.concatenate(list(langid.parts(words))).tolist()) == list(range(len(words)))


@needs_data
def test_held_out_languages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = queries.op2_language_id(spark, DATA).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 100
    assert sum(r.lang_pred == r.lang for r in got) / len(got) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_languages_of_odd_rows(spark):
    docs = odd_docs(spark)
    vocabulary = public_tokenizers.path("piece_bpe_32k.model")
    model = langid.fit(docs, F.lit(True), vocabulary)
    got = langid.identify(docs, model, "doc_id").collect()
    assert len(got) == docs.count()
    found = {r.doc_id: r.lang_pred for r in got if r.doc_id is not None}
    assert [found[k] for k in (3, 4, 5, 7)] == ["und"] * 4
    assert found[1] == "en" and found[6] == "de" and found[8] == "es"
    none = langid.fit(docs.limit(0), F.lit(True), vocabulary)
    assert {(r.lang_pred, r.score) for r in langid.identify(docs, none, "doc_id").collect()} == {("und", 0.0)}
    assert langid.identify(docs.limit(0), model, "doc_id").count() == 0


def test_additive_model_learns_single_and_paired_effects():
    rng = np.random.default_rng(3)
    x = rng.uniform(size=(4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.train(x[:3000], y[:3000])
    assert (0, 1) in model.pairs
    assert ((model.scores(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9
    assert quality.train(x[:0], y[:0]).scores(x[:2]).tolist() == [0.5, 0.5]
    assert (quality.train(x, np.ones(4000)).scores(x[:3]) > 0.9).all()


@needs_data
def test_held_out_quality(spark):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    got = queries.op4_quality_classifier(spark, DATA).join(labels, "doc_id").where("held_out").collect()
    assert len(got) > 80
    assert sum(r.predicted == r.quality for r in got) / len(got) > 0.95


def test_quality_of_odd_rows(spark):
    docs = odd_docs(spark)
    labels = spark.createDataFrame([(1, 1), (3, 0), (3, 1), (None, 1), (9, None), (77, 0), (8, 5)], "doc_id bigint, quality int")
    model = quality.fit(docs, labels, F.lit(True))
    got = quality.score(docs, model, "doc_id").collect()
    assert len(got) == docs.count()
    assert all(0 <= r.score <= 1 for r in got)
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.score >= 0.5 for r in got)
    assert quality.keep_good(docs.limit(0), model).count() == 0


def slow_rules(text):
    text = text or ""
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = Counter(windows)
    again = {j for i, w in enumerate(windows) if seen[w] > 1 for j in range(i, i + 8)}
    earlier, dup = set(), 0
    for line in text.split("\n"):
        if __import__("re").search(r"[^\x20\x09-\x0D]", line):
            dup += line in earlier
            earlier.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(again), n < 20 or 100 * len(again) > 30 * n


def test_rule_counts(spark):
    random.seed(4)
    texts = [" ".join(random.choice("ab c# é|\n") for _ in range(random.randrange(200))) for _ in range(40)]
    texts += [" ".join(random.choice(["x", "y"]) for _ in range(n)) for n in (7, 8, 9, 30, 60)] + ["a b\n\na b\n \n \na  b \x1c"]
    docs = odd_docs(spark).select("doc_id", "text").unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id bigint, text string"))
    labels = spark.createDataFrame([(1, 1), (6, 1), (9, 0), (None, 1)], "doc_id bigint, quality int")
    for model in (rules.fit(docs, labels), rules.fit(docs, labels.limit(0))):
        text = {r.doc_id: r.text for r in docs.collect()}
        for r in rules.judge(docs, model, "doc_id").collect():
            if r.doc_id is not None:
                assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == slow_rules(text[r.doc_id]), r.doc_id
            assert r.kept == (not r.base_failed and r.llr >= model.least)
    assert rules.judge(docs.limit(0), model, "doc_id").count() == 0


def test_ratio_is_of_whole_corpus_counts(spark):
    docs = spark.createDataFrame([(1, "good words here"), (2, "bad words there"), (3, "bad bad")], "doc_id bigint, text string").repartition(3)
    model = rules.fit(docs, spark.createDataFrame([(1, 1)], "doc_id bigint, quality int"))
    hashes = rules.WordHashes()
    raw, good = np.zeros(rules.BUCKETS), np.zeros(rules.BUCKETS)
    for r in docs.collect():
        for g in rules.grams(hashes.of(r.text.encode().split())):
            raw[g] += 1
            good[g] += r.doc_id == 1
    want = np.log((good + 0.5) / (good + 0.5).sum()) - np.log((raw + 0.5) / (raw + 0.5).sum())
    assert np.allclose(model.ratio, want)


@needs_data
def test_rules_part_good_from_bad(spark):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    got = queries.op9_quality_rules(spark, DATA).join(labels, "doc_id").where("not base_failed").collect()
    good, bad = [r.kept for r in got if r.quality], [r.kept for r in got if not r.quality]
    assert sum(good) / len(good) > 0.97
    assert sum(bad) / len(bad) < 0.2


def test_rules_learn_from_all_trusted_documents(spark):
    """Words and the threshold of every labelled document count, of 30,000 of them too."""
    n = 30_000
    text = F.concat_ws(" ", F.lit("some plain words"), F.concat(F.lit("w"), F.col("id") % 97), F.concat(F.lit("v"), F.col("id") % 89))
    docs = spark.range(n, numPartitions=4).select(F.col("id").alias("doc_id"), text.alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    model = rules.fit(docs.unionByName(spark.createDataFrame([(n, "junk junk junk")], "doc_id bigint, text string")), labels)
    # the target is all of the corpus but one document, whose words alone differ
    raw, trusted = np.zeros(rules.BUCKETS), np.zeros(rules.BUCKETS)
    known = rules.WordHashes()
    rows = [r.text for r in docs.collect()]
    for t in rows:
        trusted += np.bincount(rules.grams(known.of(t.encode().split())), minlength=rules.BUCKETS)
    raw = trusted + np.bincount(rules.grams(known.of(b"junk junk junk".split())), minlength=rules.BUCKETS)
    smooth = lambda x: (x + rules.SMOOTHING) / (x + rules.SMOOTHING).sum()
    assert np.allclose(model.ratio, np.log(smooth(trusted)) - np.log(smooth(raw)))
    every = [rules._per_gram(known.of(t.encode().split()), model.ratio) for t in rows]
    assert abs(model.least - (np.quantile(every, rules.QUANTILE) - rules.SLACK)) < 1e-12


@pytest.mark.parametrize("share", [0.0, 0.005, 0.3, 0.5, 1.0])
def test_quantiles_are_exact(spark, share):
    values = [-3.5, -1.0, -1.0, 0.0, 0.00001, 0.00002, 0.1, 2.0, 2.0, 7.25, 9.0]
    for some in (values, values[:1], values[:2]):
        df = spark.createDataFrame([(x,) for x in some], "llr double")
        assert abs(rules.quantile(df, share) - np.quantile(some, share)) < 1e-12
