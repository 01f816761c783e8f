"""Operator 4 against a model kept in dictionaries."""

import math
from collections import Counter

import numpy as np

import pytest

from lodestrata.llm.common import local_path
from lodestrata.llm.ngram_lm import BOS, EOS, VOCABULARY, EliasFano, distinct, lm_scores, planes, quantiser, tokens_of, unplanes

DDL = "doc_id long, text string"


def brute(texts, order=3):
    seqs = [(BOS, *tokens_of(t, "/opt/tokenizers").tolist(), EOS) for t in texts]
    n, follow = Counter(), {}
    for s in seqs:
        padded = s + (EOS,) * (order - 1)
        for i in range(len(s)):
            for k in range(order):
                ctx, w = padded[i : i + k], padded[i + k]
                n[ctx, w] += 1
                follow.setdefault(ctx, set()).add(w)
    total = Counter()
    for (ctx, _), c in n.items():
        total[ctx] += c

    def p(ctx, w):
        low = p(ctx[1:], w) if ctx else 1 / VOCABULARY
        if ctx not in follow:
            return low
        t, c = len(follow[ctx]), total[ctx]
        return n[ctx, w] / (c + t) + t / (c + t) * low

    return [sum(math.log2(p(s[max(0, i - order + 1) : i], s[i])) for i in range(1, len(s))) for s in seqs]


def test_elias_fano():
    rng = np.random.default_rng(0)
    for n, top in ((1, 0), (1, 10**9), (1000, 50), (1000, 10**6), (5000, 5000)):
        v = np.sort(rng.integers(0, top + 1, n))
        e, _ = EliasFano.read(memoryview(EliasFano.build(v, int(v[-1]))), 0)
        assert (e.get(np.arange(n)) == v).all()
        q = np.concatenate([v, v + 1])
        at = e.find(q, np.zeros(len(q), np.int64), np.full(len(q), n))
        there = np.isin(q, v)
        assert ((at >= 0) == there).all() and (v[at[there]] == q[there]).all()


def test_quantiser():
    v = np.random.default_rng(1).normal(size=10_000)
    book, code = quantiser(v)
    assert np.abs(book[code] - v).mean() < 0.02
    book, code = quantiser(np.array([1.0, 2.0, 1.0]))
    assert book[code].tolist() == [1.0, 2.0, 1.0]


def test_against_dictionaries(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: r for r in lm_scores(docs.repartition(3)).collect()}
    want = brute([t for _, t in rows])
    off = [abs(got[d].log2_prob - w) / (got[d].n_tokens + 1) for (d, t), w in zip(rows, want)]
    assert max(off) < 0.15 and sum(off) / len(off) < 0.02  # bits a token, from the quantised tables
    two = {r.doc_id: r.log2_prob for r in lm_scores(docs, order=2).collect()}
    off = [abs(two[d] - w) / (got[d].n_tokens + 1) for (d, t), w in zip(rows, brute([t for _, t in rows], 2))]
    assert max(off) < 0.15 and sum(off) / len(off) < 0.02


def test_counts_in_planes():
    rng = np.random.default_rng(3)
    g, c = rng.integers(0, 1 << 48, 1000).astype(np.uint64), rng.integers(1, 1 << 40, 1000)
    x, y = unplanes(planes(g, c))
    assert (x == g).all() and (y == c).all()


def test_documents_that_the_corpus_holds_twice_score_better(spark):
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 200)) for _ in range(300)]
    rows = list(enumerate(texts + texts[:30]))
    got = {r.doc_id: r.bits_per_token for r in lm_scores(spark.createDataFrame(rows, DDL)).collect()}
    assert max(got[d] for d in range(30)) < min(got[d] for d in range(30, 300))


def test_folders_that_cannot_be_mapped():
    assert local_path("file:/a") == local_path("file:///a") == local_path("/a") == "/a"
    for uri in ("hdfs://x/a", "s3a://x/a", "a/b"):
        with pytest.raises(ValueError):
            local_path(uri)


def test_exact_where_few_values(spark):
    texts = ["abab", "abba", "", "ab"]
    got = {r.doc_id: r.log2_prob for r in lm_scores(spark.createDataFrame(list(enumerate(texts)), DDL)).collect()}
    want = brute(texts)
    assert all(abs(got[i] - w) < 0.05 for i, w in enumerate(want))


def test_defined_results(spark):
    rows = [(None, "abc", 1), (1, None, 2), (2, "", 3), (3, "abc", None), (3, "abc", 5), (4, "lorem ipsum é " * 20_000, 6)]
    df = spark.createDataFrame(rows, DDL + ", n long").selectExpr("*", "n AS gram", "n AS b0")
    got = lm_scores(df).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert len(got) == 6 and by[1][0].log2_prob is None and by[1][0].n_tokens is None
    assert by[2][0].n_tokens == 0 and by[2][0].log2_prob < 0
    assert by[3][0].log2_prob == by[3][1].log2_prob == by[None][0].log2_prob
    assert by[4][0].n_tokens > 60_000 and by[4][0].bits_per_token < 1
    assert lm_scores(spark.createDataFrame([], DDL)).count() == 0
    only = lm_scores(spark.createDataFrame([(1, None)], DDL)).collect()
    assert len(only) == 1 and only[0].log2_prob is None


def test_distinct_numbers_and_their_places():
    """Of several parts, with one that is empty, numbers in several and the highest bits set."""
    rng = np.random.default_rng(4)
    parts = [rng.permutation(np.unique(rng.integers(0, 1 << 10, n).astype(np.uint64) << np.uint64(54))) for n in (1, 900, 0, 5000, 30)]
    key, places = distinct(parts)
    assert key.tolist() == np.unique(np.concatenate(parts)).tolist() and len(key) < sum(map(len, parts))
    assert [key[p].tolist() for p in places] == [x.tolist() for x in parts]
    assert [p.tolist() for p in distinct([parts[2]])[1]] == [[]] and distinct([])[1] == [] and len(distinct([])[0]) == 0
