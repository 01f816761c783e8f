"""Operators 3 and 10 against brute force over all pairs of words."""

import random
import tracemalloc

import numpy as np
import pytest

from lodestrata.llm import chaining, suffixes
from lodestrata.llm.chaining import OUT, blocks, candidates, chain, fuzzy_passages, matches, opened, others, pack, seeds, unpack, without_passages
from lodestrata.llm.suffixes import common_prefixes, repeats, suffix_array

DDL = "doc_id long, text string"


def longest_runs(rows, least):
    """Of each two documents, the words of the later one that lie in a common run of `least` words."""
    out = {}
    docs = [(d, t.split()) for d, t in rows if d is not None and t]
    for i, (a, x) in enumerate(docs):
        at = {}
        for k in range(len(x) - least + 1):
            at.setdefault(tuple(x[k : k + least]), []).append(k)
        for b, y in docs[:i] + docs[i + 1 :]:
            if b > a:
                hit = [k for k in range(len(y) - least + 1) if tuple(y[k : k + least]) in at]
                if hit:
                    out[a, b] = {w for k in hit for w in range(k, k + least)}
    return out


def corpus(seed, n=60, words=3000):
    rng = random.Random(seed)
    word = lambda: f"v{rng.randrange(words)}"
    shared = [[word() for _ in range(rng.randrange(51, 160))] for _ in range(12)]
    rows = []
    for d in range(n):
        t = [word() for _ in range(rng.randrange(5, 300))]
        for p in rng.sample(shared, rng.randrange(0, 3)):
            k = rng.randrange(len(t) + 1)
            t[k:k] = p
        rows.append((d, " ".join(t)))
    return rows


@pytest.mark.parametrize("shard", [1 << 20, 2000])
def test_exact_repeats_against_brute_force(spark, shard):
    rows = corpus(3)
    text = dict(rows)
    got = repeats(spark.createDataFrame(rows, DDL).repartition(3), shard=shard).collect()
    for r in got:
        b, a = text[r.doc_id].split(), text[r.source_id].split()
        assert r.end_word - r.start_word >= 50 and b[r.start_word : r.end_word] == a[r.source_start : r.source_end]
    want = longest_runs(rows, 50)
    # every copy of a repeated passage lies in a pair, though not with every other copy
    need, have = {}, {}
    for (a, b), ws in want.items():
        need.setdefault(b, set()).update(ws)
    for r in got:
        have.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
        have.setdefault(r.source_id, set()).update(range(r.source_start, r.source_end))
    assert need and all(ws <= have.get(d, set()) for d, ws in need.items())


@pytest.mark.parametrize("shard", [1 << 20, 1500])
def test_every_copy_but_the_least_id_is_told(spark, shard):
    rng = random.Random(6)
    word = lambda: f"v{rng.randrange(3000)}"
    rows, want = [], {}
    for g in range(10):
        p = [word() for _ in range(rng.choice([50, 55, 63, 90]))]
        for k in range(12):
            left = [word() for _ in range(rng.randrange(20))]
            rows.append((g + 10 * k, " ".join(left + p + [word() for _ in range(20)])))
            if k:
                want[g + 10 * k] = set(range(len(left), len(left) + len(p)))
    rng.shuffle(rows)
    text = dict(rows)
    have = {}
    for r in repeats(spark.createDataFrame(rows, DDL).coalesce(1), shard=shard).collect():
        b, a = text[r.doc_id].split(), text[r.source_id].split()
        assert r.source_id < r.doc_id and r.end_word - r.start_word >= 50 and b[r.start_word : r.end_word] == a[r.source_start : r.source_end]
        have.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    assert all(ws <= have.get(d, set()) for d, ws in want.items())


def test_exact_repeats_of_the_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want, have = {}, {}
    for (a, b), ws in longest_runs(rows, 50).items():
        want.setdefault(b, set()).update(ws)
    for r in repeats(docs).collect():
        have.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
        have.setdefault(r.source_id, set()).update(range(r.source_start, r.source_end))
    assert all(ws <= have.get(d, set()) for d, ws in want.items())


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(5)
    seq = np.append(rng.integers(0, 3, 400), 1000).astype(np.int32)
    sa, groups = suffix_array(seq, 64, 4)
    s = seq.tolist()
    assert [s[i : i + 64] for i in sa] == sorted(s[i : i + 64] for i in range(len(s)))
    got = common_prefixes(seq, sa, groups, 4, 64)
    for k in range(1, len(s)):
        x, y = s[sa[k] :], s[sa[k - 1] :]
        n = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
        assert got[k] == (min(n, 64) if n >= 4 else 0)


def test_suffix_stretches_against_brute_force():
    rng = np.random.default_rng(9)
    for trial in range(20):
        base = rng.integers(0, 50, 120)
        docs = [np.concatenate([rng.integers(0, 50, int(rng.integers(0, 40))), base[int(rng.integers(0, 60)) :], rng.integers(0, 50, 9)]) for _ in range(6)]
        lens = np.array([len(d) for d in docs])
        start = np.cumsum(lens + 1) - (lens + 1)
        full = np.empty(int((lens + 1).sum()), np.int32)
        for d, s, k in zip(docs, start, range(6)):
            full[s : s + len(d)] = d
            full[s + len(d)] = 10_000 + k
        cols = suffixes.in_shard(full, np.repeat(np.arange(6), lens + 1), start, np.arange(6), 50, 64)
        covered = {(int(b), int(w)) for b, s, _, _, n in zip(*cols) for w in range(s, s + n)} | {(int(a), int(w)) for _, _, a, s, n in zip(*cols) for w in range(s, s + n)}
        for (a, b), ws in longest_runs([(i, " ".join(map(str, d))) for i, d in enumerate(docs)], 50).items():
            assert {(b, w) for w in ws} <= covered


def brute_chain(b, a, n, cost):
    score = []
    for j in range(len(b)):
        best = 0.0
        for i in range(j):
            if b[i] + n[i] <= b[j] and a[i] + n[i] <= a[j]:
                best = max(best, score[i] - cost * (b[j] - b[i] - n[i] + a[j] - a[i] - n[i]))
        score.append(n[j] + best)
    return max(score)


def test_chain_against_quadratic():
    rng = np.random.default_rng(2)
    for _ in range(200):
        m = int(rng.integers(1, 25))
        b, a, n = rng.integers(0, 200, m), rng.integers(0, 200, m), rng.integers(4, 20, m)
        order = np.lexsort((a, b))
        b, a, n = b[order], a[order], n[order]
        assert abs(chain(b, a, n, 0.15)[0][0] - brute_chain(b, a, n, 0.15)) < 1e-6


def test_fuzzy_passages_find_planted_ones(spark):
    rng = random.Random(8)
    word = lambda: f"v{rng.randrange(5000)}"
    shared = [word() for _ in range(90)]
    rows = []
    for d in range(40):
        t = [word() for _ in range(150)]
        if d % 4 == 0:
            p = list(shared)
            for k in rng.sample(range(90), 3):  # some words differ
                p[k] = word()
            t[60:60] = p
        rows.append((d, " ".join(t)))
    df = spark.createDataFrame(rows, DDL)
    got = fuzzy_passages(df).collect()
    later = {r.doc_id for r in got}
    assert later == {d for d in range(4, 40, 4)}
    for d in later:
        hit = set().union(*[range(r.start_word, r.end_word) for r in got if r.doc_id == d])
        assert len(hit & set(range(60, 150))) >= 80 and len(hit - set(range(60, 150))) <= 8
    left = {r.doc_id: r.text for r in without_passages(df).collect()}
    assert left[0] == rows[0][1] and all(150 <= len(left[d].split()) <= 165 for d in later)
    assert all(left[d] == rows[d][1] for d in range(40) if d % 4)


@pytest.mark.parametrize("gap", [40, 100, 150])
def test_two_passages_of_the_same_documents_with_other_words_between(spark, gap):
    rng = random.Random(gap)
    word = lambda: f"v{rng.randrange(100_000)}"
    rows, want = [], {}
    for d in range(0, 40, 2):
        one, two = [word() for _ in range(60)], [word() for _ in range(60)]
        for k in (d, d + 1):
            rows.append((k, " ".join([word() for _ in range(30)] + one + [word() for _ in range(gap)] + two + [word() for _ in range(30)])))
        want[d + 1] = {*range(30, 90), *range(90 + gap, 150 + gap)}
    have = {}
    for r in fuzzy_passages(spark.createDataFrame(rows, DDL)).collect():
        have.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
        assert r.identity >= 0.8 and r.end_word - r.start_word >= 50
    assert sum(len(ws & have.get(d, set())) for d, ws in want.items()) >= 0.95 * sum(map(len, want.values()))
    assert sum(len(ws - want.get(d, set())) for d, ws in have.items()) <= 0.05 * sum(map(len, want.values()))


def test_a_longer_chain_hides_no_passage_within_it(spark):
    """Document 3 holds X P Y: P is document 1's, X and Y are document 2's, with other words between."""
    x, p, y = ([f"{c}{i}" for i in range(n)] for c, n in (("x", 30), ("p", 60), ("y", 30)))
    rows = [(1, " ".join(p)), (2, " ".join(x + [f"o{i}" for i in range(60)] + y)), (3, " ".join(x + p + y))]
    got = {tuple(r) for r in fuzzy_passages(spark.createDataFrame(rows, DDL)).collect()}
    assert got == {(3, 30, 90, 1, 0, 60, 60, 1.0)}


@pytest.mark.parametrize("n,identity", [(55, 0.8), (55, 0.9), (70, 0.85), (90, 0.8), (100, 0.95)])
def test_recall_of_passages_with_substituted_words(spark, n, identity):
    rng = random.Random(n * 100 + int(identity * 100))
    word = lambda: f"v{rng.randrange(1_000_000)}"
    rows, want = [], set()
    for d in range(0, 300, 2):
        p = [word() for _ in range(n)]
        q = [x if rng.random() < identity else word() for x in p]
        same = [x == y for x, y in zip(p, q)]
        # brute force: any stretch of 50 words or more that is alike enough
        if any(sum(same[i:j]) >= 0.8 * (j - i) for i in range(n) for j in range(i + 50, n + 1)):
            want.add(d + 1)
        rows += [(k, " ".join([word() for _ in range(80)] + x + [word() for _ in range(80)])) for k, x in ((d, p), (d + 1, q))]
    got = {r.doc_id for r in fuzzy_passages(spark.createDataFrame(rows, DDL)).collect()}
    assert got <= {d + 1 for d in range(0, 300, 2)} and len(got & want) >= 0.9 * len(want)


def test_fuzzy_passages_hold_the_exact_ones(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    have = {}
    for r in fuzzy_passages(docs).collect():
        have.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    want = {}
    for (a, b), ws in longest_runs([(r.doc_id, r.text) for r in docs.collect()], 50).items():
        want.setdefault(b, set()).update(ws)
    total = sum(map(len, want.values()))
    assert total and sum(len(ws & have.get(d, set())) for d, ws in want.items()) >= 0.9 * total


def test_packed_places():
    rng = np.random.default_rng(6)
    ids, who, a, b = rng.integers(-(1 << 62), 1 << 62, 50), rng.integers(0, 50, 300), rng.integers(0, 1 << 32, 300), rng.integers(0, 70_000, 300)
    got = unpack(pack(ids, who, a, b), 2)
    assert (got[0] == ids[who]).all() and (got[1] == a).all() and (got[2] == b).all()


def test_matches_by_batch_and_by_part(spark):
    """However the rows lie in batches, each place of a seed but those of the least id is matched with one of it or of another."""
    rng = random.Random(11)
    p = [f"p{i}" for i in range(60)]
    rows = [(d, " ".join([f"v{rng.randrange(10**6)}" for _ in range(30)] + p + (p if d % 3 == 0 else []))) for d in range(300)]
    rng.shuffle(rows)
    for n in (1, 7):
        got = matches(seeds(spark.createDataFrame(rows, DDL).repartition(n), 5, 12, 8)).collect()
        assert all(r.doc_a < r.doc_b and (r.b_pos - r.a_pos) % 60 == 0 for r in got)
        by = {}
        for r in got:
            by.setdefault(r.doc_b, set()).add(r.b_pos)
        sampled = {x for x in by[1]}
        assert set(by) == set(range(1, 300)) and all(by[d] >= sampled for d in by) and all(by[d] >= {x + 60 for x in sampled} for d in by if d % 3 == 0)
        assert len(got) < 400 * 60 * 2


def edge_rows():
    p = " ".join(f"w{i}" for i in range(70))
    return [(None, p, 1), (1, None, 2), (2, "", 3), (3, " \t\n", 4), (4, p, 5), (5, "a " + p + " b", 6), (5, "a " + p + " b", 6), (6, "same " * 300, None), (7, "same " * 300, 7), (8, " ".join(f"z{i}" for i in range(150_000)), 8)]


def test_defined_results(spark):
    df = spark.createDataFrame(edge_rows(), DDL + ", n_chars long").selectExpr("*", "n_chars AS __cut", "n_chars AS __gone", "n_chars AS link", "n_chars AS h")
    exact = {(r.source_id, r.doc_id) for r in repeats(df).collect()}
    assert exact == {(4, 5), (6, 7)}
    assert {r.doc_id for r in fuzzy_passages(df).collect()} >= {5}
    left = without_passages(df)
    assert left.columns == df.columns
    rows = {r.doc_id: r for r in left.collect()}
    assert rows[5].text == "a b" and rows[5].n_chars == 3 and rows[4].text == edge_rows()[4][1]
    assert sum(r.doc_id == 5 for r in left.collect()) == 2 and {None, 1, 2, 3, 4, 5, 6, 8} <= set(rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], DDL)
    assert repeats(df).count() == 0 and fuzzy_passages(df).count() == 0 and without_passages(df).count() == 0


def test_passages_whose_seeds_all_lie_in_other_documents_too(spark):
    """Documents 500 and 900 share P. Lines of P are in documents before and between them, so that no seed of P links the two."""
    rng = random.Random(12)
    word = lambda: f"v{rng.randrange(10**6)}"
    p = [word() for _ in range(60)]
    noise = lambda: [word() for _ in range(60)]
    rows = [(500, " ".join(noise() + p + noise())), (900, " ".join(noise() + p + noise()))]
    for i in range(0, 60, 4):
        line = p[i : i + 9]  # each five words of P lie in one of these
        rows += [(i, " ".join(noise() + line + noise())), (600 + i, " ".join(noise() + line + noise()))]
    for n in (1, 5):
        got = [tuple(r)[:6] for r in fuzzy_passages(spark.createDataFrame(rows, DDL).repartition(n)).collect()]
        assert got == [(900, 60, 120, 500, 60, 120)]


def test_runs_of_one_word_are_matched_by_their_ends(spark, tmp_path):
    """Runs of n and m places of a seed give two matches, not n * m, and every copy is found over the shorter one's words."""
    word = iter(f"v{i}" for i in range(10**6))
    n = {d: 60 + 37 * d % 101 for d in range(20)}
    rows = [(d, " ".join([next(word) for _ in range(70)] + ["same"] * n[d] + [next(word) for _ in range(70)])) for d in n]
    docs = spark.createDataFrame(rows, DDL).coalesce(1)
    (tmp_path / "keys").mkdir()
    matches(seeds(docs, 5, 12, 8), f"{tmp_path}/keys").count()
    nothing = spark.createDataFrame([], OUT)
    ((name, least, most),) = blocks(docs, nothing, str(tmp_path), 5, 12)
    block = opened(name)
    got = list(candidates(block, block, 5, 40))
    assert (least, most) == (0, 19) and len({g[:2] for g in got}) == len(got) == 190 and all(len(g[2]) <= 2 for g in got)
    assert others(docs, nothing, str(tmp_path), 5, 12, 50, 0.8).columns == [c.split()[0] for c in OUT.split(",")]
    have = {d: set() for d in n}
    for r in fuzzy_passages(docs).collect():
        have[r.doc_id] |= set(range(r.start_word, r.end_word))
    assert all(len(have[d]) >= min(n[d], max(n[a] for a in range(d))) for d in range(1, 20)) and not have[0]


def test_lone_anchors_are_judged_as_align_does():
    """What is told for many anchors at once is what align() finds for each; where it isn't told, the bounds hold all of it."""
    rng = np.random.default_rng(3)
    pairs, kinds = [], {0: 0, 1: 0, 2: 0}
    for _ in range(5000):
        x = rng.integers(0, 1 << 30, int(rng.integers(20, 260))).astype(np.uint32)
        y = np.where(rng.random(len(x)) < rng.choice([0.1, 0.6, 0.8, 0.95]), x, rng.integers(0, 1 << 30, len(x))).astype(np.uint32)
        n = int(rng.integers(5, min(90, len(x) + 1)))
        at = int(rng.integers(0, len(x) - n + 1))
        some = rng.random(n) < 0.9
        some[[0, -1]] = True
        y[at : at + n][some] = x[at : at + n][some]
        head, tail = int(rng.integers(0, min(at, 70) + 1)), int(rng.integers(0, 30))
        pairs.append((x, np.append(y[head:], rng.integers(0, 1 << 30, tail).astype(np.uint32)), at, at - head, n))

    def block(side):
        texts, zeros = [p[side] for p in pairs], np.zeros(chaining.FLANK, np.uint32)
        start = np.cumsum([0] + [len(t) for t in texts[:-1]]) + chaining.FLANK
        return {"words": np.concatenate([zeros, *texts, zeros]), "start": start, "end": start + [len(t) for t in texts]}

    who, pb, pa_, n = np.arange(len(pairs)), *(np.array([p[c] for p in pairs]) for c in (2, 3, 4))
    for (x, y, b, a, m), (kind, lo, hi, hit) in zip(pairs, chaining.lone(block(0), block(1), who, who, pb, pa_, n, 50, 0.8).tolist()):
        link = {"doc_b": 2, "doc_a": 1, "b_from": max(0, b - chaining.FLANK), "a_from": max(0, a - chaining.FLANK), "anchors": np.array([[b], [a], [m]], np.int32).tobytes()}
        want = chaining.align(link, x[link["b_from"] : b + m + chaining.FLANK], y[link["a_from"] : a + m + chaining.FLANK], 50, 0.8)
        kinds[kind] += 1
        if kind == 1:
            assert [tuple(map(int, r[:7])) for r in want] == [(2, lo, hi, 1, lo + a - b, hi + a - b, hit)]
        else:
            assert all(kind == 2 and lo <= r[1] and r[2] <= hi for r in want)
    assert min(kinds.values()) > 10


def test_candidates_keep_to_a_bounded_memory():
    """Each of 300 documents holds one line with most of a passage beside it, so that each pair is looked at closely: by portions,
    with the same groups as at once."""
    rng = np.random.default_rng(5)
    line = rng.integers(0, 1 << 30, 45).astype(np.uint32)
    zeros, n = np.zeros(chaining.FLANK, np.uint32), 300
    texts = [np.concatenate([rng.integers(0, 1 << 30, 150), line, rng.integers(0, 1 << 30, 150)]).astype(np.uint32) for _ in range(n)]
    start = np.arange(n) * 345 + chaining.FLANK
    words = np.concatenate([zeros, *texts, zeros])
    near = (words & 15).astype(np.uint64)
    for k in (1, 2, 4, 8):
        near = near[:-k] | near[k:] << np.uint64(4 * k)
    block = {"key": np.zeros(n, np.uint64), "doc": np.arange(n, dtype=np.int32), "pos": np.full(n, 150, np.int32), "run": np.full(n, 41, np.int32), "out": np.ones(n, bool), "ids": np.arange(n), "start": start, "end": start + 345, "words": words, "near": near}
    peaks = []
    for most in (chaining.WORDS, 1 << 30):
        chaining.WORDS, kept = most, chaining.WORDS
        try:
            tracemalloc.start()
            got = [(g[0], g[1], g[2].tolist(), g[3].tolist()) for g in candidates(block, block, 5, 40)]
            peaks.append((tracemalloc.get_traced_memory()[1], got))
        finally:
            tracemalloc.stop()
            chaining.WORDS = kept
    (small, some), (large, every) = peaks
    assert some == every and len(some) == n * (n - 1) // 2 and small < large * 0.8


def test_groups_hold_on_to_no_more_than_themselves(monkeypatch):
    """300 documents hold one line, 30 of them a passage: the few groups that are kept don't keep all that was looked at."""
    monkeypatch.setattr(chaining, "LOOK", 1 << 10)
    rng = np.random.default_rng(7)
    passage, zeros, n = rng.integers(0, 1 << 30, 60), np.zeros(chaining.FLANK, np.uint32), 300
    texts = [np.concatenate([rng.integers(0, 1 << 30, 150), passage[: 60 if d % 10 == 0 else 8], rng.integers(0, 1 << 30, 150 if d % 10 == 0 else 202)]).astype(np.uint32) for d in range(n)]
    start, words = np.arange(n) * 360 + chaining.FLANK, np.concatenate([zeros, *texts, zeros])
    near = (words & 15).astype(np.uint64)
    for k in (1, 2, 4, 8):
        near = near[:-k] | near[k:] << np.uint64(4 * k)
    block = {"key": np.zeros(n, np.uint64), "doc": np.arange(n, dtype=np.int32), "pos": np.full(n, 150, np.int32), "run": np.full(n, 4, np.int32), "out": np.ones(n, bool), "ids": np.arange(n), "start": start, "end": start + 360, "words": words, "near": near}
    got = list(candidates(block, block, 5, 40))
    assert sorted(g[:2] for g in got) == [(b, a) for b in range(0, n, 10) for a in range(0, b, 10)]
    cols = [c for g in got for c in g[2:]]
    held = {id(x): x.nbytes for x in (c if c.base is None else c.base for c in cols)}
    assert sum(held.values()) <= 2 * sum(c.nbytes for c in cols)
