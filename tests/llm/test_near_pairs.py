"""Operator 7 against all pairs' exact likeness."""

import itertools
import random

import pytest

from lodestrata.llm.common import WordHashes, bands_for
from lodestrata.llm.jaccard import gram_set, near_documents, near_pairs, one_of_each

DDL = "doc_id long, text string"


def exact(rows, n=3, threshold=0.6):
    words = WordHashes(fold=True)
    sets = [(d, set(gram_set(t, n, words).tolist())) for d, t in rows if d is not None]
    out = {}
    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if a != b and x and y and (j := len(x & y) / len(x | y)) >= threshold:
            k = min(a, b), max(a, b)
            out[k] = max(out.get(k, 0), j)
    return out


def groups(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in sorted(pairs):
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


def classes(rows):
    """The classes of equal sets: {set: ids}."""
    words = WordHashes(fold=True)
    out = {}
    for d, t in rows:
        if d is not None and t and (g := gram_set(t, 3, words)).size:
            out.setdefault(tuple(g.tolist()), set()).add(d)
    return out


def between_classes(rows, want):
    """What near_pairs has to list: pairs of least ids of classes that are alike, and members with their least id."""
    by = {d: {min(ids) for ids in classes(rows).values() if d in ids} for d in {d for d, _ in rows}}
    ends = {(min(x, y), max(x, y)) for (a, b) in want for x in by[a] for y in by[b] if x != y} & set(want)
    return ends | {(min(ids), d) for ids in classes(rows).values() for d in ids if d != min(ids)}


def documents(rows, threshold=0.6):
    """near_documents by brute force."""
    sets = [(set(g), ids) for g, ids in classes(rows).items()]
    edges, links = set(), {}
    for i, (x, xs) in enumerate(sets):
        edges |= {(min(xs), d) for d in xs}
        n = len(xs) - 1
        for j, (y, ys) in enumerate(sets):
            if i != j and len(x & y) / len(x | y) >= threshold:
                n += len(ys)
                edges.add((min(min(xs), min(ys)), max(min(xs), min(ys))))
        for d in xs:
            links[d] = links.get(d, 0) + n
    roots = groups(edges)
    return {d: (roots[d], n) for d, n in links.items() if n}


def test_against_all_pairs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = exact(rows)
    got = {(r.doc_a, r.doc_b): r.jaccard for r in near_pairs(docs).collect()}
    assert len(want) > 5
    assert set(got) <= set(want)  # no pair under the threshold
    assert all(abs(got[k] - want[k]) < 1e-6 for k in got)
    listed = between_classes(rows, want)
    assert len(set(got) & listed) >= 0.95 * len(listed)
    assert {(r.doc_id, r.class_id) for r in near_documents(docs).collect()} == set(groups(got).items())


def test_every_pair_of_a_cluster(spark):
    """40 texts of one origin, pairs about the threshold: pairs are held against brute force, not groups."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for d in range(40):
        words = list(base)
        for at in rng.sample(range(200), 9):
            words[at] = f"x{rng.randrange(10**6)}"
        rows.append((d, " ".join(words)))
    want = exact(rows)
    df = spark.createDataFrame(rows, DDL)
    got = {(r.doc_a, r.doc_b): r.jaccard for r in near_pairs(df).collect()}
    assert set(got) <= set(want) and len(want) > 300 and len(got) >= 0.95 * len(want)
    docs = {r.doc_id: (r.class_id, r.links) for r in near_documents(df).collect()}
    assert sum(n for _, n in docs.values()) == 2 * len(got) and {c for c, _ in docs.values()} == {0}


def test_every_pair_of_large_groups(spark):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(base[: i % 190] + [f"x{i}"] + base[i % 190 + 1 :])) for i in range(300)] + [(1000 + i, " ".join(base)) for i in range(50)]
    # common boilerplate in unlike texts, of which some have near copies
    plate = [f"b{i}" for i in range(60)]
    for d in range(2000, 2200, 2):
        own = [f"o{rng.randrange(10**6)}" for _ in range(50)]
        rows += [(d, " ".join(plate + own)), (d + 1, " ".join(plate + own[:-3]))]
    # an id with two rows, of which each has near copies
    rows += [(5000, " ".join(base)), (5000, " ".join(plate)), (5001, " ".join(plate))]
    want = exact(rows)
    listed = between_classes(rows, want)
    df = spark.createDataFrame(rows, DDL)
    got = {(r.doc_a, r.doc_b): r.jaccard for r in near_pairs(df).collect()}
    assert set(got) <= set(want) and all(abs(got[k] - want[k]) < 1e-6 for k in got)
    assert len(set(got) & listed) >= 0.95 * len(listed) and len(listed) > 300 * 299 // 2
    plates = {k for k in listed if k[0] >= 2000}
    assert sum(k in got for k in plates) >= 0.9 * len(plates)
    docs, truth = {r.doc_id: (r.class_id, r.links) for r in near_documents(df).collect()}, documents(rows)
    assert set(docs) <= set(truth) and all(n <= truth[d][1] for d, (_, n) in docs.items())
    assert sum(docs.get(d) == x for d, x in truth.items()) >= 0.9 * len(truth)
    assert {docs[d] for d in range(1000, 1050)} == {(0, 350)} and docs[5000][0] == docs[5001][0] == 0


def test_defined_results(spark):
    t = " ".join(f"w{i}" for i in range(40))
    rows = [(None, t, 1), (1, None, 2), (2, "", 3), (3, "  \n ", 4), (4, t, 5), (4, t, 6), (5, t.upper() + ".", 7), (6, t, None), (7, "one", 8), (8, "one", 9), (9, " ".join(f"z{i}" for i in range(200_000)), 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, bands long").withColumnsRenamed({}).selectExpr("*", "bands AS __gone", "bands AS rep", "bands AS a", "bands AS doc_a")
    got = {(r.doc_a, r.doc_b) for r in near_pairs(df).collect()}
    assert groups(got) == {4: 4, 5: 4, 6: 4, 7: 7, 8: 7}
    assert {tuple(r) for r in near_documents(df).collect()} == {(4, 4, 2), (5, 4, 2), (6, 4, 2), (7, 7, 1), (8, 7, 1)}
    left = one_of_each(df)
    assert left.columns == df.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in left.collect()) == [(False, x) for x in (1, 2, 3, 4, 4, 7, 9)] + [(True, 0)]


def test_empty_table(spark):
    df = spark.createDataFrame([], DDL)
    assert near_pairs(df).count() == 0 and near_documents(df).count() == 0 and one_of_each(df).count() == 0


@pytest.mark.parametrize("threshold,recall", [(0.5, 0.9), (0.6, 0.95), (0.8, 0.99)])
def test_bands_reach_the_recall(threshold, recall):
    b, r = bands_for(threshold, recall)
    assert 1 - (1 - threshold**r) ** b >= recall - 1e-9
