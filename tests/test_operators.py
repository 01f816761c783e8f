"""Operators without SQL against brute force, and defined edge cases."""

import random
from collections import defaultdict, deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.functions import text as X
from lodestrata.operators import behavioral as B
from lodestrata.operators import centrality as C
from lodestrata.operators import community as K
from lodestrata.operators import graph as G
from lodestrata.operators import convention as V
from lodestrata.operators import risk as R
from lodestrata.operators import salience as S
from lodestrata.operators import sessions as D
from lodestrata.operators.ranking import numbered
from lodestrata.plans.views import calls

EDGES = "src long, dst long, weight double"


def random_edges(seed, n=25, m=70):
    rng = random.Random(seed)
    return [(rng.randrange(n), rng.randrange(n), rng.random()) for _ in range(m)]


def test_pagerank_and_hits_held_and_by_joins(spark, sf):
    e = calls(spark, sf)
    rows = [(r.src, r.dst) for r in e.collect()]
    nodes = sorted({x for e in rows for x in e})
    at = {x: i for i, x in enumerate(nodes)}
    n = len(nodes)
    m, out = np.zeros((n, n)), np.zeros(n)
    for s, d in rows:
        m[at[d], at[s]] += 1
        out[at[s]] += 1
    p = np.full(n, 1 / n)
    for _ in range(6):
        p = 0.15 / n + 0.85 * (m @ np.divide(p, out, out=np.zeros(n), where=out > 0) + p[out == 0].sum() / n)
    for most in (10**6, 0):
        got = {r.node: r["rank"] for r in C.pagerank(e, 6, most_edges=most).collect()}
        assert set(got) == set(nodes) and all(abs(got[x] - p[at[x]]) < 1e-9 for x in nodes)
    # the other rule: a round's sum over all pairs, then made 1
    few = random_edges(8, 12, 25)
    names = sorted({x for s, d, _ in few for x in (s, d)})
    links, outs = {(s, d) for s, d, _ in few}, {x: sum(s == x for s, _, _ in few) for x in names}
    q = {x: 1 / len(names) for x in names}
    for _ in range(2):
        new = {v: sum(sum(s == w and d == v for s, d, _ in few) * 0.85 * q[w] / outs[w] if (w, v) in links else (0.85 if not outs[w] else 0.15) * q[w] / len(names) for w in names) for v in names}
        q = {x: y / sum(new.values()) for x, y in new.items()}
    for most in (10**6, 0):
        got = {r.node: r["rank"] for r in C.pagerank(spark.createDataFrame(few, EDGES), 2, rule="reference", most_edges=most).collect()}
        assert all(abs(got[x] - q[x]) < 1e-9 for x in names)
    one, two = ({r.node: (r.hub, r.authority) for r in C.hits(e, 3, most_edges=most).collect()} for most in (10**6, 0))
    assert set(one) == set(two) == set(nodes) and all(abs(x - y) < 1e-9 for v in one for x, y in zip(one[v], two[v]))


def test_betweenness_against_brute_force(spark):
    rows = random_edges(3)
    near = defaultdict(set)
    for s, d, _ in rows:
        near[s].add(d)
    nodes = {x for s, d, _ in rows for x in (s, d)}
    want = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        dist, sigma, order, pred, q = {s: 0}, defaultdict(float, {s: 1.0}), [], defaultdict(list), deque([s])
        while q:
            v = q.popleft()
            order.append(v)
            for w in near[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    q.append(w)
                if dist[w] == dist[v] + 1:
                    sigma[w] += sigma[v]
                    pred[w].append(v)
        delta = defaultdict(float)
        for w in reversed(order):
            for v in pred[w]:
                delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
            if w != s:
                want[w] += delta[w]
    top = max(want.values())
    got = {r.node: r.betweenness for r in C.betweenness(spark.createDataFrame(rows, EDGES)).collect()}
    assert set(got) == nodes and all(abs(got[x] - want[x] / top) < 1e-9 for x in nodes)
    got = {r.node: r.betweenness for r in C.betweenness(spark.createDataFrame(rows, EDGES), most_edges=0).collect()}
    assert set(got) == nodes and all(abs(got[x] - want[x] / top) < 1e-9 for x in nodes)


def planted(seed, groups=5, size=10):
    rng, rows = random.Random(seed), []
    for c in range(groups):
        for _ in range(6 * size):
            rows.append((c * size + rng.randrange(size), c * size + rng.randrange(size), 1.0))
        rows.append((c * size, (c + 1) % groups * size, 0.2))
    return rows


def q_of(rows, com):
    m = sum(w for *_, w in rows)
    deg = defaultdict(float)
    for s, d, w in rows:
        deg[com[s]] += w
        deg[com[d]] += w
    return sum(w for s, d, w in rows if com[s] == com[d]) / m - sum((x / 2 / m) ** 2 for x in deg.values())


def greedy(rows):
    """Vertices move one at a time, in order, until none moves: the first level of a sequential Louvain."""
    com = {x: x for s, d, _ in rows for x in (s, d)}
    for _ in range(10):
        was = dict(com)
        for v in sorted(com):
            com[v] = max(sorted({com[x] for s, d, _ in rows if v in (s, d) for x in (s, d)}), key=lambda c: round(q_of(rows, com | {v: c}), 12))
        if was == com:
            return com
    return com


def test_louvain_finds_planted_communities(spark):
    rows = planted(1)
    got = {r.node: r.community for r in K.communities(spark.createDataFrame(rows, EDGES)).collect()}
    assert all(len({got[x] for x in got if x // 10 == c}) == 1 for c in range(5)) and len(set(got.values())) == 5
    assert all(com == min(x for x in got if got[x] == com) for com in got.values())


def test_louvain_is_no_worse_than_a_sequential_one(spark):
    over = []
    for seed in range(6):
        rows = random_edges(seed, 30, 60)
        nodes, com = K.louvain(*(np.array(c) for c in zip(*rows)))
        over.append(q_of(rows, dict(zip(nodes.tolist(), com.tolist()))) / q_of(rows, greedy(rows)))
    assert min(over) > 0.9 and sum(over) >= len(over)


def test_louvain_by_joins_gives_the_same(spark):
    rows = [(s * 7 - 100, d * 7 - 100, w) for s, d, w in planted(2, 2, 4)] + [(s + 10**12, d + 10**12, w) for s, d, w in random_edges(9, 5, 8)]
    one, two = ({r.node: r.community for r in K.communities(spark.createDataFrame(rows, EDGES), most_edges=most).collect()} for most in (10**6, 0))
    assert one == two


def test_components_against_union_find(spark):
    rows = random_edges(5, 120, 70)
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for s, d, _ in rows:
        a, b = find(s), find(d)
        root[max(a, b)] = min(a, b)
    for most in (10**6, 0):
        got = {r.node: r.root for r in G.components(spark.createDataFrame(rows, EDGES), most).collect()}
        assert got == {x: find(x) for s, d, _ in rows if s != d for x in (s, d)}


def test_cochange_groups(spark):
    changes = [(c, f) for c in range(10) for f in (1, 2, 3)] + [(c, f) for c in range(20, 26) for f in (7, 8)] + [(40, 9)]
    pairs = B.cochange_pairs(spark.createDataFrame(changes, "commit long, file long"))
    got = sorted((r.members, r.arity) for r in B.cochange_groups(pairs).collect())
    assert got == [([1, 2, 3], 3), ([7, 8], 2)]


def test_bus_factor_at_the_edge(spark):
    rows = [(c, 1, "a" if c < 8 else "b") for c in range(10)] + [(c, 2, None) for c in range(3)]
    got = {r.file: r for r in B.contributor_concentration(spark.createDataFrame(rows, "commit long, file long, author string")).collect()}
    assert got[1].bus_factor == 1 and got[1].top_contributor_share == 0.8 and 2 not in got


def test_numbering_holds_across_partitions(spark):
    df = spark.range(1000).withColumn("k", F.col("id") * 7919 % 1000).repartition(7)
    assert all(r.k + 1 == r.n for r in numbered(df, "n", F.col("k")).collect())


@pytest.mark.parametrize("text,want", [("", 0xCBF29CE484222325), ("a", 0xAF63DC4C8601EC8C), ("foobar", 0x85944171F73967E8)])
def test_fnv_published_values(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(X.fnv1a64("t").alias("h")).first().h
    assert got % (1 << 64) == want


def test_names_and_paths(spark):
    style = {"snake_name": "snake_case", "MAX_SIZE": "SCREAMING_SNAKE_CASE", "PascalName": "PascalCase", "HTTP": "PascalCase", "camelName": "camelCase", "lower": "lowercase", "x_Y": "mixed", "-Name": "mixed", "": "unknown"}
    df = spark.createDataFrame([(k,) for k in style], "n string").select("n", X.name_style(F.col("n")).alias("s"))
    assert {r.n: r.s for r in df.collect()} == style
    b = spark.createDataFrame([("né" * 6,)], "t string").select(X.byte_prefix(10)("t").alias("p")).first().p
    assert b == "nénéné" + "n" and len(b.encode()) <= 10


def test_import_resolution(spark):
    files = spark.createDataFrame([("src/util.rs",), ("src/a/mod.rs",), ("src/a/b.rs",), ("src/c/b.rs",), ("src/only.rs",)], "path string")
    imports = spark.createDataFrame([("src/a/x.rs", "src/util.rs"), ("src/a/x.rs", "crate::util"), ("src/a/y/z.rs", "super::b"), ("src/q.rs", "foo::b"), ("src/q.rs", "foo::only"), ("src/q.rs", "serde")], "importer string, target string")
    got = {(r.importer, r.target): (r.path, r.confidence) for r in R.resolve_imports(imports, files).collect()}
    assert got["src/a/x.rs", "src/util.rs"] == ("src/util.rs", 0.9) and got["src/a/x.rs", "crate::util"][0] == "src/util.rs" and got["src/a/y/z.rs", "super::b"][0] == "src/a/b.rs"
    assert got["src/q.rs", "foo::b"] == (None, 0.8) and got["src/q.rs", "foo::only"][0] == "src/only.rs" and got["src/q.rs", "serde"][0] is None


def test_empty_inputs(spark):
    e = spark.createDataFrame([], EDGES)
    assert C.pagerank(e).count() == 0 and C.betweenness(e).count() == 0 and K.communities(e).count() == 0 and G.components(e).count() == 0
    c = spark.createDataFrame([], "commit long, file long, author long, ts timestamp, added double, deleted double")
    assert B.change_frequency(c).count() == 0 and B.churn_velocity(c).count() == 0 and B.cochange_pairs(c).count() == 0


def column(spark, rows, ddl, what):
    """What an expression gives for each row."""
    return [r.x for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {ddl}").orderBy("i").select(what.alias("x")).collect()]


def test_salience_classes_and_risk_scores(spark):
    want = {"HotCritical": [(8, 8, 5)], "FoundationalStable": [(8, 2, 5)], "ActiveLocalized": [(2, 8, 5), (2, 8, 10)], "Background": [(2, 2, 5), (2, 2, 10)], "CriticalSilo": [(8, 2, 10), (8, 8, 10)]}
    rows = [(c, *[v / 10 for v in x]) for c, xs in want.items() for x in xs]
    assert column(spark, rows, "c string, p double, f double, b double", S.salience_class(F.col("p"), F.col("f"), F.col("b"))) == [r[0] for r in rows]
    risk = [(0.1, 5, 2, 0.04, "low"), (0.9, 1, 25, 0.96, "critical"), (1.0, 1, 100, 1.0, "critical"), (0.5, 2, 11, 0.55, "medium"), (0.3, None, 6, 0.22, "low"), (None, 1, None, 0.3, "medium"), (0.71, 3, 12, 0.484, "high")]
    ddl = "s double, b int, n int, g double, l string"
    assert column(spark, risk, ddl, S.gate_score(F.col("s"), F.col("b"), F.col("n"))) == [r[3] for r in risk]
    assert column(spark, risk, ddl, S.risk_level(F.col("s"), F.col("b"), F.col("n"))) == [r[4] for r in risk]


def test_three_predicates_of_tests_and_their_sources(spark):
    rows = [("src/auth_test.rs", True, "src/auth.rs"), ("tests/all.rs", True, None), ("test_utils.py", True, "utils.py"), ("a/utils_test.py", True, "a/utils.py"), ("App.test.tsx", True, "App.tsx"), ("src/App.spec.ts", True, "src/App.ts"), ("pkg/handler_test.go", True, "pkg/handler.go"),
            ("src/__tests__/App.js", True, None), ("UserTest.java", True, None), ("src/auth.rs", False, None), ("utils.py", False, None), ("App.tsx", False, None), ("contest_x.py", False, None), ("x_spec.rb", False, None)]
    ddl = "p string, t boolean, s string"
    assert column(spark, rows, ddl, X.is_test_file(F.col("p"))) == [r[1] for r in rows]
    assert column(spark, rows, ddl, X.source_of_test(F.col("p"))) == [r[2] for r in rows]
    assert column(spark, [("contest_x.py",), ("x_spec.rb",), ("tests/a.rs",), ("a/test/b",)], "p string", X.has_test_mark(F.col("p"))) == [True, True, False, True]
    assert column(spark, [("latest.py",), ("a/Spec/b",), ("a.py",)], "p string", X.mentions_test(F.col("p"))) == [True, True, False]


def test_tested_by_stems_anywhere(spark):
    files = ["src/a.rs", "src/auth.rs", "lib/.env", "src/long_module_name.rs", "tests/auth_flow.rs", "x/my_long_module_name_test.go", "src/none.zz"]
    got = {r.file: r.has_test for r in R.tested(spark.createDataFrame([(f,) for f in files], "file string")).collect()}
    assert got == {f: any(f.split("/")[-1].split(".")[0] in t for t in files if "test" in t.lower() or "spec" in t.lower()) for f in files}
    assert got["lib/.env"] and got["src/a.rs"] and got["src/long_module_name.rs"] and not got["src/none.zz"]
    customs = {r.file: r.has_test for r in R.tested(spark.createDataFrame([("a/x.py",), ("a/test_x.py",), ("a/y.py",)], "file string"), rule="customs").collect()}
    assert customs["a/x.py"] and not customs["a/y.py"]


def test_reverts(spark):
    """Interactions that modify nothing are passed over; a file named twice in one is no revert of itself."""
    data = [(0, ["a", "a"]), (1, []), (2, []), (3, []), (4, ["a"]), (5, ["b"]), (6, ["c"]), (7, ["d"]), (8, ["e"]), (9, ["b"]), (10, [])]
    want = set()
    for i, m in data:
        for j, n in data[i + 1 :]:
            if m and n:
                if set(m) & set(n):
                    want.add(i)
                    break
                if j - i > 2:
                    break
    got = {r.i for r in D.reverts(spark.createDataFrame([("s", i, m) for i, m in data], "session string, i int, modified array<string>")).collect() if r.reverted}
    assert got == want == {0}


def test_test_frameworks(spark):
    at = lambda rows: V.test_framework(spark.createDataFrame(rows, "path string, content string")).first().framework
    assert at([("go.mod", ""), ("pyproject.toml", "[tool.pytest]")]) == "pytest" and at([("package.json", '{"vitest": 1}'), ("Cargo.toml", "x")]) == "vitest"
    assert at([("Cargo.toml", "[package]"), ("package.json", '"jest"')]) == "cargo test" and at([("App.csproj", "")]) == "dotnet test" and at([("README.md", "pytest")]) is None
