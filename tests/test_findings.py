"""What reviews of results and of large tables found."""

import datetime
import math
import random

import duckdb

from lodestrata.operators import behavioral as B
from lodestrata.operators import sessions as D
from lodestrata.operators import temporal as T
from lodestrata.plans import registry

registry.load()


def test_slopes_of_whole_numbers_are_exact(spark):
    """Churn that is symmetrical but for a half line a month has a slope of just 0.5, which isn't "increasing"."""
    rng, now, rows = random.Random(3), datetime.datetime(2024, 1, 1), []
    for f in range(60):
        half = [rng.randrange(1000) for _ in range(rng.randrange(3, 30))]
        for i, y in enumerate(half + half[::-1]):
            rows.append((f, now - datetime.timedelta(days=60 * i), float(y + i), 0.0))
    got = B.churn_velocity(spark.createDataFrame(rows, "file long, ts timestamp_ntz, added double, deleted double")).collect()
    assert {(r.slope, r.slope_time_forward, r.trend) for r in got} == {(0.5, -0.5, "stable")} and len(got) == 60
    # what isn't whole, one month and no numbers
    t, m = datetime.datetime(2024, 1, 1), datetime.timedelta(days=30)
    few = [(1, t, 0.25, 0.5), (1, t - m, 1.0, 0.25), (2, t, 5.0, 0.0), (2, t, 6.0, 0.0), (3, t, None, None), (3, t - m, None, None), (4, t, None, None), (4, t - m, 1.0, 2.0), (4, t - 2 * m, 2.0, 3.0)]
    got = B.churn_velocity(spark.createDataFrame(few, "file long, ts timestamp_ntz, added double, deleted double")).collect()
    assert {r.file: r.slope for r in got} == {1: 0.5, 3: 0.0, 4: 2.0}


def test_a_slope_that_rounds_to_zero_keeps_its_sign(spark, tmp_path):
    con = duckdb.connect()
    con.execute("CREATE TABLE orders AS SELECT i AS o_orderkey, 1 AS o_custkey, TIMESTAMP '2024-01-01' - INTERVAL 30 DAY * i AS o_orderdate FROM range(1001) t(i)")
    con.execute("CREATE TABLE lineitem AS SELECT * FROM (VALUES (0, 1, 5.0001::DOUBLE, 0.0::DOUBLE), (1000, 1, 5, 0), (0, 2, 7, 0), (1000, 2, 7, 0), (0, 3, 5, 0), (1000, 3, 5.0001, 0)) t(l_orderkey, l_suppkey, l_quantity, l_discount)")
    for t in ("lineitem", "orders"):
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    key = lambda r: (r[0], *(math.copysign(1, x) if x == 0 else 9 for x in r[1:3]), *r[3:])
    want = sorted(key(r) for r in con.execute(registry.ORACLES["a4_churn_velocity"]).fetchall())
    got = sorted(key(tuple(r)) for r in registry.QUERIES["a4_churn_velocity"](spark, str(tmp_path)).collect())
    assert got == want and [r[1:3] for r in want] == [(-1.0, 1.0), (1.0, -1.0), (1.0, -1.0)]


def test_overlapping_spans_against_brute_force(spark):
    rng = random.Random(5)

    def spans(n):
        out = []
        for i in range(n):
            at, long = rng.randrange(-300, 300), rng.choice([0, 1, 2, 3, 7, 8, 40, 64, 500])
            out.append((rng.choice("xy"), i, (at, at + long)))
        return out + [("x", n, (None, 5)), ("y", n, (9, 2))]

    a, b = spans(60), spans(50)
    span = "struct<start: long, end: long>"
    got = T.overlaps(spark.createDataFrame(a, f"kind string, old_name long, o {span}"), spark.createDataFrame(b, f"kind string, name long, n {span}"))
    want = sorted((i, j) for k, i, o in a for m, j, n in b if k == m and None not in (*o, *n) and min(o[1], n[1]) > max(o[0], n[0]))
    assert sorted((r.old_name, r.name) for r in got.collect()) == want and len(want) > 200


def test_definitions_are_not_compared_all_with_all(spark):
    """Spans far from each other don't meet, however many; nor under one that holds all."""
    n = 60_000
    k = spark.range(n)
    old = k.selectExpr("concat('o', id) AS name", "'f' AS kind", "id * 100 AS start", "id * 100 + 50 AS end").union(k.limit(1).selectExpr("'z'", "'f'", "0L", f"{n * 100}L"))
    new = k.selectExpr("concat('n', id) AS name", "'f' AS kind", "id * 100 + 20 AS start", "id * 100 + 50 AS end")
    got = {(r.change, r["count"]) for r in T.definitions_diff(old, new).groupBy("change").count().collect()}
    assert got == {("renamed", n), ("removed", 1)}


def test_pairs_and_groups_of_files_by_as_many_tasks_as_they_need(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(c, rng.randrange(30)) for c in range(40) for _ in range(rng.choice([1, 3, 6, 40]))]
    changes = spark.createDataFrame(rows, "commit long, file long")
    by, pairs = {}, {}
    for c, f in rows:
        by.setdefault(c, set()).add(f)
    for fs in by.values():
        for a in fs:
            for b in fs:
                if a < b:
                    pairs[a, b] = pairs.get((a, b), 0) + 1
    monkeypatch.setattr(B, "ROWS", 50)
    monkeypatch.setattr(B, "PAIRS", 100)
    got = B.cochange_pairs(changes, 2, 0.0)
    assert {(r.a, r.b): r.co_occurrences for r in got.collect()} == {p: n for p, n in pairs.items() if n > 1}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    most = sum(n * (n - 1) // 2 for n in (sum(c == x for c, _ in rows) for x in by))
    assert f"], {most // 100 + 1}\n" in plan and f"], {len(rows) // 50 + 1}\n" in plan
    groups = spark.createDataFrame([([1, 2], 2), ([3, 4, 5], 3), ([1, 99], 2)], "members array<long>, arity int")
    got = {tuple(r.members): r.co_occurrences for r in B.group_cooccurrence(changes, groups).collect()}
    assert got == {g: n for g in [(1, 2), (3, 4, 5)] if (n := sum(set(g) <= fs for fs in by.values()))}
    assert B.group_cooccurrence(changes.limit(0), groups).count() == B.group_cooccurrence(changes, groups.limit(0)).count() == 0


def test_sessions_and_commits_meet_without_a_shuffle_of_pairs(spark):
    rng, at = random.Random(2), datetime.datetime(2024, 1, 1)
    hour = lambda: at + datetime.timedelta(hours=rng.randrange(70))
    ss = [(u, t, rng.choice([*range(5), None])) for u in [*range(9), None] for t in [hour()] for _ in range(4)] + [(u, hour(), rng.randrange(5)) for u in range(7, 12) for _ in range(4)]
    cs = [(c, hour(), rng.randrange(5)) for c in range(30)] + [(c, t, rng.randrange(6)) for c in [*range(30, 40), None] for t in [hour()] for _ in range(4)] + [(c, hour(), rng.randrange(5)) for c in range(25, 32)]
    got = D.near_commits(spark.createDataFrame(ss, "session long, ts timestamp_ntz, file long"), spark.createDataFrame(cs, "commit long, ts timestamp_ntz, file long"))
    day, want = datetime.timedelta(hours=24), {}
    for u, t, f in ss:
        for c, x, g in cs:
            if u is not None and f is not None and f == g and t <= x <= t + day:
                want.setdefault((u, c), set()).add(f)
    of = {u: {f for v, _, f in ss if v == u and f is not None} for u, _, _ in ss}
    rows = got.collect()
    assert {(r.session, r.commit): (r.shared, r.confidence) for r in rows} == {k: (len(v), round(len(v) / len(of[k[0]]), 6)) for k, v in want.items()} and len(rows) == len(want)
    # no sum over pairs stands between the result and the union's first part
    first = got._jdf.queryExecution().optimizedPlan().toString().split("Union")[1].split("Join Inner")[0]
    assert "Aggregate" not in first and "Join" not in first
