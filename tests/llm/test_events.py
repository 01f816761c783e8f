"""Operator 6 against folding events one by one, and against its SQL."""

import random

import duckdb

from lodestrata.llm.events import ORACLE, chats, messages, op6_chats, to_log

DDL = "conv_id long, seq long, kind string, turn long, role string, payload string"


def fold(rows):
    seen = {}
    for r in rows:
        c, s, k, t, role, p = r
        if None not in (c, s, k, t) and k in ("open", "delta", "regenerate", "edit"):
            p = (p or "") if k in ("delta", "edit") else ""
            seen.setdefault((c, s), set()).add((k, p, t, role))
    state = {}
    for (c, s), es in sorted(seen.items()):
        for k, p, t, role in sorted(es, key=lambda e: (e[0], e[1])):
            conv = state.setdefault(c, {})
            if k == "open":
                conv[t] = [role, ""]
                continue
            if k == "delta":
                if t in conv:
                    conv[t][1] += p
                continue
            for later in [x for x in conv if x > t]:
                del conv[later]
            if t in conv:
                conv[t][1] = p
    return {(c, t): (role or "unknown", text) for c, conv in state.items() for t, (role, text) in conv.items()}


def test_against_step_by_step(spark):
    rng = random.Random(4)
    rows = []
    for c in range(60):
        opened = 0
        for s in range(rng.randrange(1, 60)):
            k = rng.choice(["open", "delta", "delta", "delta", "regenerate", "edit"])
            if k == "open":
                t, opened = opened, opened + 1
            else:
                t = rng.randrange(max(1, opened))
            rows.append((c, s, k, t, "user" if t % 2 == 0 else "assistant", None if k in ("open", "regenerate") else rng.choice(["a", "bc ", "", None])))
    rng.shuffle(rows)
    rows += rows[:200]  # delivered twice
    got = {(r.conv_id, r.turn): (r.role, r.text) for r in messages(spark.createDataFrame(rows, DDL).repartition(5)).collect()}
    assert got == fold(rows)


def test_log_leads_to_the_table(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    cur = con.execute(ORACLE)
    names = [c[0] for c in cur.description]
    assert sorted(tuple(r) for r in op6_chats(spark, sf).select(*names).collect()) == sorted(cur.fetchall())
    kinds = {r.kind for r in to_log(spark.read.parquet(f"{sf}/conversations.parquet")).select("kind").distinct().collect()}
    assert kinds == {"open", "delta", "regenerate", "edit"}


def test_defined_results(spark):
    rows = [
        (1, 1, "open", 0, None, None), (1, 2, "delta", 0, "user", None), (1, 3, "delta", 0, "user", "<|end|>x"), (None, 1, "open", 0, "user", None), (1, None, "delta", 0, "user", "no"),
        (1, 5, "delta", None, "user", "no"), (1, 6, None, 0, "user", "no"), (1, 7, "other", 0, "user", "no"), (1, 8, "delta", 9, "user", "never opened"), (2, 1, "delta", 0, "user", "never opened"),
        (3, 1, "open", 0, "user", ""), (3, 2, "delta", 0, "user", "b"), (3, 2, "delta", 0, "user", "a"), (4, 1, "open", 0, "user", ""), (4, 2, "delta", 0, "user", "long " * 200_000),
    ]
    df = spark.createDataFrame(rows, DDL).selectExpr("*", "seq AS reset", "seq AS cut", "seq AS events", "seq AS line")
    got = {r.conv_id: r.chat for r in chats(df).collect()}
    assert got[1] == "<|unknown|>\n< |end|>x<|end|>" and 2 not in got and got[3] == "<|user|>\nab<|end|>" and len(got[4]) > 1_000_000
    assert chats(spark.createDataFrame([], DDL)).count() == 0
    c = spark.createDataFrame([(1, 0, None, None), (1, 0, "user", "b"), (None, 1, "user", "x"), (2, None, "user", "x"), (3, 0, "user", "")], "conv_id long, turn long, role string, text string")
    assert {r.conv_id for r in chats(to_log(c)).collect()} == {1, 3}
