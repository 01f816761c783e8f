"""Operator 1 against its SQL and against a step-by-step version."""

import hashlib
import re

import duckdb

from lodestrata.llm.mixing import ORACLE, mixed, mixture, op1_mixture

DDL = "doc_id long, text string, lang string, source string"
WEIGHTS = ({"web": 4, "news": 2, "books": 3, "reference": 1}, {"en": 5, "de": 2, "fr": 2, "es": 1}, {"src0": 2})


def share(budget, kids):
    """kids: name -> (capacity, weight): water-filling, one exhausted child after the other."""
    given, open_ = {}, dict(kids)
    while open_:
        level = budget / sum(w for _, w in open_.values())
        full = {k: c for k, (c, w) in open_.items() if c <= w * level}
        if not full:
            return given | {k: int(w * level) for k, (_, w) in open_.items()}
        k = min(full, key=lambda k: (open_[k][0] / open_[k][1], k))
        given[k] = full[k]
        budget -= full[k]
        del open_[k]
    return given


def brute(rows, fraction=0.75, epochs=2, seed=17):
    def domain(s):
        if s is None:
            return "unknown"
        m = re.search(r"(\d+)$", s)
        n = int(m[1]) if m else 99
        return "web" if n < 5 else "news" if n < 10 else "books" if n < 15 else "reference"

    units = [(d, (domain(s), lang or "unknown", s or "unknown"), n) for d, t, lang, s in rows if d is not None and (n := len(re.findall(r"[^ \t\n\r\f]+", t or "")))]
    tok = {}
    for _, leaf, n in units:
        tok[leaf] = tok.get(leaf, 0) + n
    cap = lambda pre: epochs * sum(n for k, n in tok.items() if k[: len(pre)] == pre)

    def down(pre, budget, level):
        if level == 3:
            return {pre: budget}
        kids = {k[: level + 1] for k in tok if k[:level] == pre}
        got = share(budget, {k: (cap(k), WEIGHTS[level].get(k[-1], 1)) for k in kids})
        out = {}
        for k, b in got.items():
            out |= down(k, b, level + 1)
        return out

    out = []
    for leaf, b in down((), int(sum(tok.values()) * fraction), 0).items():
        full, rest = divmod(b, tok[leaf])
        own = [(d, n) for d, k, n in units if k == leaf]
        out += [(d, *leaf, e, n, n) for e in range(full) for d, n in own]
        key = lambda x: (hashlib.md5(f"{seed}:{full}:{x[0]}".encode()).hexdigest(), x[0], x[1])
        for d, n in sorted(own, key=key):
            if rest <= 0:
                break
            out.append((d, *leaf, full, n, min(n, rest)))
            rest -= n
    return sorted(out)


def test_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source")
    rows = [tuple(r) for r in docs.collect()]
    got = sorted(tuple(r) for r in mixture(docs).collect())
    want = brute(rows)
    # leaf budgets may be off by one token where a level isn't a whole number
    assert [x[:6] for x in got] == [x[:6] for x in want] and all(abs(a[6] - b[6]) <= 1 for a, b in zip(got, want))


def test_against_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    df = op1_mixture(spark, sf)
    con_rows = con.execute(ORACLE)
    names = [c[0] for c in con_rows.description]
    assert sorted(tuple(r) for r in df.select(*names).collect()) == sorted(con_rows.fetchall())


def test_shortage_goes_to_siblings_first(spark):
    word = lambda n: " ".join(["w"] * n)
    rows = [(i, word(10), "en", "src1") for i in range(2)] + [(10 + i, word(10), "de", "src1") for i in range(100)] + [(200 + i, word(10), "en", "src5") for i in range(100)]
    got = mixture(spark.createDataFrame(rows, DDL), fraction=0.5, max_epochs=1).groupBy("domain", "lang").sum("take_tokens").collect()
    by = {(r[0], r[1]): r[2] for r in got}
    # web's 4 of 6 parts of 1010 tokens: English can give only 20, so German gives the rest of web's budget, not news
    assert by["web", "en"] == 20 and abs(by["web", "de"] - (1010 * 4 // 6 - 20)) <= 1 and abs(by["news", "en"] - 1010 * 2 // 6) <= 1


def test_defined_results(spark):
    rows = [(None, "a b", "en", "src1", 1), (1, None, "en", "src1", 2), (2, "", None, None, 3), (3, "a b c", None, None, None), (4, "a b c d", "en", "src1", 5), (4, "a b c d", "en", "src1", 5), (5, "x " * 300_000, "xx", "nonumber", 6)]
    df = spark.createDataFrame(rows, DDL + ", epoch long").selectExpr("*", "epoch AS times", "epoch AS copy", "epoch AS chosen_id", "epoch AS domain", "epoch AS n_tokens", "epoch AS budget")
    got = mixture(df, fraction=1.0, max_epochs=1)
    assert sorted((r.doc_id, r.n_tokens) for r in got.collect()) == [(3, 3), (4, 4), (4, 4), (5, 300_000)]
    out = mixed(df, fraction=1.0, max_epochs=1)
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == [3, 4, 4, 5]
    assert mixture(df, fraction=2.0, max_epochs=2).count() == 8


def test_empty_table(spark):
    df = spark.createDataFrame([], DDL)
    assert mixture(df).count() == 0 and mixed(df).count() == 0
