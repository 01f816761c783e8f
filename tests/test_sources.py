"""Sources, the store, writers and streams on small fixtures."""

import datetime
import json
import subprocess

import pandas as pd
from pyspark.sql import functions as F

from lodestrata.sinks import render
from lodestrata.sources import code, files, history
from lodestrata.sources.store import HypergraphStore
from lodestrata.streaming import changes

FILES = "path string, content string"
AT = datetime.datetime(2024, 1, 1)


def test_tree_and_ingest(spark, tmp_path):
    for p, t in {"src/a.py": "x = 1\ny = 2", "src/deep/b.rs": "fn b() {}\n", ".git/HEAD": "no", "README.md": "# Title\n\n## One\n\nSee [a](src/a.py).\n"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    t = files.tree(spark, str(tmp_path))
    got = {r.path: r for r in files.ingest(t).collect()}
    assert set(got) == {"src/a.py", "src/deep/b.rs", "README.md"}
    assert got["src/a.py"].lines == 2 and got["src/deep/b.rs"].modules == ["src", "src/deep"] and got["src/deep/b.rs"].language == "rust"
    d = files.documents(t).first()
    assert (d.title, d.sections, d.doc_type) == ("Title", ["One"], "Readme")
    r = files.references(t.filter("path = 'README.md'")).collect()
    assert [(x.target, x.confidence) for x in r] == [("src/a.py", 0.95)]


def test_manifests_and_commands(spark):
    rows = [
        ("Cargo.toml", '[dependencies]\nserde = "1"\ntokio = { version = "2", features = [] }\n[dev-dependencies]\nt = "0.1"\n[workspace.dependencies]\nw = "3"'),
        ("web/package.json", '{"dependencies": {"react": "^18"}, "devDependencies": {"jest": "1"}, "scripts": {"build": "x"}}'),
        ("pyproject.toml", '[project]\ndependencies = ["numpy>=1.2; python_version > \'3\'", "requests[socks]"]'),
        ("go.mod", "module m\nrequire a.b/c v1.0.0\nrequire (\n\td.e/f v2.1.0\n\tg.h/i v0.1.0 // indirect\n)\n"),
        ("bad/package.json", "{"),
        ("Makefile", "build: x\n\tcc\n.PHONY: build\nVAR := 1\n"),
        (".github/workflows/ci.yml", "steps:\n  - run: cargo test\n  - run: |\n"),
    ]
    f = spark.createDataFrame(rows, FILES)
    got = {(r.path, r.name, r.version, r.kind) for r in files.dependencies(f).collect() if r.kind != "error"}
    assert got == {
        ("Cargo.toml", "serde", "1", "normal"), ("Cargo.toml", "tokio", "2", "normal"), ("Cargo.toml", "t", "0.1", "dev"), ("Cargo.toml", "w", "3", "workspace"), ("web/package.json", "react", "^18", "normal"), ("web/package.json", "jest", "1", "dev"),
        ("pyproject.toml", "numpy", ">=1.2", "normal"), ("pyproject.toml", "requests", "*", "normal"), ("go.mod", "a.b/c", "v1.0.0", "normal"), ("go.mod", "d.e/f", "v2.1.0", "normal"), ("go.mod", "g.h/i", "v0.1.0", "normal"),
    }
    assert files.dependencies(f).filter("kind = 'error'").count() == 1
    assert {r.command for r in files.ci_commands(f).collect()} == {"cargo test", "make build", "npm run build"}


def test_sessions_and_rules(spark):
    tool = lambda n, p: {"type": "tool_use", "name": n, "input": {"file_path": p}}
    rows = [
        ("s", 0, json.dumps({"role": "user", "content": "please fix", "timestamp": "2024-01-01T00:00:00Z"})),
        ("s", 1, json.dumps({"role": "assistant", "content": [{"type": "text", "text": "ok"}, tool("Read", "/r/src/a.py"), tool("Edit", "./b.py")]})),
        ("s", 2, "not json"),
    ]
    got = {r.pos: r for r in files.session_turns(spark.createDataFrame(rows, "session string, pos int, value string")).collect()}
    assert set(got) == {0, 1} and got[1].referenced == ["src/a.py", "b.py"] and got[1].modified == ["b.py"] and got[1].tool_uses == 2 and got[1].text == "ok" and got[0].text == "please fix"
    r = files.agent_rules(spark.createDataFrame([("x/AGENTS.md", "use `src/z.py` and `./a.rs`, `a.rs`"), ("y.md", "`q.py`")], FILES)).collect()
    assert [(x.source, x.referenced_files) for x in r] == [("agents", ["a.rs", "src/z.py"])]


SOURCES = {
    "a.rs": "/// Adds.\npub fn add(a: i32) -> i32 { helper(a) }\nstruct P;\nuse crate::util::helper;\n",
    "a.py": "import os\nclass A:\n    def m(self):\n        return self.n() + len([])\n\ndef f():\n    '''Doc f.'''\n    return g()\n",
    "a.ts": "import { x } from './util';\nexport class C { }\nfunction go() { return run(1); }\ninterface I { a: string }\n",
    "a.js": "const y = require('fs');\nconst h = (a) => { return call(a); };\n",
    "a.go": 'package m\nimport "fmt"\n// Run runs.\nfunc Run() {\n\tfmt.Println("x(")\n\tdo_it()\n}\ntype T struct {\n}\n',
    "A.java": "import java.util.List;\npublic class A {\n  public int run(int x) {\n    return go(x);\n  }\n}\n",
    "a.kt": "import a.b.C\nclass K {\n  fun f() {\n    g()\n  }\n}\n",
    "a.rb": "require 'set'\nmodule M\n  class R\n    def go?\n      run(1)\n    end\n  end\nend\n",
    "a.swift": "import UIKit\nstruct S {\n  func f() {\n    g()\n  }\n}\n",
    "A.cs": "using System.Text;\nclass B {\n  public void Run(int x) {\n    Go(x);\n  }\n}\n",
    "a.php": "<?php\nuse A\\B;\nclass P {\n  function f() {\n    return g();\n  }\n}\n",
    "a.zig": 'const std = @import("std");\npub fn main() void {\n    run();\n}\n',
    "a.lean": "import Mathlib.Data\n/-- Doc. -/\ndef f (x : Nat) :=\n  g(x)\n\ntheorem t : True := trivial\n",
}


def test_every_language(spark):
    got = code.parse(spark.createDataFrame([*SOURCES.items(), ("x.txt", "fn no() {}"), ("n.rs", None)], FILES)).collect()
    by = {}
    for r in got:
        by.setdefault((r.path, r.what), set()).add(r.qualified or r.target)
    assert {p for p, _ in by} == set(SOURCES)
    assert all(by.get((p, w)) for p in SOURCES for w in ("def", "import", "call"))
    assert by["a.py", "def"] == {"A", "A.m", "f"} and by["a.go", "def"] == {"Run", "T"} and by["a.rb", "def"] == {"M", "M::R", "M::R::go?"} and by["A.java", "def"] == {"A", "A.run"}
    assert "x" not in by["a.go", "call"]
    docs = {r.qualified: r.doc for r in got if r.path in ("a.rs", "a.py", "a.go", "a.lean") and r.doc}
    assert docs == {"add": "Adds.", "f": docs["f"], "Run": "Run runs."} and docs["f"] in ("Doc f.", "Doc.")


def test_call_edges(spark):
    rows = [("src/main.py", "import util\ndef a():\n    b()\n    far()\n    twice()\n\ndef b():\n    pass\n"), ("src/util.py", "def far():\n    pass\n"), ("src/other.py", "def far():\n    pass\n")]
    got = {(r.caller, r.callee, r.confidence) for r in code.call_edges(code.parse(spark.createDataFrame(rows, FILES))).collect()}
    assert got == {("src/main.py::a", "src/main.py::b", 0.7), ("src/main.py::a", "src/util.py::far", 1.0)}


def test_history(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    git("init", "-q")
    (tmp_path / "a.txt").write_text("1\n2\n3\n4\n5\n")
    git("add", "."), git("commit", "-qm", "first"), git("tag", "v1")
    (tmp_path / "a.txt").write_text("1\n2\nx\n4\n5\n6\n")
    (tmp_path / "b.bin").write_bytes(b"\0\1")
    git("add", "."), git("commit", "-qm", "second")
    git("mv", "a.txt", "c.txt"), git("commit", "-qm", "third")
    got = [(r.subject, r.path, r.old_path, r.status, r.added, r.deleted) for r in history.history(spark, str(tmp_path), each=2).collect()]
    assert set(got) == {("first", "a.txt", None, "Added", 5, 0), ("second", "a.txt", None, "Modified", 2, 1), ("second", "b.bin", None, "Added", 0, 0), ("third", "c.txt", "a.txt", "Renamed", 0, 0)}
    names = history.commit_names(str(tmp_path))
    assert len(history.commit_names(str(tmp_path), names[1])) == 1 and len(history.commit_names(str(tmp_path), "0" * 40)) == 3
    t = history.tags(spark, str(tmp_path))
    assert [(r.tag, r.commit) for r in t.collect()] == [("v1", names[0])]
    c = spark.createDataFrame(list(zip(names, range(3))), "commit string, n long")
    assert [(r.release, r.commit) for r in history.release_commits(t, c).collect()] == [("v1", names[0])]
    assert [(r.status, r.path) for r in history.name_status(spark, str(tmp_path), names[1], names[2]).collect()] == [("Renamed", "c.txt")]
    assert history.hunks("@@ -1,5 +1,6 @@ x\n a\n@@ -9 +10 @@") == [(1, 5, 1, 6), (9, 1, 10, 1)]


def test_forges(spark):
    raw = spark.createDataFrame([(json.dumps({"number": 5, "title": "t", "state": "closed", "body": "Fixes #3, see #4", "merged_at": "2024-01-01T00:00:00Z", "user": {"login": "u"}}),), (json.dumps({"number": 2, "title": "old", "state": "open"}),)], "value string")
    p = history.pulls(raw, after=2)
    assert [(r.name, r.author, r.resolves) for r in p.collect()] == [("PR#5", "u", [3])]
    i = history.issues(spark.createDataFrame([(json.dumps({"number": n, "title": "i", "state": "open", "labels": [{"name": "bug"}]} | ({"pull_request": {"url": "x"}} if n == 9 else {})),) for n in (3, 4, 9)], "value string"))
    assert sorted(r.number for r in i.collect()) == [3, 4] and i.first().labels == ["bug"]
    assert sorted((r.pull, r.issue) for r in history.mentions(p, i).collect()) == [(5, 3), (5, 4)]
    m = history.pulls(spark.createDataFrame([(json.dumps({"iid": 7, "title": "t", "state": "merged", "description": "closes #1", "author": {"username": "g"}}),)], "value string"), forge="gitlab")
    assert [(r.name, r.author, r.resolves) for r in m.collect()] == [("MR!7", "g", [1])]


def test_store(spark, tmp_path):
    s = HypergraphStore(spark, f"file:{tmp_path}/store")
    n = lambda rows: spark.createDataFrame(rows, "kind string, name string, content_hash long, metadata string")
    assert s.read("nodes").count() == 0 and s.checkpoint("git") is None
    s.upsert_nodes(n([("File", "a", 1, "{}"), ("File", "b", 1, None)]))
    s.upsert_nodes(n([("File", "a", 2, '{"x": "1"}'), ("Function", "a", 3, None)]))
    got = {(r.kind, r.name): r.content_hash for r in s.read("nodes").collect()}
    assert got == {("File", "a"): 2, ("File", "b"): 1, ("Function", "a"): 3}
    ids = {r.name: r.id for r in s.read("nodes").filter("kind = 'File'").collect()}
    e = lambda c, *m: spark.createDataFrame([("Calls", [(ids[x], role, i) for i, (x, role) in enumerate(m)], c)], "kind string, members array<struct<node_id:long,role:string,position:int>>, confidence double")
    s.upsert_edges(e(0.5, ("a", "caller"), ("b", "callee")))
    s.upsert_edges(e(1.0, ("b", "callee"), ("a", "caller")))
    assert [r.confidence for r in s.read("hyperedges").collect()] == [1.0]
    s.views()
    assert [(r.caller, r.callee) for r in spark.table("call_graph").collect()] == [(ids["a"], ids["b"])]
    s.create_snapshot("one")
    s.upsert_nodes(n([("File", "c", 1, None)]))
    s.create_snapshot("two")
    assert [(r.what, r.change) for r in s.snapshot_diff("one", "two").collect()] == [("node", "added")]
    assert [(r.label, r.node_count) for r in s.snapshots().collect()] == [("one", 3), ("two", 4)]
    s.delete_snapshot("one")
    assert [r.label for r in s.snapshots().collect()] == ["two"]
    s.set_checkpoint("git", "x"), s.set_checkpoint("git", "y")
    assert s.checkpoint("git") == "y" and s.has_work("git", "z") and not s.has_work("git", "y")
    s.store_analyses(spark.createDataFrame([(1, "A", "{}"), (1, "B", "{}"), (2, "A", "{}")], "node_id long, kind string, data string"))
    s.clear_analyses(keep=["B"])
    assert [(r.node_id, r.kind) for r in s.read("analysis_results").collect()] == [(1, "B")]
    before = sorted(map(str, s.read("nodes").collect()))
    s.compact("nodes")
    assert sorted(map(str, s.read("nodes").collect())) == before and len(s._versions("nodes")) == 1
    s.upsert_nodes(n([("Release", "v1", None, None)] + [("Commit", f"c{i}", None, None) for i in range(7)]))
    assert s.due_snapshots(3) == ["v1", "auto-6"]


def test_writers(spark, tmp_path):
    old = "x\n<!-- keep:a -->mine<!-- /keep:a -->\n<!-- keep:b -->too<!-- /keep:b -->"
    new = render.merged("y\n<!-- keep:a -->yours<!-- /keep:a -->\n", old)
    assert "mine" in new and "yours" not in new and new.rstrip().endswith("<!-- keep:b -->too<!-- /keep:b -->")
    p = str(tmp_path / "d" / "A.md")
    df = spark.createDataFrame([("a|b", 0.5, 1), ("c", 0.25, 2)], "name string, score double, n long")
    text = render.sections("T", {"Top": df, "None": df.filter("n > 9"), "Words": "text"}, "abc")
    assert "a\\|b" in text and "## None" not in text and "## Words" in text
    assert render.write(p, text) and not render.write(p, render.sections("T", {"Top": df, "Words": "text"}, "def"))
    assert "<td>a|b</td>" in render.report("T", {"Top": df})
    assert json.loads(render.ranking(df, "json"))[0] == {"rank": 1, "name": "a|b", "score": 0.5} and "| 1 |" in render.ranking(df, "markdown") and "0.250000" in render.ranking(df)
    e = spark.createDataFrame([("a", "b", 1.0)], "src string, dst string, weight double")
    assert '"a" -> "b"' in render.graph(e) and "n0[" in render.graph(e, "mermaid")
    r = spark.createDataFrame([("f", "high", 0.9, ["x"], ["y"]), ("g", "none", 0.0, [], [])], "file string, level string, score double, reasons array<string>, recommendations array<string>")
    got = json.loads(render.risk_map_json(r, "abc"))
    assert got["risk_areas"][0]["file"] == "f" and got["safe_areas"] == 1
    m = render.module_contexts(spark.createDataFrame([("s/a.py", "f", 0.5), ("s/a.py", "g", 0.9), ("s/a.py", "z", 0.0)], "path string, name string, score double"), spark.createDataFrame([("s/a.py",), ("top.py",)], "path string"))
    got = {x.dir: x.text for x in m.collect()}
    assert got["s"].index("- g") < got["s"].index("- f") and "- z" not in got["s"] and "." in got
    k = render.skill_documents(spark.createDataFrame([(["a/x.py", "b/y.py"], 3, "task")], "files array<string>, frequency long, kind string"))
    assert list(k) == ["x-py-y-py"]


def stream(spark, tmp_path, name, rows, schema):
    """rows as one file a batch."""
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}-{i}")
        (tmp_path / name).mkdir(exist_ok=True)
        for f in (tmp_path / f"{name}-{i}").glob("*.parquet"):
            f.rename(tmp_path / name / f"{i:03d}.parquet")
    return changes.read(spark, f"file:{tmp_path}/{name}", spark.createDataFrame([], schema).schema, 1)


def run(df, tmp_path, name, mode):
    spark = df.sparkSession
    df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"file:{tmp_path}/cp-{name}").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).collect()


def test_streams(spark, tmp_path):
    t = lambda h: AT + datetime.timedelta(hours=h)
    s = stream(spark, tmp_path, "ch", [[("a", t(1)), ("a", t(2)), ("b", t(3))], [("a", t(30))], [("z", t(200))], [("z", t(201))], [("a", t(4))], [("z", t(202))]], "file string, ts timestamp")
    got = {(r.file, r.start): r.changes for r in run(changes.change_counts(s), tmp_path, "counts", "append")}
    assert got["a", t(0)] == 2 and got["b", t(0)] == 1 and got["a", t(24)] == 1  # what came too late isn't counted
    s = stream(spark, tmp_path, "se", [[("u", t(0)), ("u", t(5)), ("u", t(30))], [("v", t(300))], [("v", t(301))]], "author string, ts timestamp")
    got = sorted((r.author, r.n) for r in run(changes.contributor_sessions(s), tmp_path, "sess", "append"))
    assert got[:2] == [("u", 1), ("u", 2)]
    s = stream(spark, tmp_path, "ed", [[("k", t(0)), ("k", t(1))], [("k", t(2)), ("l", t(3))]], "identity_key string, ts timestamp")
    assert sorted(r.identity_key for r in run(changes.edges_once(s), tmp_path, "once", "append")) == ["k", "l"]


def test_score_history_in_state(spark, tmp_path):
    t = lambda h: AT + datetime.timedelta(hours=h)
    s = stream(spark, tmp_path, "sc", [[(1, t(0), 0.1), (2, t(0), 0.5)], [(1, t(1), 0.2), (None, t(1), 1.0)], [(1, t(k), 0.1 * k) for k in range(2, 14)]], "node long, at timestamp, score double")
    rows = run(changes.score_trends(s), tmp_path, "trend", "update")
    last = [r for r in rows if r.node == 1][-1]
    assert last.snapshots == 10 and last.trend == "Rising" and abs(last.slope - 0.1) < 1e-6 and abs(last.current_score - 1.3) < 1e-9
    assert [r.trend for r in rows if r.node == 2] == ["Stable"]


def test_stream_into_the_store(spark, tmp_path):
    s = stream(spark, tmp_path, "no", [[("File", "a", 1)], [("File", "a", 2), ("File", "b", 1)]], "kind string, name string, content_hash long")
    store = HypergraphStore(spark, f"file:{tmp_path}/st")
    changes.into_store(s, store, "nodes", f"file:{tmp_path}/cp").awaitTermination()
    assert {r.name: r.content_hash for r in store.read("nodes").collect()} == {"a": 2, "b": 1}


def test_log_parser():
    rows = history.parse_log("\x1esha\x1fn\x1fe\x1f0\x1fs\n\n:100644 100644 a b M\tp q.txt\n3\t1\tp q.txt\n\x1esha2\x1fn\x1fe\x1f0\x1fempty\n")
    assert rows[0][5:] == ("p q.txt", None, "Modified", 3, 1) and rows[1][5] is None and rows[0][3] == pd.Timestamp(0)
    assert history.new_path("a/{b => c}/d") == "a/c/d" and history.new_path("x => y") == "y" and history.new_path("a/{ => n}/d") == "a/n/d"
    assert F is not None
