"""From a small work tree to documents, and scope graphs."""

import json
import subprocess

from lodestrata.engine import Engine
from lodestrata.operators import scope


def test_update_query_render(spark, tmp_path):
    repo = tmp_path / "repo"
    git = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    (repo / "src").mkdir(parents=True)
    (repo / "src/util.py").write_text("def far():\n    pass\n")
    (repo / "src/main.py").write_text("import util\n\ndef main():\n    far()\n    near()\n\ndef near():\n    pass\n")
    (repo / "README.md").write_text("# R\n\nSee `src/main.py`.\n")
    git("init", "-q"), git("add", "."), git("commit", "-qm", "one")
    (repo / "src/main.py").write_text("import util\n\ndef main():\n    far()\n    near()\n\ndef near():\n    return 1\n")
    git("commit", "-qam", "two")
    git("tag", "v1")
    (repo / "src/util_test.py").write_text("def check():\n    pass\n")
    (repo / "Makefile").write_text("all:\n\techo\n")
    git("add", "."), git("commit", "-qm", "three")
    e = Engine(spark, str(repo), f"file:{tmp_path}/store")
    assert e.update() == ["git", "tree"] and e.update() == []
    counts = {(r.what, r.kind): r.n for r in e.status().collect()}
    assert counts["node", "Commit"] == 3 and counts["node", "File"] == 5 and counts["node", "Function"] == 4 and counts["edge", "Calls"] == 2 and counts["edge", "Imports"] == 1 and counts["edge", "Documents"] == 1
    # a release holds the commits up to it, and has its snapshot
    assert counts["node", "Release"] == 1 and counts["edge", "Includes"] == 2 and [r.label for r in e.store.snapshots().collect()] == ["v1"]
    # nothing that is read has changed but what an analyser itself gave
    assert [a.name for a in e.analyzers if a.needs_rerun(e)] == []
    assert e.query("src/main.py").first().kind == "File" and e.query("near").first().kind == "Function"
    assert e.top("ChangeFrequency", "total").first().name == "src/main.py"
    sal = {r.name: r for r in e.named("CompositeSalience", "name", code_size="double", test_presence="double", pagerank="double").collect()}
    assert sal["src/util.py"].test_presence == 1.0 and sal["src/main.py"].test_presence == 0.0 and sal["src/main.py::main"].code_size == 1.0 and sal["src/main.py::near"].pagerank > 0
    assert {r.file for r in e.risks().collect()} == {"README.md", "Makefile", "src/main.py", "src/util.py", "src/util_test.py"} and e.risk_check().count() == 0 and e.risk_check(0.3).count() > 0
    assert e.tool_query("MAIN", "file").first().total == 1 and e.tool_risk("src/main.py").first().risk_level == "medium" and e.tool_graph("salience", 2).count() == 2
    assert e.tool_conventions().count() == 4 and '"dominant":"lowercase"' in e.tool_conventions("naming").first().data and e.tool_co_changes("src/main.py").count() == 0
    counted, impact = e.diff("v1", "HEAD")
    assert counted.first().added == 2 and {r.file for r in impact.collect()} == {"Makefile", "src/util_test.py"}
    done = e.render(str(tmp_path / "out"), leave=["skills"])
    assert {"AGENTS.md", "report.html", "risk-map.json", "spec.tps.md", "src/.context.md"} <= set(done) and e.render(str(tmp_path / "out"), only=["agents_md"]) == []
    text = (tmp_path / "out/AGENTS.md").read_text()
    assert "src/main.py" in text and "make all" in text and "## Modules" in text and "## Danger zones" not in text
    risks = json.loads((tmp_path / "out/risk-map.json").read_text())
    assert len(risks["risk_areas"]) + len(risks["safe_areas"]) == 5


def test_scope_resolution(spark):
    nodes = [
        ("a.py", 1, "push", "helper"), ("a.py", 2, "scope", None), ("a.py", 3, "pop", "local"), ("a.py", 4, "push", "local"), ("a.py", 5, "import", None),
        ("b.py", 1, "export", "helper"), ("b.py", 2, "pop", "helper"), ("c.py", 1, "export", "other"), ("c.py", 2, "pop", "other"),
    ]
    edges = [("a.py", 1, 2), ("a.py", 4, 2), ("a.py", 2, 3), ("a.py", 2, 5), ("b.py", 1, 2), ("c.py", 1, 2)]
    n = spark.createDataFrame(nodes, "path string, id long, kind string, symbol string")
    e = spark.createDataFrame(edges, "path string, source long, target long")
    got = {(r.ref_path, r.ref, r.def_path, r["def"]) for r in scope.resolve(n, e).collect()}
    assert got == {("a.py", 1, "b.py", 2), ("a.py", 4, "a.py", 3)}
    gone = scope.remove_file(n, e, spark.createDataFrame([("b.py",)], "path string"))
    assert {(r.ref, r.def_path) for r in scope.resolve(*gone).collect()} == {(4, "a.py")}
    back = scope.add_file(*gone, n.filter("path = 'b.py'"), e.filter("path = 'b.py'"))
    assert scope.resolve(*back).count() == 2


def test_scopes_that_lead_in_circles_or_far(spark):
    """A chain of ten files, two files that import from each other, and references that lead back to themselves."""
    nodes = [("f0", 1, "push", "x"), ("f0", 2, "import", None), ("loop", 1, "push", "a"), ("loop", 2, "push", "b"), ("loop", 3, "scope", None)]
    edges = [("f0", 1, 2), ("loop", 1, 2), ("loop", 2, 3), ("loop", 3, 1)]
    for i in range(1, 10):
        nodes += [(f"f{i}", 1, "export", "x"), (f"f{i}", 2, "import" if i < 9 else "pop", None if i < 9 else "x")]
        edges.append((f"f{i}", 1, 2))
    got = scope.resolve(spark.createDataFrame(nodes, "path string, id long, kind string, symbol string"), spark.createDataFrame(edges, "path string, source long, target long")).collect()
    assert [(r.ref_path, r.ref, r.def_path) for r in got] == [("f0", 1, "f9")]
