"""The driver's three functions, with and without the corpus operators."""

import os
import shutil
import subprocess
import sys

from .conftest import ROOT

import __spark_entry__ as entry


def test_shapes(spark):
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(o) > 80
    assert entry.entry(spark).columns == ["file", "total", "last_30d", "last_90d", "last_365d", "percentile"]


def test_without_the_optional_part(tmp_path):
    shutil.copytree(f"{ROOT}/lodestrata", tmp_path / "lodestrata", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and 'pipeline' not in q and not any(n.startswith('op') and n[2:3].isdigit() for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_nothing_else_imports_it():
    for folder, _, names in os.walk(f"{ROOT}/lodestrata"):
        if os.path.basename(folder) != "llm":
            for n in names:
                if n.endswith(".py"):
                    with open(os.path.join(folder, n)) as f:
                        assert "lodestrata.llm" not in f.read(), n
