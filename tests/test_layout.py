"""The package without its training-data subpackage, and the driver's contract."""

import ast
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_nothing_else_imports_the_subpackage():
    for p in (ROOT / "loomgraph").rglob("*.py"):
        if "llm" in p.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(p.read_text())):
            names = [node.module or ""] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []
            assert not any("llm" in n.split(".") for n in names), p


def test_entry_without_the_subpackage():
    code = "import sys; sys.modules['loomgraph.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p3_found' in q and 'p7_ids' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_sql_belongs_to_queries():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 80


def test_no_forbidden_means():
    for p in (ROOT / "loomgraph").rglob("*.py"):
        text = p.read_text()
        for word in ("localCheckpoint(", ".crossJoin(", ".rdd", "toPandas("):
            assert word not in text, (p, word)
