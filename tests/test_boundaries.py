"""What the library may import, and that it stands without the training-data subpackage."""

import ast
import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_nothing_else_imports_the_subpackage():
    for folder, _, files in os.walk(os.path.join(ROOT, "archloom")):
        for f in files:
            if f.endswith(".py") and os.sep + "llm" not in folder:
                for node in ast.walk(ast.parse(open(os.path.join(folder, f)).read())):
                    names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                    assert not any(n.startswith(("archloom.llm", "corpus_pipeline")) for n in names), f


@pytest.mark.parametrize("pipeline", [False, True])
def test_entry_stands_without_it(tmp_path, pipeline):
    """Without the subpackage, whether the pipeline's file is left or not."""
    for x in ("archloom", "__spark_entry__.py", *["corpus_pipeline.py"] * (pipeline and os.path.exists(os.path.join(ROOT, "corpus_pipeline.py")))):
        src = os.path.join(ROOT, x)
        (shutil.copytree if os.path.isdir(src) else shutil.copy)(src, tmp_path / x)
    shutil.rmtree(tmp_path / "archloom" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'entries_union' in q and not any(n.startswith('op') for n in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=True)
