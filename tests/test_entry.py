import ast
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__

TOP = Path(__file__).resolve().parent.parent


@pytest.mark.skipif(not Path(__spark_entry__.SMOKE_DIR).is_dir(), reason="no tables")
def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["doc_id", "score", "source", "text_sha256", "lang"] and 0 < df.count() <= 30


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_rest_stands_without_the_llm_folders(tmp_path):
    shutil.copytree(TOP / "quillspan", tmp_path / "quillspan", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(TOP / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_nothing_else_imports_llm():
    for path in (TOP / "quillspan").rglob("*.py"):
        if "llm" in path.parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), path
