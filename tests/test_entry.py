import importlib
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names)


def test_imports_without_the_subpackage(tmp_path):
    """The rest stands alone: copied without foliant/llm and the pipeline it still offers its queries."""
    import shutil

    shutil.copytree(ROOT / "foliant", tmp_path / "foliant", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert not any(k.startswith('op') for k in e.queries()) and 'q01_coverage' in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, check=True)


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "foliant").rglob("*.py"):
        if "llm" not in path.parts:
            assert "foliant.llm" not in path.read_text()
    importlib.invalidate_caches()
