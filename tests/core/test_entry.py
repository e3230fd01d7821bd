"""The entry points, and that they hold without the text operators."""

import re
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parents[2]
sys.path.insert(0, str(ROOT))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_without_text_operators(tmp_path):
    keep = shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache")
    shutil.copytree(ROOT, tmp_path / "repo", ignore=keep)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 50 and not [n for n in e.queries() if n.startswith('op')]"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True, timeout=120)


def test_nothing_imports_them():
    for f in (ROOT / "cellsift").rglob("*.py"):
        if "llm" not in f.parts:
            assert not re.search(r"import .*\bllm\b|from .*\bllm\b", f.read_text()), f
