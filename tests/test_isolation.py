"""Isolation: the document operators never need the pipeline package."""

from __future__ import annotations

import re
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_nothing_else_imports_the_pipeline_package():
    for path in (ROOT / "folioworks").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"folioworks\.llm|corpus_pipeline", path.read_text()), path


def test_entry_works_without_it(tmp_path):
    import shutil
    import subprocess
    import sys

    shutil.copytree(ROOT / "folioworks", tmp_path / "folioworks", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert q and o and set(o) <= set(q) and not [k for k in q if k.startswith('op')]"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
