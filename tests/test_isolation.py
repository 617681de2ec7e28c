"""Without the corpus operators the rest still registers its queries."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).parent.parent
SAY = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert q and set(o) <= set(q); print(*[n for n in q if n == 'pipeline' or n.startswith('op')])"


@pytest.mark.parametrize("gone", [("citegrid/llm", "corpus_pipeline.py"), ("citegrid/llm",)])
def test_queries_without_the_corpus_operators(tmp_path, gone):
    shutil.copytree(ROOT / "citegrid", tmp_path / "citegrid", ignore=shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path)
    for name in gone:
        path = tmp_path / name
        if path.is_dir():
            shutil.rmtree(path)
        elif path.exists():
            path.unlink()
    said = subprocess.run([sys.executable, "-B", "-c", SAY], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    assert said.stdout.strip() == ""
