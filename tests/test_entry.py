"""The driver's entry module, with and without the training-data subpackage."""

import re
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).parent.parent


@pytest.mark.parametrize("pipeline", [True, False])
def test_imports_without_the_subpackage(tmp_path, pipeline):
    shutil.copytree(ROOT / "tracewright", tmp_path / "tracewright", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py", "bench.py", *(["corpus_pipeline.py"] if pipeline else [])]:
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, any(n.startswith('op') and n[2].isdigit() for n in q), set(e.oracle_sql()) <= set(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    count, *rest = done.stdout.split()
    assert int(count) > 50 and rest == ["False", "False", "True"]


def test_other_modules_leave_the_subpackage_alone():
    files = [f for f in (ROOT / "tracewright").rglob("*.py") if "llm" not in f.parts]
    assert files and not [f for f in files if re.search(r"(import|from)\s+\S*\bllm\b", f.read_text())]
