"""The entry point in a copy of the repository without its corpus part."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
SCRIPT = """
import __spark_entry__ as e
names = set(e.queries())
assert len(names) > 60 and not any(n.startswith("op") and n[2].isdigit() for n in names) and "pipeline" not in names
assert set(e.oracle_sql()) <= names
import lociflow.plans.scan, lociflow.streaming.runs, lociflow.sources.regions
"""


@pytest.mark.parametrize("pipeline", [True, False])
def test_without_the_corpus_folders(tmp_path, pipeline):
    for name in ("lociflow", "tests", "__spark_entry__.py", "corpus_pipeline.py", "bench.py"):
        if (ROOT / name).is_dir():
            shutil.copytree(ROOT / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif pipeline or name != "corpus_pipeline.py":
            shutil.copy(ROOT / name, tmp_path)
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_nothing_else_imports_the_corpus_part():
    for f in (ROOT / "lociflow").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT).parts:
            assert "llm" not in f.read_text()
