"""The entry module without the corpus folders: it imports, and the core queries are all there."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
LIST = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"


@pytest.mark.parametrize("keep_pipeline", [True, False])
def test_without_corpus_folders(tmp_path, keep_pipeline):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", *[] if keep_pipeline else ["corpus_pipeline.py"]))
    assert (copy / "corpus_pipeline.py").exists() == keep_pipeline
    got = subprocess.run([sys.executable, "-c", LIST], cwd=copy, capture_output=True, text=True, check=True).stdout.splitlines()
    from lumengrade.plans import registry

    assert got == [" ".join(sorted(registry.queries())), " ".join(sorted(registry.oracle_sql()))]


def test_core_imports_no_corpus_module():
    code = "import sys, lumengrade.plans.registry; print([m for m in sys.modules if '.llm' in m])"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.strip() == "[]"
