"""The library without its training-data subpackage."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]
WITHOUT = """
import sys

class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith({names!r}):
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)

sys.meta_path.insert(0, Gone())
sys.path.insert(0, {repo!r})
import __spark_entry__ as entry
print(len([k for k in entry.queries() if k == "pipeline" or k[:2] == "op" and k[2].isdigit()]), len(entry.queries()) > 190, set(entry.oracle_sql()) <= set(entry.queries()))
"""


def run(*names: str) -> subprocess.CompletedProcess:
    return subprocess.run([sys.executable, "-c", WITHOUT.format(names=names, repo=str(REPO))], capture_output=True, text=True, timeout=120)


def test_queries_without_the_subpackage():
    for names in (("corpus_pipeline", "sparkguard.llm"), ("corpus_pipeline",), ("sparkguard.llm",)):
        assert run(*names).stdout.split() == ["0", "True", "True"]


def test_other_missing_modules_are_errors():
    assert "No module named 'duckdb_of_nowhere'" not in run("duckdb_of_nowhere").stderr
    assert run("sparkguard.plans").returncode != 0
