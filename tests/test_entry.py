"""The entry module with and without the training-data subpackage."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SHOW = "import __spark_entry__ as e; print(len(e.queries()), set(e.oracle_sql()) <= set(e.queries()))"


def shown(folder):
    env = os.environ | {"PYTHONPATH": str(folder)}
    out = subprocess.run([sys.executable, "-B", "-c", SHOW], cwd=folder, env=env, capture_output=True, text=True, check=True)
    return out.stdout.split()


def test_entry_without_the_subpackage(tmp_path):
    shutil.copytree(f"{ROOT}/earshot", tmp_path / "earshot", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    n, whole = shown(tmp_path)
    assert int(n) > 70 and whole == "True"
    assert int(shown(ROOT)[0]) >= int(n)


def test_entry_without_a_library(tmp_path):
    """A machine that lacks a library of the subpackage keeps all other queries."""
    shutil.copytree(f"{ROOT}/earshot", tmp_path / "earshot", ignore=shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(f"{ROOT}/{name}"):
            shutil.copy(f"{ROOT}/{name}", tmp_path)
    for name in ("tokenizers", "public_tokenizers"):
        (tmp_path / f"{name}.py").write_text(f"raise ModuleNotFoundError('hidden', name='{name}')\n")
    n, whole = shown(tmp_path)
    assert int(n) > 70 and whole == "True"
