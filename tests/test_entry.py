from __future__ import annotations

import re
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry
import pytest

ROOT = Path(entry.__file__).resolve().parent


def test_flagship_has_rows(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "flagged" in df.columns


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) >= 100


def test_nothing_else_imports_the_corpus_operators():
    for path in (ROOT / "tidewatch").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"\bllm\b", path.read_text()), path


@pytest.mark.parametrize("gone", [("llm",), ("llm", "corpus_pipeline.py")])
def test_the_rest_works_without_the_corpus_operators(tmp_path, gone):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__", *gone))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) >= 100 and set(e.oracle_sql()) <= set(q) and 'pipeline' not in q and not any(n.startswith('op1_') for n in q)"
    env = {"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path / "repo")}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True, env=env)
    subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "tests"], cwd=tmp_path / "repo", check=True, env=env, stdout=subprocess.DEVNULL)


def test_a_broken_corpus_module_is_not_swallowed(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__"))
    (tmp_path / "repo/tidewatch/llm/words.py").write_text("import no_such_module")
    run = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path / "repo", env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path / "repo")}, capture_output=True, text=True)
    assert run.returncode and "no_such_module" in run.stderr
