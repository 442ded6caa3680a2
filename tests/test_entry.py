"""The entry file works with and without the training-data operators."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SHOWS = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(k.startswith('op1') for k in e.queries()))"


def shown(folder: str) -> list[str]:
    own = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}  # else what was left out is found elsewhere
    done = subprocess.run([sys.executable, "-B", "-c", SHOWS], cwd=folder, env=own, capture_output=True, text=True, check=False)
    assert done.returncode == 0, done.stderr
    return done.stdout.split()


@pytest.mark.parametrize("gone", [("qanat/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",), ("qanat/llm",)])
def test_entry_without_the_operators(tmp_path, gone):
    copy = tmp_path / "copy"
    left_out = shutil.ignore_patterns("__pycache__", *(os.path.basename(g) for g in gone))
    os.mkdir(copy)
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if name not in gone:
            shutil.copy(os.path.join(ROOT, name), copy / name)
    shutil.copytree(os.path.join(ROOT, "qanat"), copy / "qanat", ignore=left_out)
    n_queries, n_sql, has_operators = shown(str(copy))
    assert has_operators == "False" and int(n_queries) > 130 and int(n_sql) > 120


def test_other_import_errors_are_not_hidden(tmp_path):
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path / "__spark_entry__.py")
    shutil.copytree(os.path.join(ROOT, "qanat"), tmp_path / "qanat", ignore=shutil.ignore_patterns("__pycache__"))
    (tmp_path / "corpus_pipeline.py").write_text("import a_module_that_is_missing\n")
    done = subprocess.run([sys.executable, "-B", "-c", SHOWS], cwd=tmp_path, capture_output=True, text=True, check=False)
    assert done.returncode != 0 and "a_module_that_is_missing" in done.stderr
