"""The rest of the repository without the training-data operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAYS = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q), 'pipeline' in q)"


def counts(folder):
    out = subprocess.run([sys.executable, "-c", SAYS], cwd=folder, capture_output=True, text=True, check=True)
    n, pipeline = out.stdout.split()
    return int(n), pipeline == "True"


def test_imports_without_the_two_folders(tmp_path):
    """Both folders gone, with and without the pipeline file; and a package that cannot be imported."""
    skip = shutil.ignore_patterns("llm", ".git", "__pycache__")
    for name in ("sylvan", "workload"):
        shutil.copytree(f"{ROOT}/{name}", tmp_path / name, ignore=skip)
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(f"{ROOT}/{name}"):
            shutil.copy(f"{ROOT}/{name}", tmp_path)
    n, pipeline = counts(tmp_path)
    assert n > 50 and not pipeline
    (tmp_path / "sylvan" / "llm").mkdir()
    (tmp_path / "sylvan" / "llm" / "__init__.py").write_text("import no_such_module_anywhere\n")
    assert counts(tmp_path) == (n, False)
