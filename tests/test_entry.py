"""The entry points without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(entry.__file__).resolve().parent


def test_rest_imports_without_the_operator_folders(tmp_path):
    left_out = {ROOT / "pagelens" / "llm", ROOT / "tests" / "llm"}
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=lambda folder, names: [n for n in names if Path(folder) / n in left_out or n in (".git", "__pycache__", "corpus_pipeline.py")])
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(q.startswith('op') or q == 'pipeline' for q in e.queries()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, env={"PYTHONPATH": str(copy), "PATH": "/usr/bin:/bin"}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr
    core = [q for q in entry.queries() if not q.startswith("op") and q != "pipeline"]
    assert done.stdout.split() == [str(len(core)), str(len([q for q in entry.oracle_sql() if q in core])), "False"]
