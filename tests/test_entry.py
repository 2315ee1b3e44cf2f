"""The entry works without the corpus subpackage and its pipeline."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_without_the_corpus_parts(tmp_path):
    copy = tmp_path / "copy"
    copy.mkdir()
    shutil.copytree(ROOT / "punctaria", copy / "punctaria", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copytree(ROOT / "jobs", copy / "jobs", ignore=shutil.ignore_patterns("__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", copy)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'dbscan_labels' in q and 'job2_text_intake' in q and not any(k.startswith('op') and k[2:3].isdigit() or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(copy), "HOME": str(tmp_path)})


def test_nothing_else_imports_the_corpus_parts():
    for f in [*(ROOT / "punctaria").rglob("*.py"), *(ROOT / "jobs").rglob("*.py")]:
        if "llm" not in f.parts:
            assert "llm" not in f.read_text(), f
