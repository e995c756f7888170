"""The entry points stand without the folder of training-data operators, with the pipeline's file there or not."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("left", [True, False])
def test_entry_without_the_folder(tmp_path, left):
    shutil.copytree(ROOT / "spanscan", tmp_path / "spanscan", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", *["corpus_pipeline.py"] * left):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path)
    said = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; print(len(e.queries()), [k for k in e.queries() if k[:2] == 'op' or k == 'pipeline'], set(e.oracle_sql()) <= set(e.queries()))"], cwd=tmp_path, capture_output=True, text=True, check=True)
    n, rest = said.stdout.split(" ", 1)
    assert int(n) > 80 and rest.strip() == "[] True"


def test_errors_inside_a_module_are_not_hidden(tmp_path):
    shutil.copytree(ROOT / "spanscan", tmp_path / "spanscan", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    (tmp_path / "spanscan/llm").mkdir()
    (tmp_path / "spanscan/llm/__init__.py").touch()
    (tmp_path / "spanscan/llm/queries.py").write_text("import nowhere_at_all")
    said = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__"], cwd=tmp_path, capture_output=True, text=True)
    assert said.returncode and "nowhere_at_all" in said.stderr
