"""The driver contract where the text operators are gone, in part or as a whole."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
COUNT = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), e.WITH_TEXT)"


@pytest.mark.parametrize("left", ["nothing", "an empty folder", "a cache"])
def test_entry_without_the_text_operators(tmp_path, left):
    shutil.copytree(ROOT / "tallymill", tmp_path / "tallymill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    if left != "nothing":
        folder = tmp_path / "tallymill/llm"
        (folder / "__pycache__" if left == "a cache" else folder).mkdir(parents=True)
    told = subprocess.run([sys.executable, "-c", COUNT], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    queries, texts, with_text = told.stdout.split()
    assert queries == texts and int(queries) > 80 and with_text == "False", told.stderr
