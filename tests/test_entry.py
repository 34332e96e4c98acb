"""The entry point with the whole repository, and with the training-data subpackage left out."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).parent.parent


def test_without_the_subpackage(tmp_path):
    for name in ("__spark_entry__.py", "ledgerlark"):
        src = ROOT / name
        (shutil.copytree if src.is_dir() else shutil.copy)(src, tmp_path / name)
    shutil.rmtree(tmp_path / "ledgerlark" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'summary_by_bill' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) > 60


def test_nothing_else_imports_it():
    for path in (ROOT / "ledgerlark").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in "".join(line for line in path.read_text().splitlines(True) if "import" in line), path


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
