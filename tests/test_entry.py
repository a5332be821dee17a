"""The registered queries: names, SQL for known names, and that the core stands without the llm subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_every_sql_belongs_to_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 120


def test_core_stands_alone(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", ".hypothesis", ".pytest_cache"))
    code = "import __spark_entry__ as e; q = e.queries(); assert e.llm is None and 'p2_found' in q and 'p1_found' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True)
