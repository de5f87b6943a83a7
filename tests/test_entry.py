"""The contract's entry points, with and without the optional subpackage."""

import re
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(callable(q) for q in entry.queries().values())


def test_entry(spark):
    got = entry.entry(spark)
    assert got.columns == ["key", "name", "tracks", "albums", "sources"] and got.count() > 0


def test_rest_works_without_llm(tmp_path):
    code = "import sys; sys.modules['cadenza.llm'] = None; import __spark_entry__ as e; assert 'artist_reduce' in e.queries() and not any(q.startswith('op') for q in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_nothing_else_imports_llm():
    for path in (ROOT / "cadenza").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"\bllm\b", path.read_text()), path
