import importlib
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


def test_queries_and_sql_agree():
    entry = importlib.import_module("__spark_entry__")
    names, sql = set(entry.queries()), set(entry.oracle_sql())
    assert sql <= names and {"p1_found", "p3_found", "chunk_documents", "search_every_query"} <= names
    assert not any("TABLESAMPLE" in s.upper() for s in entry.oracle_sql().values())


def test_core_does_not_need_the_subpackage():
    code = "import sys; sys.modules['millrace.llm'] = None\nimport importlib.util as u\nf = u.find_spec\nu.find_spec = lambda n, *a: None if n == 'millrace.llm' else f(n, *a)\nimport __spark_entry__ as e\nprint(sorted(e.queries())[:1], 'p2_found' in e.queries())"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert out.stdout.strip().endswith("False"), out.stderr
    for file in (ROOT / "millrace").rglob("*.py"):
        if "llm" not in file.relative_to(ROOT).parts:
            assert "millrace.llm" not in file.read_text()


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="needs the driver's tables")
def test_flagship(spark):
    out = importlib.import_module("__spark_entry__").entry(spark)
    assert out.columns[:3] == ["chunk_id", "partition_key", "chunk_seq"] and out.count() > 0
