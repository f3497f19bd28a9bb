import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_is_imported_without_a_session():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert q and set(o) <= set(q), set(o) - set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, env=os.environ | {"PYTHONPATH": ROOT}, check=True, timeout=120)


def test_flagship_query(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["doc_id", "page", "start", "length", "snippet", "snippet_start"]
