import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry

REPO = os.path.dirname(os.path.abspath(entry.__file__))


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() == 1500 and df.columns[0] == "o_orderkey"


def test_all_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_works_without_the_training_data_operators(tmp_path):
    """The folder of these operators can be deleted; stale bytecode may stay behind."""
    copy = tmp_path / "repo"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "tests"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    for stale in (False, True):
        if stale:
            (copy / "tidemark" / "llm" / "__pycache__").mkdir(parents=True)
        subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, timeout=100)
