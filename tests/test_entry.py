import os
import shutil
import subprocess
import sys

import __spark_entry__

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_every_sql_belongs_to_a_query():
    found = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(found)


def test_the_rest_works_without_the_subpackage(tmp_path):
    ignored = shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__", ".pytest_cache", "spark-warehouse")
    shutil.copytree(ROOT, tmp_path / "repo", ignore=ignored)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'similar_pairs' in q and not [n for n in q if n.startswith('op') or n == 'pipeline']; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
