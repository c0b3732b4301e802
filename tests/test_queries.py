import subprocess
import sys

import pytest
from oracle import SF, same

import corvata.plans.queries_core  # noqa: F401
import corvata.plans.queries_crossview  # noqa: F401
import corvata.plans.queries_merging  # noqa: F401
import corvata.plans.queries_more  # noqa: F401
import corvata.plans.queries_rules  # noqa: F401
from corvata.plans.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    same(spark, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_whole(spark, name):
    first = QUERIES[name](spark, SF)
    rows = first.collect()
    assert (rows or name == "derived_tables") and sorted(map(str, rows)) == sorted(map(str, QUERIES[name](spark, SF).collect()))


def test_entry_without_the_llm_folders(tmp_path):
    """The entry imports and lists the other queries where the corpus folders are gone."""
    code = f"""
import sys, shutil, os
src, dst = '/root/repo', {str(tmp_path)!r}
import pathlib
src = pathlib.Path({str(__file__)!r}).resolve().parent.parent
shutil.copytree(src / 'corvata', dst + '/corvata', ignore=shutil.ignore_patterns('llm', '__pycache__'))
shutil.copy(src / '__spark_entry__.py', dst)
sys.path.insert(0, dst)
os.chdir(dst)
import __spark_entry__ as e
assert 'ledger_reconciliation' in e.queries() and not any(q.startswith('op') for q in e.queries())
assert set(e.oracle_sql()) <= set(e.queries())
"""
    env = {"PATH": "/usr/bin:/bin", "PYTHONDONTWRITEBYTECODE": "1", "HOME": str(tmp_path)}
    subprocess.run([sys.executable, "-c", code], check=True, env=env)
