"""Every registered query against its DuckDB oracle on the smallest tables, and the entry contract."""
import subprocess
import sys

import pytest

import __spark_entry__ as E
from checks.compare import compare
from checks.oracle import ORACLES
from sqlforge.plans.queries import Q

from conftest import ROOT, SF_SMALL

NAMES = sorted(ORACLES)


def test_every_query_has_an_oracle():
    assert set(Q) == set(ORACLES)
    assert set(Q) <= set(E.queries()) and set(ORACLES) <= set(E.oracle_sql())


def test_entry_without_the_llm_folder():
    """The llm subpackage is optional: without it the other queries stay."""
    code = ("import sys\n"
            "class No:\n"
            "    def find_spec(self, name, path=None, target=None):\n"
            "        if name.startswith('sqlforge.llm') or name == 'corpus_pipeline':\n"
            "            raise ModuleNotFoundError(f'No module named {name!r}', name=name)\n"
            "sys.meta_path.insert(0, No())\n"
            "import __spark_entry__ as E\n"
            "assert 'clause_split' in E.queries() and not any(q.startswith('op') and q[2].isdigit() for q in E.queries())\n")
    subprocess.run([sys.executable, "-c", code], check=True, cwd=ROOT)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck_small, name):
    r = compare(spark, SF_SMALL, name, E.queries()[name], E.oracle_sql()[name], duck_small)
    assert r["columns_match"] and r["values_match"], r


def test_entry(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and "ex_rate" in df.columns
