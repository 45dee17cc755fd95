"""Every registered query that has SQL gives DuckDB's rows."""

import pytest

from tidemark import catalog
from tests.oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_gives_the_rows_of_its_sql(spark, name):
    compare(spark, SF, catalog.queries()[name], catalog.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def imported(missing: str, then: str):
    """Runs `then` in a process that lacks the modules of which the expression `missing` is true."""
    import subprocess
    import sys

    code = f"""
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if {missing}:
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
{then}
"""
    return subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=__file__.rsplit("/", 2)[0])


def test_entry_point_stands_without_the_training_data_operators():
    run = imported('name == "corpus_pipeline" or name == "tidemark.llm"', """
import __spark_entry__ as e
assert e.queries() and not [n for n in e.queries() if n.startswith("op") or n == "pipeline"], list(e.queries())
assert set(e.oracle_sql()) <= set(e.queries())
""")  # fmt: skip
    assert run.returncode == 0, run.stderr


def test_entry_point_says_what_else_is_missing():
    for gone in ("tidemark.catalog", *(("tidemark.llm.base", "xxhash") if _has_llm() else ())):
        run = imported(f"name == {gone!r}", "import __spark_entry__")
        assert run.returncode and gone.rpartition(".")[2] in run.stderr.splitlines()[-1], (gone, run.stderr)


def _has_llm() -> bool:
    import importlib.util

    return importlib.util.find_spec("tidemark.llm") is not None
