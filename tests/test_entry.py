"""The driver contract: names, flagship query, and that llm is optional."""

import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def test_names_agree():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert {"p1_found", "p2_found", "p5_found", "p6_found"} <= set(queries)


def test_core_does_not_need_llm():
    code = (
        "import sys; sys.modules['terralace.llm'] = None\n"
        "import __spark_entry__ as e; assert 'p1_found' in e.queries() and 'p3_found' not in e.queries(); e.oracle_sql(); import bench"
    )
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert subprocess.run([sys.executable, "-c", code], cwd=root).returncode == 0


def test_a_broken_import_inside_llm_is_no_absence(tmp_path):
    (tmp_path / "queries.py").write_text("import no_such_library")
    code = (
        f"import sys, types; fake = types.ModuleType('terralace.llm'); fake.__path__ = [{str(tmp_path)!r}]; sys.modules['terralace.llm'] = fake\n"
        "try:\n    import __spark_entry__\nexcept ModuleNotFoundError as e:\n    sys.exit(0 if e.name == 'no_such_library' else 2)\nsys.exit(1)"
    )
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert subprocess.run([sys.executable, "-c", code], cwd=root).returncode == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"ref_field", "month_key", "defect", "n_refs"}
