import subprocess
import sys
from pathlib import Path

import __spark_entry__


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_a_missing_package_leaves_the_core():
    """The subpackage needs packages that the core doesn't: without one of them the core's queries are still there."""
    code = "import sys; sys.modules['ahocorasick'] = None; import __spark_entry__ as e; q = e.queries(); assert 'pii_map' in q and len(q) > 90 and set(e.oracle_sql()) , q"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__spark_entry__.__file__).parent)


def test_contract(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["extract_id", "rel_path", "kinds"] and df.count() > 0
