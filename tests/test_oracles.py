"""Every registered query of the library against its SQL, or held by a brute-force test of its name."""

import pytest
import test_brute_force
from conftest import SF, normal

from gridloom.plans import catalogue

QUERIES, ORACLES = catalogue.queries(), catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    if name not in ORACLES:
        assert hasattr(test_brute_force, f"test_{name}"), "neither SQL nor a brute-force test"
        return
    found = QUERIES[name](spark, SF)
    expected = duck.execute(ORACLES[name]).df()
    assert sorted(found.columns) == sorted(expected.columns)
    assert normal(found.toPandas()) == normal(expected)


def test_entry_imports():
    import __spark_entry__ as entry

    assert set(ORACLES) <= set(entry.oracle_sql()) and set(QUERIES) <= set(entry.queries())
