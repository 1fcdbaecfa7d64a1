"""Every registered query against its SQL (or for rows) on the smallest driver tables."""

import pytest
from check_catalog import compare

from metroframe.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    if name in ORACLES:
        assert compare(spark, SF, QUERIES[name], ORACLES[name]) is None
    else:
        df = QUERIES[name](spark, SF)
        assert df.columns
        df.collect()


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_runtime_settings_can_be_set_on_any_session(spark):
    """The queries also run in sessions built elsewhere, where static settings cannot change."""
    from metroframe.session import _RUNTIME, tune

    assert all(spark.conf.isModifiable(k) for k in _RUNTIME)
    assert tune(spark) is spark
