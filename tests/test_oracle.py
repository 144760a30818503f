"""Every registered query against its SQL at the smallest scale."""

import pytest

from conftest import SF_DIR


def _names():
    from tidemark.plans import load_registry
    return sorted(load_registry())


@pytest.mark.parametrize("name", _names())
def test_query_matches_sql(spark, name):
    from check import compare
    ok, message = compare(spark, name, SF_DIR)
    assert ok, message
