"""Every registered query against its SQL twin on the small tables."""

import pytest

from quarry.plans import registry
from tests import oracle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connection(SF)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_sql(spark, con, name):
    assert oracle.difference(registry.queries()[name](spark, SF), con, registry.oracle_sql()[name]) == ""
