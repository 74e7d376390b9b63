import pytest

import oracle
from isohyet.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_value(spark, name):
    oracle.compare(spark, name, QUERIES[name], ORACLES[name], SF)
