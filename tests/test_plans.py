"""Every registered query of the library against its SQL, on the smallest tables."""

import os

import pytest

from factloom import plans
from tests.oracle import connect, difference

FOLDER = os.environ.get("FACTLOOM_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, name):
    got = plans.QUERIES[name](spark, FOLDER).toPandas()
    assert len(got) or name in ("q_registry_absent",)
    if name in plans.ORACLES:
        assert difference(got, connect(FOLDER).execute(plans.ORACLES[name]).df()) == ""
