"""Every registered query of the reference's operators beside its SQL; the others at least run with a stable schema."""

import pytest
from oracle import expected, found

from posewright.plans import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_equal_sql(spark, sf, name):
    names, rows = found(QUERIES[name](spark, sf))
    want_names, want = expected(ORACLES[name], sf)
    assert names == want_names
    assert rows == want, (list((rows - want).items())[:3], list((want - rows).items())[:3])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.count() > 0 and df.schema == QUERIES[name](spark, sf).schema
