"""Every registered query against its SQL twin, on the smallest data."""

import os

import pytest

from maskwright.plans import catalog
from tests.compare import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data here")
@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, con, name):
    assert compare(spark, con, FOLDER, name) is None


def test_every_check_belongs_to_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
