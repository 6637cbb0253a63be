"""Every query of this package that SQL can express, against that SQL."""

import pytest

from maskwright.llm import catalog
from tests.compare import _rows, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, name):
    ours = catalog.QUERIES[name](spark, FOLDER)
    rel = connect(FOLDER).sql(catalog.ORACLES[name])
    assert _rows(ours.columns, [tuple(r) for r in ours.collect()]) == _rows(rel.columns, rel.fetchall())


def test_thirteen_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in catalog.QUERIES) == list(range(1, 14))
