"""Every registered query against its SQL on the smallest scale; queries without SQL must run and give rows."""

import pytest

import oracle
from carnet import plans


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, con, sf_dir, name):
    reason, _, _, _ = oracle.run_one(spark, con, name, plans.QUERIES[name], plans.ORACLES.get(name), sf_dir)
    assert reason is None


def test_every_oracle_has_a_query():
    assert set(plans.ORACLES) <= set(plans.QUERIES)
