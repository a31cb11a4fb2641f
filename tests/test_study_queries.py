"""Registered study queries against their SQL twins on the smallest tables."""

from pathlib import Path

import pytest

from fieldweave.plans import study, study_oracles
from tests.test_queries import assert_same

pytestmark = pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="the driver's tables are not here")


def test_every_query_has_a_twin():
    assert set(study.QUERIES) == set(study_oracles.ORACLES)


@pytest.mark.parametrize("name", sorted(study.QUERIES))
def test_twin(spark, name):
    assert_same(spark, name, study.QUERIES[name], study_oracles.ORACLES[name])
