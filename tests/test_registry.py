"""Every registered query against its SQL counterpart on the smallest tables."""

from __future__ import annotations

import pytest

from oracle_check import compare, connect
from tidewire.registry import ORACLES, QUERIES, load_all

SF = "/root/testdata/sf0.001"
load_all()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_a_counterpart():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    problem, _ = compare(spark, con, name, QUERIES[name], ORACLES[name], SF)
    assert not problem
