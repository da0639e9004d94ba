"""Every registered query against its SQL on the test tables."""

from __future__ import annotations

import pytest

from millrace_checks.all_checks import ORACLES, QUERIES
from millrace_checks.compare import differences, duck


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    assert differences(QUERIES[name](spark, sf_dir), con, ORACLES[name]) is None


def test_entry(spark):
    from __spark_entry__ import entry

    assert entry(spark).count() > 0
