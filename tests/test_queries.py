"""Every registered query against its oracle on the smallest sample tables."""

import os

import pytest

import __spark_entry__ as entry
from parleyframe.checks.registry import ORACLES, QUERIES
from tests.compare import compare

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    assert compare(spark, FOLDER, name) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_speech_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries())
