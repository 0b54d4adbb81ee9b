import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

import __spark_entry__ as spark_entry
from check_queries import compare, connect

from textprep.catalog import QUERIES

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    return connect(str(DATA))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_its_oracle(spark, con, name):
    assert compare(spark, con, name, str(DATA)) is None


def test_entry(spark):
    df = spark_entry.entry(spark)
    assert df.count() > 0 and "variant" in df.columns


def test_every_oracle_has_a_query():
    assert set(spark_entry.oracle_sql()) <= set(spark_entry.queries())
