"""Every query with an oracle matches DuckDB on sf0.001 (tests/parity.py runs sf0.01)."""

import pytest

from __spark_entry__ import oracle_sql
from tests.conftest import SF001
from tests.parity import compare, duck

NAMES = sorted(n for n in oracle_sql() if not n.startswith("op"))  # those of the llm subpackage have tests of their own


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, con, name):
    r = compare(spark, name, SF001, con)
    assert r["cols_match"], r
    assert r["rows"] == r["oracle_rows"], r
    assert r["types_match"], r
    assert r["values_match"], r


def test_entry_smoke(spark):
    from __spark_entry__ import entry

    df = entry(spark)
    assert df.count() > 0 and "yrmoney_text" in df.columns
