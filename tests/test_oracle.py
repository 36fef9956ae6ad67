"""Every catalogue query against its DuckDB oracle, on the smallest driver tables."""

import pytest

from tests.oracle_check import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not __import__("os").path.isdir(SF), reason="driver tables not present")
def test_all_queries_match_oracle(spark):
    res = compare(spark, SF, verbose=False)
    bad = [k for k, ok in res.items() if not ok]
    assert not bad, bad
