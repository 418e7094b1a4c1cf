import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from oracle_compare import compare, duck  # noqa: E402
from quarry.llm.queries import ORACLE_SQL, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("key", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, key):
    r = compare(spark, duck(SF), QUERIES[key], ORACLE_SQL[key], SF)
    assert r["ok"], r
