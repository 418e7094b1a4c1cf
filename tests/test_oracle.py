"""Every registered query with an oracle equals DuckDB at sf0.01 (the driver's check)."""

import pytest

from conftest import SF01
from oracle_compare import compare, duck
import __spark_entry__ as E

QUERIES = E.queries()
ORACLE = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF01)


def test_every_query_registered_with_oracle_or_marked():
    # iterative or hashed operators of the training-data part have brute-force tests of their own
    own = {"pipeline", "op3_jaccard_tree", "op5_byte_shards", "op6_decontaminate", "op7_importance_classifier", "op8_bm25_topk", "op9_token_blocks",
           "op10_line_dedup", "op11_periodic_runs", "op12_prefix_trie", "op13_language_id"}
    assert set(QUERIES) - set(ORACLE) <= own
    assert not set(ORACLE) - set(QUERIES)


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_query_matches_oracle(spark, con, key):
    r = compare(spark, con, QUERIES[key], ORACLE[key], SF01)
    assert r["ok"], r


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["keyword_group", "files"] and len(rows) > 0
