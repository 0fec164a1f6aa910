"""Every catalogued query against its oracle, on the smallest tables."""

from __future__ import annotations

import pytest
from oracle import connect, same

from sessionlake import queries, table_queries, tree_queries  # noqa: F401  (adds its own to the catalogue)

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    same(queries.QUERIES[name](spark, SF), con, queries.ORACLE_SQL[name])


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["conv_id", "n_messages", "n_bytes", "n_tokens", "messages_sha256"]
    assert df.count() > 0
    assert set(queries.QUERIES) <= set(entry.queries())
