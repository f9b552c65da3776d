"""The driver's contract."""

from __future__ import annotations

import __spark_entry__


def test_entry_gives_the_distinct_crashes(spark):
    rows = __spark_entry__.entry(spark)
    assert rows.columns == ["key", "first", "n"] and rows.count() > 10


def test_every_oracle_belongs_to_a_query():
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert oracles.keys() <= queries.keys() and all(map(callable, queries.values()))
    if __spark_entry__.HAS_LLM:
        assert sum(n.startswith("op") for n in queries) == 13 and "pipeline" in queries
