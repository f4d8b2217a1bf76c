from __future__ import annotations

import pytest
from oracle_util import connection, differences

from quern.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, data, name):
    assert not differences(queries.QUERIES[name](spark, data), connection(data), queries.ORACLE_SQL[name])
