from __future__ import annotations

import pytest
from oracle import differences, duck
from tidewatch.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, medium, name):
    assert differences(queries.QUERIES[name](spark, medium), duck(medium), queries.SQL[name]) == ""
