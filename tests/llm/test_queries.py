import pytest

import __spark_entry__
from specula.llm import queries
from tests.oracle import same

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, data, name):
    same(__spark_entry__.queries()[name](spark, data), SQL[name], data)


def test_all_are_registered():
    names = list(queries.queries())
    assert "pipeline" in names and sorted(int(n[2:].split("_")[0]) for n in names if n != "pipeline") == list(range(1, 11))
