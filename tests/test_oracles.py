"""Every registered query with SQL gives the rows of that SQL; the others give rows."""

import pytest

from compare import differences
from sparkreef.queries import registry

QUERIES = registry()


@pytest.mark.parametrize("name", sorted(n for n, q in QUERIES.items() if q.oracle))
def test_same_rows_as_sql(spark, small, name):
    assert differences(QUERIES[name].run(spark, small), QUERIES[name].oracle, small) is None


@pytest.mark.parametrize("name", sorted(n for n, q in QUERIES.items() if not q.oracle))
def test_gives_rows(spark, small, name):
    assert QUERIES[name].run(spark, small).count() > 0
