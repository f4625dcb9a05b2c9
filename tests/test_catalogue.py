"""Every registered query of the library against its SQL on the smallest tables."""

import pytest
from conftest import SF
from util import agree

from trailmark.plans.catalogue import oracle_sql, queries

ORACLE = oracle_sql()


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, duck, name):
    df = queries()[name](spark, SF)
    if name in ORACLE:
        agree(df, duck, ORACLE[name])
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(ORACLE) <= set(__spark_entry__.queries())
