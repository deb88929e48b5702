"""Each registered query of the library against its SQL."""

import pytest

from ledgerline.plans import oracle, registry
from tests.conftest import same_rows


PATHS = ("bootstrap_horizons", "bootstrap_fan")  # as registered, their SQL takes minutes


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(PATHS)))
def test_query_matches_sql(name, spark, sf, duck):
    same_rows(registry.QUERIES[name](spark, sf), duck.execute(registry.ORACLE[name]))


@pytest.mark.parametrize("name", PATHS)
def test_paths_match_sql(name, spark, sf, duck):
    sql = oracle.without_negative_zero(oracle.bootstrap_sql(100)[name])
    same_rows(registry.QUERIES[name](spark, sf, n_paths=100), duck.execute(sql))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(__spark_entry__.queries()) and set(registry.ORACLE) <= set(__spark_entry__.oracle_sql())
