"""Every query is registered well, and the flagship query runs."""

import __spark_entry__ as driver


def test_every_query_has_its_sql():
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert set(driver.registry.QUERIES) - set(driver.registry.SQL) == {"profile_approx"}


def test_flagship(spark):
    got = driver.entry(spark).collect()
    assert [r.l_returnflag for r in got] == sorted(r.l_returnflag for r in got) and len(got) == 4
