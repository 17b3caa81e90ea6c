import pytest

from knotwork.plans import queries as Q

#: Discovery of the same kind on further tables is left to the larger run.
SOME = [k for k in Q.ORACLES if not k.startswith(("minimal_mvds_", "fd_discovery_"))] + ["minimal_mvds_bazaar6", "minimal_mvds_bazaar_strict", "minimal_mvds_flag", "minimal_mvds_fd2", "minimal_mvds_strict", "fd_discovery_fd2", "fd_discovery_nulls", "minimal_mvds_empty"]


@pytest.mark.parametrize("name", SOME)
def test_sql_form(same, name):
    same(Q.QUERIES[name], Q.ORACLES[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() >= 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
