"""Every query of the library against its SQL."""

import pytest

from nodeloom.plans import fixtures
from nodeloom.plans import queries as q
from tests.conftest import SF, same_rows


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    same_rows(q.QUERIES[name](spark, SF), duck.sql(q.ORACLE_SQL[name]))


def test_queries_without_sql_run(spark):
    for name in set(q.QUERIES) - set(q.ORACLE_SQL):
        assert q.QUERIES[name](spark, SF).count() > 0


def test_entry_is_not_empty(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 6
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", ["ego_nodes_all", "ego_dataset_all"])
def test_every_node_is_an_ego_centre(spark, name):
    nodes = fixtures.event_nodes(spark, SF).select("graph_id", "node_id").distinct().count()
    assert q.QUERIES[name](spark, SF).where("center = node_id and hop = 0").count() == nodes


def test_training_by_joins_equals_packed_training(spark):
    a, b = (q.QUERIES[name](spark, SF).where("epoch = 0").first() for name in ("training_history", "training_history_joins"))
    assert a.asDict() == pytest.approx(b.asDict(), abs=2e-6)
