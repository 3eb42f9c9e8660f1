"""Every query against its SQL on a second engine, and the whole medallion on stored tables."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import rows
from tollguard import adapter
from tollguard.plans import medallion
from tollguard.session import materialize
from verification import queries as registry
from verification.compare import connect, difference
from verification.oracles import ORACLES
from verification.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
SHARED = ["_silver", "_gold", "_train", "_master"]


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


@pytest.fixture(scope="module", autouse=True)
def shared_inputs():
    """Build the tables many queries start from once; the queries themselves run as they are."""
    patch, kept = pytest.MonkeyPatch(), {}

    def keep(name, build):
        def get(spark, sf):
            if name not in kept:
                kept[name] = materialize(build(spark, sf))
            return kept[name]
        return get

    for name in SHARED:
        patch.setattr(registry, name, keep(name, getattr(registry, name)))
    yield
    patch.undo()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, connection, name):
    result = QUERIES[name](spark, SF_DIR)
    assert difference(result, connection, ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_returns_rows(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_medallion_writes_and_links_all_tables(spark, tmp_path):
    bronze = adapter.bronze(adapter.events(spark, SF_DIR))
    twice = bronze.unionByName(bronze)
    tables = medallion.build(
        spark, twice, adapter.holidays(spark), str(tmp_path), "2024-02-02 00:00:00"
    )
    n = tables["silver"].count()
    for name in ("gold", "gold_rulebased", "gold_train", "pred_raw", "pred_viz", "master_viz"):
        assert tables[name].count() == n, name
    stats = tables["stats"].first()
    flagged = tables["pred_raw"].filter("is_anomaly = 1").count()
    assert (stats["total_transactions"], stats["total_alert_all_time"]) == (n, flagged)
    assert flagged == pytest.approx(n * 0.01, abs=1)
    assert tables["stats_month"].agg(F.sum("total_transactions")).first()[0] == n
    reviewed = tables["master_viz"].filter("status = 'Needs Review'")
    assert reviewed.filter("ml_predicted_category <> 'Critical Risk'").count() == 0
    assert rows(tables["master_viz"].filter("status is null")) == []


def test_medallion_refuses_shared_ids(spark, tmp_path):
    bronze = adapter.bronze(adapter.events(spark, SF_DIR))
    with pytest.raises(ValueError, match="not unique"):
        medallion.build(
            spark, bronze.unionByName(bronze), adapter.holidays(spark), str(tmp_path),
            "2024-02-02 00:00:00", dedupe=False,
        )
