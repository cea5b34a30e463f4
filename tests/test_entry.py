import __spark_entry__ as entry
from mercato.sources import check_contract, stand_in_tables
from mercato.sources.schema import ContractError

import pytest


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns[:2] == ["customer_id", "recency"]
    assert df.count() > 0


def test_keys_match():
    assert set(entry.REPORTS) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_stand_in_tables_meet_contracts(spark, sf_dir):
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    t = stand_in_tables(spark, sf_dir)
    assert spark.sparkContext.statusTracker().getJobIdsForGroup(None) == before
    assert t.translation.count() == 71


def test_contract_violations(spark):
    bad = spark.createDataFrame([("a", 1.5)], "order_id string, price double")
    with pytest.raises(ContractError):
        check_contract("items", bad)


def test_shared_folder_must_be_named_on_a_cluster():
    from types import SimpleNamespace
    from mercato.session import ensure_checkpoint_dir
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None),
                              sparkContext=SimpleNamespace(master="local-cluster[2,1,1024]"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(cluster)
