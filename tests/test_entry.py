import __spark_entry__


def test_names_and_oracles_agree():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).limit(1).count() == 1
