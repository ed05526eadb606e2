import __spark_entry__


def test_flagship_and_registry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    q, s = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(s) <= set(q) and len(q) > 60
