import __spark_entry__ as entry


def test_every_sql_is_text():
    assert all(isinstance(v, str) for v in entry.oracle_sql().values())
