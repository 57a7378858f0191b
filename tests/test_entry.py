"""The driver's contract."""

import __spark_entry__ as entry


def test_queries_and_sql_agree_in_names():
    names, sql = set(entry.queries()), set(entry.oracle_sql())
    assert sql <= names and len(names) > 150


def test_entry_runs(spark):
    rows = entry.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"stratum", "n"}
