"""The driver's contract."""

import inspect

import __spark_entry__ as entry


def test_names_agree():
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and len(q) > 120 and len(sql) > 100
    assert all(len(inspect.signature(f).parameters) == 2 for f in q.values())


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert [r["side"] for r in sorted(rows)] == ["A", "B"] and all(r["n"] > 0 for r in rows)
