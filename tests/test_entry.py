"""The driver's entry without the optional subpackage."""

import sys

import __spark_entry__ as driver


def test_queries_without_the_optional_subpackage(monkeypatch):
    every = set(driver.queries())
    monkeypatch.setitem(sys.modules, "vaultferry.llm", None)
    monkeypatch.setitem(sys.modules, "vaultferry.llm.queries", None)
    left = driver.queries()
    assert left and set(left) < every and not any(n.startswith("op1") for n in left)
    assert set(driver.oracle_sql()) <= set(left)
