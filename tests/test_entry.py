"""The driver's contract."""

import importlib
import sys

import __spark_entry__ as entry


def test_entry(spark):
    df = entry.entry(spark)
    assert "event_id" in df.columns and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_works_without_the_text_operators(monkeypatch):
    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("heatloom.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "heatloom.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    fresh = importlib.reload(entry)
    assert "heat_events" in fresh.queries() and not any(n.startswith("op") for n in fresh.queries())
    monkeypatch.undo()
    importlib.reload(entry)
