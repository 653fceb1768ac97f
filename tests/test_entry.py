"""The driver contract."""

import importlib
import sys

import __spark_entry__


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_works_without_the_training_data_subpackage(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("retrieval_jobs.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "retrieval_jobs.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    monkeypatch.delitem(sys.modules, "__spark_entry__")
    entry = importlib.import_module("__spark_entry__")
    names = set(entry.queries())
    assert "answer_context" in names and "pipeline" not in names and not any(n.startswith("op1_") for n in names)
    assert set(entry.oracle_sql()) <= names
