import importlib
import sys


def test_registry_without_the_optional_folder(monkeypatch):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name == "corpus_pipeline" else real(name, *a))
    assert "pipeline" not in entry.queries() and "relation_prf" in entry.queries()
    assert not any(name.startswith("op") and name[2].isdigit() for name in entry.queries())
    assert sys.modules["__spark_entry__"] is entry


def test_flagship(spark):
    import __spark_entry__ as entry

    rows = entry.queries()["node_type_counts"](spark, "/root/testdata/sf0.001")
    assert rows.count() > 0
