import builtins
import importlib
import sys

import __spark_entry__
from conftest import SF


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_the_llm_folder(monkeypatch, spark):
    real = builtins.__import__

    def refuse(name, *a, **k):
        if name.startswith(("plumbline.llm", "corpus_pipeline")):
            raise ModuleNotFoundError(name)
        return real(name, *a, **k)

    for name in [m for m in sys.modules if m.startswith(("plumbline.llm", "corpus_pipeline"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(builtins, "__import__", refuse)
    entry = importlib.reload(__spark_entry__)
    names = entry.queries()
    assert "pipeline" not in names and not any(n.startswith("op1_") for n in names)
    assert names["g01_recent_jobs"](spark, SF).count() == 50
    monkeypatch.undo()
    importlib.reload(__spark_entry__)
