"""Every query is registered with a callable, and every oracle belongs to one; the optional subpackage may be missing."""

import importlib
import sys

import __spark_entry__ as entry


def test_oracles_have_queries():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and all(callable(f) for f in q.values())


def test_without_the_optional_subpackage(monkeypatch):
    class Gone:
        def find_spec(self, name, path=None, target=None):
            if name == "corpus_pipeline" or name.startswith("siltflow.llm"):
                raise ModuleNotFoundError(name, name=name)

    for m in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("siltflow.llm")]:
        monkeypatch.delitem(sys.modules, m)
    siltflow = importlib.import_module("siltflow")
    monkeypatch.delattr(siltflow, "llm", raising=False)
    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    left = entry.queries()
    assert left and not any(k.startswith("op") and k[2].isdigit() or k == "pipeline" for k in left)
