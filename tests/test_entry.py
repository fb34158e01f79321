import importlib
import sys

import pytest

import __spark_entry__ as entry


def test_the_core_does_without_the_rest(monkeypatch):
    """A subpackage that can't be imported takes no core query with it."""
    whole = set(entry.queries())
    monkeypatch.setitem(sys.modules, "scriptorium.llm.queries", None)  # its import fails from now on
    core = importlib.import_module("scriptorium.plans.queries")
    assert set(entry.queries()) == set(core.QUERIES) <= whole and set(entry.oracle_sql()) == set(core.SQL)


def test_no_machine_local_folder_on_a_cluster():
    from scriptorium import session

    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context

        class conf:
            get = staticmethod(lambda *a: None)

    with pytest.raises(RuntimeError):
        session.shared_folder(Session)
