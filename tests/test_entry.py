"""The driver's contract with and without the training-data operators."""

from __future__ import annotations

import sys

import pytest

import __spark_entry__ as e
from stratalith.oracles import ORACLES
from stratalith.registry import QUERIES


@pytest.mark.parametrize("missing", ["stratalith.llm", "stratalith.llm.queries", "stratalith.llm.oracles"])
def test_without_operators(monkeypatch, missing):
    """A part that cannot be imported, for whatever reason, takes no query of the engine down."""
    for name in [m for m in sys.modules if m.startswith("stratalith.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, missing, None)
    monkeypatch.delitem(sys.modules, "corpus_pipeline", raising=False)
    assert set(e.queries()) == set(QUERIES) and e.oracle_sql() == ORACLES


def test_without_pipeline(monkeypatch):
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert "pipeline" not in e.queries() and set(QUERIES) <= set(e.queries())


def test_names():
    assert set(ORACLES) <= set(QUERIES) and set(e.oracle_sql()) <= set(e.queries())
