"""The driver's contract."""

from __future__ import annotations

import __spark_entry__ as entry


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns and df.count() > 0


def test_registry():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 200 and all(callable(f) for f in q.values())


def test_nothing_outside_imports_the_corpus_operators():
    from pathlib import Path

    root = Path(entry.__file__).parent
    for p in (root / "recallbase").rglob("*.py"):
        if "llm" not in p.parts:
            assert "recallbase.llm" not in p.read_text()
