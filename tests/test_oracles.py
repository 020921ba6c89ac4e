"""Every registered query of the library itself against its SQL."""

from __future__ import annotations

import pytest

from recallbase.plans import load

REGISTRY = load()


@pytest.mark.parametrize("name", sorted(REGISTRY.ORACLES))
def test_same_rows_as_sql(name, spark, sf_dir, same):
    same(REGISTRY.QUERIES[name](spark, sf_dir), REGISTRY.ORACLES[name])
