"""Every registered query of the engine against its SQL, and those without SQL by their shape."""

from __future__ import annotations

import pytest
from sql_compare import same_as_sql

from stratalith.oracles import ORACLES
from stratalith.registry import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, duck, sf_dir, name):
    same_as_sql(spark, duck, sf_dir, QUERIES[name], ORACLES[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_correlation_table(spark, sf_dir):
    t = QUERIES["correlate_logs"](spark, sf_dir).toPandas().sort_values(["pair", "path_index"])
    assert len(t.columns) == 21
    for _, p in t.groupby("pair"):
        assert list(p.path_index) == list(range(len(p)))
        assert p.move.iloc[0] == "start" and not p.boundary_hit.iloc[0] and not p.boundary_hit.iloc[-1]
        assert abs(p.cumulative_cost.iloc[-1] - p.total_cost.iloc[0]) < 1e-9
        assert (p.diagonal_steps + p.up_steps + p.left_steps).iloc[0] == len(p) - 1


def test_realisations(spark, sf_dir):
    r = QUERIES["gaussian_realisations"](spark, sf_dir)
    assert r.groupBy("surface_id", "seed").count().filter("count = 99 * 21").count() == 12
