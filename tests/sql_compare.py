"""Rows of a query held against those of its SQL. Not in conftest.py: two files of that name cannot both be imported by it."""

from __future__ import annotations


def rows_of(frame) -> list[tuple]:
    """Rows with columns in order of their names, sorted; lists as tuples, NaN as None."""
    import numpy as np
    import pandas as pd

    def plain(x):
        if isinstance(x, list | tuple | np.ndarray):
            return tuple(plain(y) for y in x)
        if hasattr(x, "item"):
            x = x.item()
        return None if x is None or x is pd.NA or x != x else x

    names = sorted(frame.columns)
    return sorted((tuple(plain(x) for x in r) for r in frame[names].astype(object).itertuples(index=False)), key=repr)


def same_as_sql(spark, duck, sf_dir: str, query, sql: str) -> None:
    ours, theirs = query(spark, sf_dir).toPandas(), duck.sql(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows_of(ours) == rows_of(theirs)
