"""Equi-joins with an aggregate on keys that many rows may share.

An aggregate by key and a join with it on the same key would share a stage,
which adaptive execution cannot split: all rows of one key would meet in one
task.  The aggregate is a written table here and knows each key's number of
rows.  Keys of more than ``HOT_ROWS`` rows, and of more than one in ``HOT_KEYS``
of all rows, are hot: there are at most ``HOT_KEYS`` of them whatever the input,
so they are joined by broadcast where the rows lie, and only the others are
shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 1_000
HOT_KEYS = 10_000


def join_totals(rows: DataFrame, totals: DataFrame, keys: list[str], count: str) -> DataFrame:
    """``rows`` with the columns of ``totals``, which has one narrow row for each
    key and the number of its rows in ``count``; an inner join."""
    limit = max(HOT_ROWS, (totals.agg(F.sum(count)).first()[0] or 0) // HOT_KEYS)
    hot = totals.where(F.col(count) > limit)
    if hot.isEmpty():
        return rows.join(totals, keys)
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(totals.where(F.col(count) <= limit), keys)
    return rows.join(F.broadcast(hot), keys).unionByName(cold)
