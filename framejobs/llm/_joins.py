"""Joins whose keys may be very frequent on one side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that are broadcast at most.
HOT_KEYS = 10_000


def join_frequent(rows: DataFrame, one: DataFrame, key: str | list[str], count: str, total: int, hot_keys: int = HOT_KEYS) -> DataFrame:
    """Inner join of ``rows`` with ``one``, which has one row for each key (a column or several) and in ``count`` how many of ``rows`` have it.

    Keys with more than one in ``hot_keys`` of all ``total`` rows are fewer than ``hot_keys``: those rows of ``one`` are broadcast, so that no task
    gets all rows of a key. The others are shuffled. Null keys join nothing. Of fewer than ``hot_keys`` rows all keys are broadcast, in one join.
    """
    key = [key] if isinstance(key, str) else key
    others = [c for c in one.columns if c not in key]
    if total < hot_keys:
        return rows.join(F.broadcast(one), key).select(*rows.columns, *others)
    hot = one.filter(F.col(count) > total // hot_keys)
    flagged = rows.join(F.broadcast(hot.select(*key, F.struct(*others).alias("_hot"))), key, "left")
    at_once = flagged.filter("_hot is not null").select(*rows.columns, *(F.col("_hot")[c].alias(c) for c in others))
    return at_once.unionByName(flagged.filter("_hot is null").drop("_hot").join(one, key).select(*rows.columns, *others))
