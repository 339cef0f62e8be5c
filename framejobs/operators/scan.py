"""Ranks within keys of any size. A window over a key puts all of its rows into one task; here a key may reach over many."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framejobs.sources.folders import shared_folder


def ranked(df: DataFrame, keys: list[str], order: list[Column | str], rank: str = "rank", total: str | None = None, least: dict[str, Column] | None = None) -> DataFrame:
    """Adds ``rank``, a row's place from 1 among those of its keys in the given order; ``total``, the number of those rows; and for each name of
    ``least`` the least value of a column among them.

    Rows are dealt by ranges of (keys, order), so that a frequent key is spread over as many tasks as its rows need, and written to the checkpoint
    folder with the number of their range. Windows rank within a range; ranges are then shifted by the counts before them. At most two keys of a
    range reach over its borders, so the table of shifts has at most two rows a range and is broadcast. Rows that tie keep any one order; null
    keys are a key like others; an empty table stays empty.
    """
    shared_folder(df.sparkSession)
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    least = least or {}
    tied = df.withColumns({f"_least{i}": c for i, c in enumerate(least.values())} | {"_tie": F.monotonically_increasing_id()})
    dealt = tied.repartitionByRange(*keys, *order, "_tie").withColumn("_range", F.spark_partition_id()).checkpoint()

    here = Window.partitionBy("_range", *keys)
    minima = [f"_least{i}" for i in range(len(least))]
    local = dealt.withColumns({"_rank": F.row_number().over(here.orderBy(*order, "_tie"))} | ({"_n": F.count("*").over(here)} if total else {}) | {m: F.min(m).over(here) for m in minima})

    counts = dealt.groupBy("_range", *keys).agg(F.count("*").alias("_n"), *(F.min(m).alias(m) for m in minima))
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(
        F.col("_range").alias("_r"), *(F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(whole).alias("_all"), F.count("*").over(whole).alias("_ranges"), *(F.min(m).over(whole).alias(f"_all{m}") for m in minima),
    ).filter("_ranges > 1")

    same = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_key{i}"))
    out = local.join(F.broadcast(shifts), same, "left")
    added = [(F.col("_rank") + F.coalesce("_before", F.lit(0))).alias(rank)]
    if total:
        added.append(F.coalesce("_all", "_n").alias(total))
    added += [F.coalesce(f"_all{m}", m).alias(name) for m, name in zip(minima, least, strict=True)]
    return out.select(*df.columns, *added)
