"""Ranks within keys that reach over many ranges."""

import random

from pyspark.sql import functions as F

from framejobs.operators.scan import ranked


def brute(rows):
    groups = {}
    for k, o, v in rows:
        groups.setdefault(k, []).append((o, v))
    out = []
    for k, found in groups.items():
        found.sort(key=lambda r: (r[0] is not None, r[0], r[1]))
        out += [(k, o, v, i, len(found), min(x for _, x in found)) for i, (o, v) in enumerate(found, 1)]
    return sorted(out, key=str)


def result(df):
    out = ranked(df, ["k"], [F.col("o").asc_nulls_first(), F.col("v")], "place", total="size", least={"low": F.col("v")})
    assert out.columns == ["k", "o", "v", "place", "size", "low"]
    return sorted(map(tuple, out.collect()), key=str)


def test_ranks_with_a_hot_key_null_keys_and_null_orders(spark):
    r = random.Random(5)
    rows = [(r.choice([1, 1, 1, 2, 3, None]), r.choice([None, *range(300)]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, o long, v long").repartition(7)
    assert result(df) == brute(rows)


def test_no_range_holds_a_hot_key_whole(spark):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(20_000).select(F.lit(7).alias("k"), F.col("id").alias("o"), F.col("id").alias("v"))
        out = ranked(df, ["k"], ["o"], "place", total="size").filter("place <> o + 1 or size <> 20000")
        assert out.isEmpty()
        sizes = df.repartitionByRange("k", "o").groupBy(F.spark_partition_id()).count().collect()
        assert len(sizes) > 1 and max(x["count"] for x in sizes) < 12_000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_equal_rows_get_ranks_of_their_own_and_empty_tables_stay_empty(spark):
    df = spark.createDataFrame([(1, 1, 1)] * 500, "k long, o long, v long").repartition(5)
    assert sorted(r["place"] for r in ranked(df, ["k"], ["o"], "place").collect()) == list(range(1, 501))
    assert ranked(df.limit(0), ["k"], ["o"], "place", total="size").collect() == []
