"""Suppression in many crowded frames at a time."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from framejobs.operators import detections
from framejobs.operators.pixels import suppress, suppress_groups
from tests.media.test_crowds import boxes_of


@pytest.mark.parametrize("limit", [0.05, 0.3, 1.0, 0.0])
@pytest.mark.parametrize(("pairs", "crowd"), [(1 << 20, 1 << 23), (50, 1 << 23), (50, 300), (1, 0)])
def test_groups_equal_frames_by_themselves(limit, pairs, crowd):
    groups = [boxes_of(s, random.Random(s).randrange(60)) for s in range(12)]
    groups[3] += [(float("nan"), 0.0, 3.0, 4.0), (0.0, 0.0, float("inf"), 5.0), (1e100, 1e100, 1.5e100, 1.5e100)]
    got = suppress_groups(np.array([b for g in groups for b in g]), np.array([3 * k for k, g in enumerate(groups) for _ in g]), limit, pairs, crowd)
    best = lambda g: -np.arange(len(g))
    assert got.tolist() == [k in kept for g in groups for kept in [suppress(np.array(g).reshape(-1, 4), best(g), limit)] for k in range(len(g))]
    assert len(suppress_groups(np.zeros((0, 4)), np.zeros(0), limit)) == 0


def test_a_chain_and_copies():
    """Each box overlaps the next, so that every second stays; of copies the first."""
    chain = np.array([(k, 0.0, k + 2.0, 1.0) for k in range(20_000)])
    assert suppress_groups(chain, np.zeros(20_000), 0.3).tolist() == [k % 2 == 0 for k in range(20_000)]
    assert suppress_groups(np.ones((5000, 4)) * (0, 0, 1, 1), np.zeros(5000), 0.3).sum() == 1


def test_crowded_frames_of_one_task_take_seconds(spark):
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, 1)
    try:
        k, r = F.col("id"), lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n))
        df = spark.range(120_000).select(F.lit(1).alias("video_id"), F.floor(k / 400).alias("frame_id"), (k % 400).cast("int").alias("det_idx"), (r(60, 1) + k % 10 * 40).cast("double").alias("x1"), (r(60, 2) + F.floor(k / 10) % 10 * 40).cast("double").alias("y1"), r(50, 3).alias("q"), r(1000, 4).cast("double").alias("score"))
        df = df.select("*", (F.col("x1") + 20 + F.col("q")).alias("x2"), (F.col("y1") + 30 + F.col("q")).alias("y2"))
        began = time.monotonic()
        got = detections.nms(df).select("frame_id", "det_idx").toPandas()
        assert time.monotonic() - began < 20
        p = df.filter("frame_id = 7").orderBy("det_idx").toPandas()
        assert sorted(got[got["frame_id"] == 7]["det_idx"]) == suppress(p[["x1", "y1", "x2", "y2"]].to_numpy(), p["score"].to_numpy(), 0.3)
    finally:
        spark.conf.set(key, before)
