"""Suppression in crowded frames, positions in long videos with gaps, and full model batches."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from framejobs.operators import detections, frames, redact
from framejobs.operators.catalog import batch_progress
from framejobs.operators.pixels import suppress, suppress_in_order
from framejobs.plans import queries as Q


def boxes_of(seed, n):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        x, y = r.choice([r.uniform(-50, 300), r.randrange(0, 40)]), r.uniform(-50, 300)
        w, h = (r.choice([0, 1, 2, 7, 8, 16, 90, r.uniform(0, 60), -3]) for _ in "wh")
        out.append((x, y, x + w, y + h))
    return out + out[: n // 10]


@pytest.mark.parametrize("limit", [0.05, 0.3, 0.5, 1.0])
def test_grids_suppress_as_all_pairs_do(limit):
    for seed in range(25):
        boxes = np.array(boxes_of(seed, 150))
        # All scores are alike, so of two boxes the one with the higher index is better.
        kept = suppress(boxes, np.zeros(len(boxes)), limit)
        order = np.arange(len(boxes))[::-1]
        assert sorted(order[suppress_in_order(boxes[order], limit)].tolist()) == kept


@pytest.mark.parametrize("many", [0, 100])
def test_crowded_frames(spark, many):
    rows = [(1, f, i, *map(float, b), float(random.Random(i).randrange(20))) for f, n in ((1, 3), (2, 60), (3, 250)) for i, b in enumerate(boxes_of(f, n))]
    df = spark.createDataFrame(rows, "video_id long, frame_id long, det_idx int, x1 double, y1 double, x2 double, y2 double, score double").repartition(3)
    key = lambda r: tuple(r)
    assert sorted(map(key, detections.nms(df, many=many).collect())) == sorted(map(key, detections.nms(df, many=10**6).collect()))


def test_twenty_thousand_boxes_of_one_frame_take_seconds(spark):
    k = F.col("id")
    df = spark.range(20_000).select(F.lit(1).alias("video_id"), F.lit(1).alias("frame_id"), k.cast("int").alias("det_idx"), (k % 200 * 5.0).alias("x1"), (F.floor(k / 200) * 5.0).alias("y1"), (k * 7919 % 20_011).cast("double").alias("score"))
    df = df.select("*", (F.col("x1") + 9).alias("x2"), (F.col("y1") + 9).alias("y2"))
    began = time.monotonic()
    got = sorted(r.det_idx for r in detections.nms(df).collect())
    assert time.monotonic() - began < 30
    p = df.toPandas()
    left = p[["x1", "y1", "x2", "y2"]].to_numpy()
    assert got == suppress(left, p["score"].to_numpy(), 0.3)


@pytest.mark.parametrize("fps_out", [None, 25.0, 60.0])
def test_trimming_with_missing_frames(spark, fps_out):
    r = random.Random(8)
    ids = {v: sorted(r.sample(range(400), 150)) for v in range(3)}
    df = spark.createDataFrame([(v, i, 24.0 if v else 60.0) for v, found in ids.items() for i in found], "video_id long, frame_id long, fps double").repartition(3)
    want = []
    for v, found in ids.items():
        out = []
        for n, i in enumerate(x for x in found if x >= 50):
            if fps_out is None:
                out.append(i)
            else:
                fps = 24.0 if v else 60.0
                out += [i] * int(np.floor((n + 1) * (fps_out / fps) + 0.5) - np.floor(n * (fps_out / fps) + 0.5))
        want += [(v, i, k) for k, i in enumerate(out[:70])]
    got = frames.trim_frames(df, F.lit(50), F.lit(120), None if fps_out is None else F.lit(fps_out), dense=False).select("video_id", "frame_id", "out_id")
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_one_batch_of_many_files_uses_many_tasks(spark):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        n = 300_000
        df = spark.range(n).select((n - F.col("id")).alias("file_id"), F.lit(1).alias("batch"))
        out = batch_progress(df, "batch", "file_id", F.col("file_id") * 2).withColumn("task", F.spark_partition_id())
        wrong = (F.col("done_after") != F.col("file_id")) | (F.col("done_before") != F.col("file_id") - 1) | (F.col("total") != n) | (F.col("elapsed") != F.col("file_id") * 2 - 2)
        row = out.agg(F.count_if(wrong), F.count("*"), F.count_distinct("task")).first()
        assert row[:2] == (0, n) and row[2] > 1
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_the_model_is_called_with_full_batches(spark):
    calls = spark.sparkContext.accumulator(0)

    def counting():
        model = Q.bright_model()

        def run(x):
            calls.add(1)
            return model(x)

        return run

    shapes = [(32, 32), (32, 64), (64, 32)]
    rng = np.random.default_rng(5)
    rows = [(1, k, *shapes[k % 3 if k % 4 else 0], 1, None if k % 10 == 9 else k) for k in range(200)]
    rows = [(v, k, h, w, c, None if p is None else rng.integers(0, 256, h * w, dtype=np.uint8).tobytes()) for v, k, h, w, c, p in rows]
    df = spark.createDataFrame(rows, "video_id long, frame_id long, height int, width int, channels int, pixels binary").coalesce(1)
    size = {s: sum(r[2:4] == s and r[5] is not None for r in rows) for s in shapes}
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, 7)
    try:
        out = redact.score_frames(df, counting, threshold=0.7)
        got = {r.frame_id: r for r in out.collect()}
        assert calls.value == sum(-(-n // 8) for n in size.values())
        alone = {r.frame_id: r for r in redact.score_frames(df, Q.bright_model, batch=1, threshold=0.7, held_bytes=1).collect()}
        assert got == alone and len(got) == 200 and any(r.boxes for r in got.values())
        assert all(bytes(got[k].pixels) == p if p else got[k].pixels is None and got[k].boxes == [] for _, k, _, _, _, p in rows)
    finally:
        spark.conf.set(key, before)
