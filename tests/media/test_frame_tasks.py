"""Scoring and redaction of many small frames: by whole batches, in several tasks, with the results of plain loops."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from framejobs.operators import pixels as P
from framejobs.operators import redact
from framejobs.plans import queries as Q
from framejobs.streaming import jobs as streams

SCHEMA = "video_id long, frame_id long, height int, width int, channels int, pixels binary"


def boxes_one_by_one(frame, threshold, limit=0.3):
    """Plain loops over the cells of one frame."""
    h, w = frame.shape[:2]
    nh, nw = -(-h // 32) * 32, -(-w // 32) * 32
    heat, scale, offset, marks = (x[0] for x in Q.toy_model()(P.resize(P.ensure_rgb(frame), nw, nh).transpose(2, 0, 1)[None].astype(np.float32)))
    found = []
    for y, x in zip(*np.nonzero(heat[0] > threshold), strict=True):
        bh, bw = (float(np.exp(np.float64(scale[i, y, x]))) * 4 for i in (0, 1))
        x1 = min(max((x + np.float64(offset[1, y, x]) + 0.5) * 4 - bw / 2, 0), nw)
        y1 = min(max((y + np.float64(offset[0, y, x]) + 0.5) * 4 - bh / 2, 0), nh)
        points = [v for j in range(5) for v in ((float(marks[2 * j + 1, y, x]) * bw + x1) / (nw / w), (float(marks[2 * j, y, x]) * bh + y1) / (nh / h))]
        found.append((x1, y1, min(x1 + bw, nw), min(y1 + bh, nh), float(heat[0, y, x]), points))
    keep = P.suppress(np.array([b[:4] for b in found]).reshape(-1, 4), np.array([b[4] for b in found]), limit)
    return [(k, found[k][0] / (nw / w), found[k][1] / (nh / h), found[k][2] / (nw / w), found[k][3] / (nh / h), *found[k][4:]) for k in keep]


def test_scores_equal_plain_loops(spark):
    rng = np.random.default_rng(11)
    shapes = [(20, 24, 3), (32, 32, 1), (40, 33, 4), (20, 24, 1)]
    arrays = {k: rng.integers(90, 256, shapes[k % 4], dtype=np.uint8) for k in range(120)}
    rows = [(1, k, *a.shape, a.tobytes()) for k, a in arrays.items()] + [(1, 200, 20, 24, 3, None), (1, 201, None, 24, 3, b"x")]
    out = redact.score_frames(spark.createDataFrame(rows, SCHEMA).repartition(2), Q.toy_model, threshold=0.68)
    got = {r.frame_id: r for r in out.collect()}
    assert len(got) == len(rows) and got[200].boxes == got[201].boxes == [] and got[200].pixels is None
    several = 0
    for k, a in arrays.items():
        want = boxes_one_by_one(a, 0.68)
        assert bytes(got[k].pixels) == a.tobytes() and [b.det_idx for b in got[k].boxes] == [b[0] for b in want]
        for b, w in zip(got[k].boxes, want, strict=True):
            assert np.allclose([b.x1, b.y1, b.x2, b.y2, b.score, *b.landmarks], [*w[1:6], *w[6]], rtol=1e-6, atol=1e-6)
        several += len(want) > 1
    assert several > 20


def test_small_frames_of_one_task_take_seconds(spark):
    base = spark.range(40_000).coalesce(1).select((F.col("id") % 6).alias("video_id"), F.col("id").alias("frame_id"))
    scored = redact.score_frames(Q.spread_frames(base), Q.bright_model, threshold=0.7501)
    began = time.monotonic()
    assert scored.agg(F.count_if(F.size("boxes") > 0)).first()[0] > 1000
    assert time.monotonic() - began < 20


def test_frames_of_one_row_group_are_scored_by_several_tasks(spark):
    assert spark.read.parquet("/root/testdata/sf0.1/orders.parquet").rdd.getNumPartitions() == 1
    assert Q.score_frames(spark, "/root/testdata/sf0.1").rdd.getNumPartitions() == 8


def test_a_micro_batch_of_one_file_is_written_by_several_tasks(spark, monkeypatch):
    run, paths = streams.run_by_epoch, []
    monkeypatch.setattr(streams, "run_by_epoch", lambda out, path, state: (paths.append(path), run(out, path, state))[1])
    Q.frame_stream(spark, "/root/testdata/sf0.001")
    written = spark.read.parquet(paths[0])
    assert written.select(F.input_file_name()).distinct().count() == 4 and written.count() == 1500


@pytest.mark.parametrize("mode", ["solid", "blur"])
def test_redaction_equals_plain_calls(spark, mode):
    rng = np.random.default_rng(12)
    boxed, rows = SCHEMA + ", boxes array<struct<det_idx: long, x1: double, y1: double, x2: double, y2: double>>", []
    for k in range(60):
        a = rng.integers(0, 256, [(16, 16, 1), (20, 24, 3), (9, 12, 4)][k % 3], dtype=np.uint8)
        boxes = [(int(d), *(c + s for s in (0, 7) for c in rng.uniform(-2, 9, 2).tolist())) for d in rng.permutation(k % 5)]
        boxes += [(None, 2.0, 2.0, 8.0, 8.0), (9, None, 0.0, 5.0, 5.0), None][: k % 4]
        rows.append((1, k, *a.shape, None if k == 17 else a.tobytes(), None if k % 7 == 6 else boxes))
    got = {r.frame_id: r for r in redact.redact_frames(spark.createDataFrame(rows, boxed).repartition(2), mode).collect()}
    for _, k, h, w, c, data, boxes in rows:
        if data is None:
            assert got[k].pixels is None
            continue
        usable = [b for b in boxes or [] if b is not None and b[1] is not None]
        order = sorted(usable, key=lambda b: (b[0] is None, b[0]))
        want = P.redact_frame(np.frombuffer(data, np.uint8).reshape(h, w, c), [b[1:] for b in order], mode)
        assert bytes(got[k].pixels) == want.tobytes()


def test_the_whole_job_runs_in_several_tasks(spark, monkeypatch):
    job, given = Q.redaction.redact_videos, []
    monkeypatch.setattr(Q.redaction, "redact_videos", lambda frames, *a, **b: (given.append(frames), job(frames.filter("frame_id < 2"), *a, **b))[1])
    Q.redact_videos(spark, "/root/testdata/sf0.1")
    assert [f.rdd.getNumPartitions() for f in given] == [8, 8]


def test_batches_of_frames_are_resized_as_single_ones():
    rng = np.random.default_rng(13)
    for h, w in ((16, 16), (20, 24), (33, 70), (32, 32)):
        frames = [rng.integers(0, 256, (h, w, (1, 3, 4)[k % 3]), dtype=np.uint8) for k in range(70)]
        want = np.stack([P.resize(P.ensure_rgb(f), 64, 32).transpose(2, 0, 1) for f in frames]).astype(np.float32)
        assert (P.to_network_input(frames, 64, 32) == want).all()


def test_network_input_of_many_frames_takes_seconds(spark):
    """150,000 frames of one row group, in several tasks."""
    began = time.monotonic()
    df = Q.network_input(spark, "/root/testdata/sf0.1")
    assert df.rdd.getNumPartitions() >= 4
    assert df.agg(F.count("*"), F.count_if(F.col("input_sum") > 0)).first() == (150_000, 150_000)
    assert time.monotonic() - began < 60
