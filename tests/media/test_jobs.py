import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from framejobs.functions import media
from framejobs.operators import catalog, detections, frames, pixels, progress, redact
from framejobs.plans import queries as Q
from framejobs.plans.redaction import redact_videos
from framejobs.sources import files, sinks
from framejobs.streaming import jobs as streams


def test_scan_and_raw_frames(spark, tmp_path):
    for n in ("a.mp4", "b.MP4", "c.Mp4", "_d.mp4", ".e.mp4", "f.txt"):
        (tmp_path / n).write_bytes(b"x" * 3)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/g.mp4").write_bytes(b"y")
    names = lambda df: sorted(r.path.rsplit("/", 1)[1] for r in df.collect())
    assert names(files.scan_media(spark, [str(tmp_path)])) == ["_d.mp4", "a.mp4", "b.MP4"]
    assert names(files.scan_media(spark, [str(tmp_path)] * 2, ["mp4"])) == ["_d.mp4", "_d.mp4", "a.mp4", "a.mp4"]
    assert names(files.scan_all_files(spark, [str(tmp_path)])) == [".e.mp4", "_d.mp4", "a.mp4", "b.MP4", "c.Mp4", "f.txt", "sub"]
    raw = np.arange(10 * 8 * 6 * 3, dtype=np.uint32).astype(np.uint8).tobytes()
    (tmp_path / "v.raw").write_bytes(raw + b"stray")
    (tmp_path / "w.raw").write_bytes(b"short")
    got = files.read_raw_frames(spark, [str(tmp_path / "v.raw"), str(tmp_path / "w.raw")], 8, 6).orderBy("frame_id").collect()
    assert [r.frame_id for r in got] == list(range(10)) and b"".join(bytes(r.pixels) for r in got) == raw


def test_images(spark, tmp_path):
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 1, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0" + bytes([1, 2, 3, 250, 5, 6]))) + chunk(b"IEND", b"")
    (tmp_path / "i.png").write_bytes(png)
    r = files.read_images(spark, str(tmp_path)).first()
    assert (r.width, r.height, r.channels, bytes(r.pixels)) == (2, 1, 3, bytes([1, 2, 3, 250, 5, 6]))
    assert files.bgr_to_rgb(bytes([1, 2, 3, 4]), 4) == bytes([3, 2, 1, 4]) and files.bgr_to_rgb(b"ab", 1) == b"ab"


def test_stats_sink_appends(spark, tmp_path):
    rows = [("d1", "a.mp4", 32, 1, 1 / 32), ("d2", "b.mp4", 0, 0, 0.0)]
    df = spark.createDataFrame(rows, "dir string, filename string, total_frames long, face_frames long, face_ratio double")
    for _ in range(2):
        sinks.write_face_stats(df, str(tmp_path / "s"))
    got = sorted(tuple(r) for r in sinks.read_face_stats(spark, str(tmp_path / "s")).select("dir", "filename", "total_frames", "face_frames", "face_ratio").collect())
    assert got == [("d1", "a.mp4", 32, 1, "0.0312")] * 2 + [("d2", "b.mp4", 0, 0, "0.0000")] * 2


def test_catalog_joins(spark):
    jobs = spark.createDataFrame([(1, "hevc", "auto"), (2, "vp9", "nvidia"), (3, "h264", "auto"), (1, "av1", "amd"), (9, "hevc", "auto")], "worker_id long, codec string, gpu string")
    probes = spark.createDataFrame([(1, "intel", 1), (1, "amd", 1), (1, "nvidia", 0), (3, "nvidia", 0), (9, "other", 1)], "worker_id long, gpu string, ok int")
    picked = catalog.pick_gpu(jobs, probes)
    assert {tuple(r) for r in picked.collect()} == {(1, "amd"), (2, "cpu"), (3, "cpu"), (9, "cpu")}
    got = {(r.worker_id, r.codec): r.encoder for r in catalog.resolve_encoder(catalog.resolve_gpu(jobs, picked)).collect()}
    assert got == {(1, "hevc"): "hevc_amf", (2, "vp9"): "libvpx-vp9", (3, "h264"): "libx264", (1, "av1"): "libaom-av1", (9, "hevc"): "libx265"}
    results = spark.createDataFrame([(1, 0, 10, 5.0), (1, 2, 7, 9.0), (2, 1, 3, 1.0)], "b long, rc int, size_bytes long, t double")
    assert {tuple(r) for r in catalog.batch_summary(results, "b", F.col("t"), F.col("t") + 1).collect()} == {(1, 2, 1, 10, 5.0), (2, 1, 1, 0, 1.0)}
    assert catalog.batch_summary(results.limit(0), "b").count() == 0


def test_resampling(spark):
    df = spark.createDataFrame([(1, k, 30.0) for k in range(20)] + [(2, k, 24.0) for k in range(5, 12)], "video_id long, frame_id long, fps double")
    for rate in (7.0, 25.0, 30.0, 60.0):
        got = frames.resample_fps(df.filter("video_id = 1"), F.lit(rate)).orderBy("out_id").collect()
        assert [g.out_id for g in got] == list(range(int(20 * rate / 30 + 0.5)))
        assert [g.frame_id for g in got] == sorted(g.frame_id for g in got)
    gaps = frames.resample_fps(df.filter("video_id = 2"), F.lit(48.0), dense=False).orderBy("out_id").collect()
    assert [g.frame_id for g in gaps] == [k for k in range(5, 12) for _ in range(2)]
    trim = frames.trim_frames(df.filter("video_id = 1"), F.lit(4), F.lit(9), F.lit(60.0)).orderBy("out_id").collect()
    assert [(t.frame_id, t.out_id) for t in trim] == [(4, 0), (4, 1), (5, 2), (5, 3), (6, 4)]
    assert frames.trim_frames(df, F.lit(4), F.lit(3), F.lit(60.0)).count() == 0


def test_suppression_equals_its_twin(spark):
    r = np.random.default_rng(3)
    rows = []
    for f in range(60):
        for k in range(r.integers(0, 12)):
            x, y = r.integers(0, 30, 2)
            rows.append((1, f, k, float(x), float(y), float(x + r.integers(0, 20)), float(y + r.integers(0, 20)), float(r.integers(1, 5)) / 4))
    df = spark.createDataFrame(rows, "video_id long, frame_id long, det_idx int, x1 double, y1 double, x2 double, y2 double, score double")
    got = {(d.frame_id, d.det_idx) for d in detections.nms(df).collect()}
    want = set()
    for f in range(60):
        part = [x for x in rows if x[1] == f]
        if part:
            want |= {(f, part[k][2]) for k in pixels.suppress(np.array([p[3:7] for p in part]), np.array([p[7] for p in part]), 0.3)}
    assert got == want


def test_progress_rows(spark):
    log = spark.createDataFrame([(1, 1, "frame=3"), (1, 2, "x"), (1, 3, "frame=10"), (1, 4, "frame=8"), (2, 1, "nothing")], "job_id long, line_no long, line string")
    got = sorted(((r.job_id, r.line_no, r.frame, r.delta) for r in progress.progress_delta(log, 20).collect()), key=str)
    assert got == sorted([(1, 1, 3, 3), (1, 3, 10, 7), (1, 4, 8, -2), (1, None, 20, 12), (2, None, 20, 20)], key=str)


def test_throttle_across_batches(spark, tmp_path):
    rows = [(s, k, k * 70 + s, k % 13, 12) for s in range(3) for k in range(60)]
    schema = streams.UPDATES
    want = {tuple(r) for r in progress.throttle(spark.createDataFrame(rows, schema)).collect()}
    for part in range(3):
        spark.createDataFrame([r for r in rows if r[1] // 20 == part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        streams.run_available(streams.throttle_stream(source), str(tmp_path / "out"), str(tmp_path / "state"))
    finally:
        spark.conf.unset(key)
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want


def test_redaction_job(spark, tmp_path):
    g = np.random.default_rng(1)
    rows = []
    for k in range(24):
        h, w = (16, 16) if k % 2 else (40, 24)
        a = g.integers(0, 60, (h, w, 3), dtype=np.uint8)
        if k % 3 == 0:
            a[4:12, 4:12] = 250
        rows.append((k % 2, k, h, w, 3, bytes(a.tobytes()), {"k": str(k)}))
    df = spark.createDataFrame(rows, "video_id long, frame_id long, height int, width int, channels int, pixels binary, metadata map<string,string>").repartition(3)
    stats = redact_videos(df, Q.toy_model, str(tmp_path / "out"), str(tmp_path / "stats"), mode="solid", batch=3, threshold=0.8)
    assert {(s.video_id, s.total_frames, s.face_frames) for s in stats.collect()} == {(0, 12, 4), (1, 12, 4)}
    before = {r[1]: r for r in rows}
    for r in spark.read.parquet(str(tmp_path / "out")).collect():
        a, b = (np.frombuffer(x, np.uint8).reshape(r.height, r.width, 3) for x in (before[r.frame_id][5], bytes(r.pixels)))
        assert r.metadata == {"k": str(r.frame_id)} and (len(r.boxes) > 0) == (r.frame_id % 3 == 0)
        covered = (b == 0).all(axis=2)
        assert (a[~covered] == b[~covered]).all() and (not r.boxes or covered[5:11, 5:11].all())
    sinks.write_redacted(df, str(tmp_path / "plain"), keep_metadata=False)
    assert "metadata" not in spark.read.parquet(str(tmp_path / "plain")).columns
    small = redact.resize_frames(df, 4, 4).collect()
    assert {(r.width, r.height, len(r.pixels)) for r in small} == {(4, 4, 48)}


def stream_of(spark, folder, schema, parts):
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/{n}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")


def test_telemetry_across_batches_and_late_rows(spark, tmp_path):
    """State is carried over batches; a row that comes before the watermark counts, one behind it does not."""
    from datetime import UTC, datetime

    at = lambda t: datetime.fromtimestamp(1_700_000_000 + t, UTC)
    schema = "sample_id long, ts timestamp, host_id long, proc_name string, cpu_percent double, cpu_total double, mem_used long, mem_total long, gpu_csv string"
    row = lambda k, t, host=1, cpu=10.0: (k, at(t), host, "ffmpeg", cpu, 50.0 + k, k, 100, f"{k}, 1, 2, 3")
    parts = [[row(1, 0), row(2, 1)], [row(3, 0), row(4, 9, cpu=5.0)], [row(5, 40), row(6, 41, host=2)], [row(8, 90)], [row(7, 2, cpu=99.0), row(9, 200)]]
    out = streams.telemetry_stream(stream_of(spark, tmp_path, schema, parts), "10 seconds", "20 seconds")
    streams.run_available(out, f"{tmp_path}/out", f"{tmp_path}/state")
    got = sorted((r.host_id, r.tick - 1_700_000_000, r.ffmpeg_cpu, r.mem_used) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    counted = [r for p in parts for r in p if r[0] != 7]
    batch = progress.host_tick(spark.createDataFrame(counted, schema).withColumn("seconds", F.unix_seconds("ts")), 10)
    assert got == sorted((r.host_id, r.tick - 1_700_000_000, r.ffmpeg_cpu, r.mem_used) for r in batch.collect() if r.tick - 1_700_000_000 < 180)


@pytest.mark.parametrize("late", [None, "1 hour"])
def test_progress_across_batches(spark, tmp_path, late):
    from datetime import datetime

    schema = "job_id long, line_no long, ts timestamp, seconds long, line string"
    rows = [(j, k, datetime(2024, 1, 1, 10, 0, k), k, f"frame={k * 5 - j}" if (j + k) % 4 else "x") for j in range(3) for k in range(30)]
    parts = [[r for r in rows if r[1] % 3 == n] for n in (2, 0, 1)]
    path = str(tmp_path)
    out = streams.progress_stream(stream_of(spark, tmp_path, schema, parts), 200, late)
    update = lambda df, epoch: df.write.mode("overwrite").parquet(f"{path}/out/epoch={epoch}")
    out.writeStream.foreachBatch(update).outputMode("update").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(f"{path}/out").groupBy("job_id").agg(F.max_by(F.struct("frame", "elapsed", "done"), "epoch").alias("r")).select("job_id", "r.*")
    want = progress.latest_progress(spark.createDataFrame(rows, schema), 200).select("job_id", "frame", "elapsed", "done")
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, want.collect()))


def test_throttle_drops_rows_without_session(spark):
    rows = [(1, 1, 0, 0, 9), (None, 1, 5, 0, 9), (1, 2, 10, 0, 9)]
    assert [r.seq for r in progress.throttle(spark.createDataFrame(rows, streams.UPDATES)).collect()] == [1]


def test_nulls_and_clashing_names(spark):
    schema = "video_id long, frame_id long, height int, width int, channels int, pixels binary, boxes array<struct<det_idx: int, x1: double, y1: double, x2: double, y2: double>>"
    pixels_ = bytes(range(48))
    rows = [(1, 0, 4, 4, 3, None, [(0, 0.0, 0.0, 2.0, 2.0)]), (1, 1, 4, 4, 3, pixels_, [(None, None, 0.0, 2.0, 2.0), (0, 1.0, None, 2.0, 2.0)]), (1, 2, 4, 4, 3, pixels_, None)]
    df = spark.createDataFrame(rows, schema)
    assert [r.pixels and bytes(r.pixels) for r in redact.redact_frames(df, "solid").orderBy("frame_id").collect()] == [None, pixels_, pixels_]
    assert [r.pixels is None for r in redact.resize_frames(df, 2, 2).orderBy("frame_id").collect()] == [True, False, False]
    assert [r.pixels is None for r in redact.rgb_frames(df).orderBy("frame_id").collect()] == [True, False, False]
    assert redact.score_frames(df, Q.toy_model).orderBy("frame_id").first().boxes == []
    paths = spark.createDataFrame([(1, "a"), (2, None), (3, "b"), (4, "a"), (5, None)], "id long, output_path string")
    assert sorted((r.id, r.collides) for r in catalog.with_collisions(paths).collect()) == [(1, True), (2, False), (3, False), (4, True), (5, False)]
    named = spark.createDataFrame([("/a/x.jpeg", 1, "mine", "own", "480p", 7, 8, 1, 2)], "path string, is_file int, ext string, mime string, resolution string, width int, height int, out_width int, out_height int")
    r = media.target_size(media.classify_media(named)).first()
    assert (r.file_type, r.ext, r.mime, r.out_width, r.out_height) == ("image", "mine", "own", 854, 480)
