import math

import pytest
from pyspark.sql import functions as F

from framejobs.functions import boxes, encode, media, progress, telemetry


def one(df):
    return [tuple(r) for r in df.collect()]


def test_classify_and_paths(spark):
    rows = [("<video0>", 1), ("/a/x.MP4", 1), ("/a/x.mp4", 0), ("/a/x.mkv", 1), ("/a/x.txt", 1), ("/a/noext", 1), ("/a/.mp4", 1), ("/a/x.jpg.gz", 1), ("x.png", 1)]
    df = media.classify_media(spark.createDataFrame(rows, "path string, is_file int"))
    got = {r.path: (r.file_type, r.route, r.skip_reason) for r in df.filter("path <> '/a/x.mp4'").collect()}
    assert got["<video0>"] == ("cam", "cam", None) and got["/a/x.MP4"] == ("video", "video", None) and got["x.png"] == ("image", "image", None)
    assert got["/a/x.txt"] == ("text/plain", "skip", "unsupported_type")
    for p in ("/a/x.mkv", "/a/noext", "/a/.mp4", "/a/x.jpg.gz"):
        assert got[p] == (None, "skip", "unknown_type")
    assert one(df.filter("path = '/a/x.mp4'").select("file_type", "skip_reason")) == [("notfound", "not_found")]
    assert one(media.classify_media(spark.createDataFrame([("a.mkv", 1)], "path string, is_file int"), [("mkv", "video/x-matroska")]).select("file_type")) == [("video",)]
    paths = spark.createDataFrame([("/a/b.c/x.y.mp4",), ("x",), ("/a/.hid",), ("/a/x.",)], "path string")
    assert one(paths.select(media.folder(F.col("path")), media.stem(F.col("path")), media.extension(F.col("path")))) == [("/a/b.c", "x.y", "mp4"), ("", "x", ""), ("/a", ".hid", ""), ("/a", "x", "")]
    red = paths.select(media.output_path_redacted(F.col("path"), F.lit("video")))
    assert one(red)[:2] == [("/a/b.c/x.y_anonymized.mp4",), ("x_anonymized",)]


def test_probe_edges(spark):
    df = spark.createDataFrame([(0.0, 100, 10_000, "a.MP4"), (25.0, 0, 10_000, "b"), (-1.0, 50, 10, "c.x")], "fps double, frame_count long, size_bytes long, path string")
    assert one(media.probe_columns(df).select("fps", "duration", "bitrate", "format")) == [(25.0, 4.0, 20, "MP4"), (25.0, 0.0, 0, ""), (-1.0, -50.0, 0, "x")]
    assert one(media.probe_columns_strict(df).select("duration", "bitrate")) == [(0.0, 0), (0.0, 0), (0.0, 0)]
    assert one(spark.range(1).select(media.fourcc_text(F.lit(875967080)), media.fourcc_text(F.lit(0x20637661)))) == [("h264", "avc")]


def test_ranges(spark):
    df = spark.createDataFrame([(0, -1, 10), (5, 3, 10), (2, 50, 10), (9, 9, 10)], "start_frame long, end_frame long, frame_count long")
    got = media.frame_range(df)
    assert one(got.select("first", "last", "n_frames", "status")) == [(0, 10, 10, "ok"), (5, 3, -2, "invalid_range"), (2, 10, 8, "ok"), (9, 9, 0, "invalid_range")]
    out = media.output_path(F.lit("/v/clip.mov"), F.col("first"), F.col("last"), F.col("end_frame"), "mkv")
    assert one(got.select(out)) == [("/v/clip_full_compress.mkv",), ("/v/clip_5_3_compress.mkv",), ("/v/clip_2_10_compress.mkv",), ("/v/clip_9_9_compress.mkv",)]
    fixed = media.output_path(F.lit("/v/clip.mov"), F.col("first"), F.col("last"), F.col("end_frame"), output="/o/all.mp4", output_is_folder=False)
    assert {r[0] for r in one(got.select(fixed))} == {"/o/all.mp4"}


def test_commands(spark):
    df = spark.range(1)
    args = lambda fps, res, end, enc: df.select(encode.encode_args(F.lit("in"), F.lit("out"), F.lit(enc), F.lit(25.0), F.lit(50), F.lit(end), F.lit(fps).cast("double"), F.lit(res), F.lit(854), F.lit(480), F.lit(False), 900, "slow")).first()[0]
    assert args(None, "original", -1, "hevc_nvenc") == "-y -hide_banner -hwaccel auto -ss 2.0 -i in -c:v hevc_nvenc -b:v 900k -threads 0 -an -progress pipe:1 -nostats out".split()
    assert args(12.0, "480p", 80, "libx265") == "-y -hide_banner -hwaccel auto -ss 2.0 -i in -frames:v 30 -vf fps=12.0,scale=854:480 -c:v libx265 -b:v 900k -threads 0 -preset slow -an -progress pipe:1 -nostats out".split()
    again = df.select(encode.encode_args_after_redact(F.lit("r.mp4"), F.lit("libaom-av1"), F.lit(None).cast("double"), F.lit("original"), F.lit(1), F.lit(1))).first()[0]
    assert again == "-y -hide_banner -hwaccel auto -i r.mp4 -c:v libaom-av1 -b:v 1000k -threads 0 r.mp4.tmp_transcode.mp4".split()


def test_writer_config(spark):
    get = lambda cfg, cam, audio, preset="fast": spark.range(1).select(encode.writer_config(F.lit(cfg).cast("string"), F.lit(24.0), F.lit(700), F.lit("p"), F.lit(cam), F.lit(audio), preset)).first()[0]
    assert get(None, False, False) == {"fps": "24.0", "bitrate": "700k", "output_params": "-preset fast"}
    assert get('{"codec":"hevc_nvenc","output_params":"x"}', True, True) == {"codec": "hevc_nvenc", "output_params": "x", "fps": "24.0", "audio_path": "p", "audio_codec": "copy"}
    assert get('{"codec":"libx264","output_params":"x","fps":"5"}', True, False) == {"codec": "libx264", "fps": "5", "output_params": "-preset fast"}
    assert get("{}", True, False, None) == {"fps": "24.0"}


def test_progress_columns(spark):
    lines = ["frame=12", "frame=  7 ", "frame=", "frame=N/A", "", "frame=12=3", "fps=3", "xframe=1", "frame=1e3"]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    assert [r[0] for r in one(df.select(progress.parse_progress(F.col("line"))))] == [12, 7, None, None, None, 12, None, None, None]
    text = spark.createDataFrame([("\x1b[1;32mok\x1b[0m\r",), ("\x1b[K\r",), ("plain",)], "t string")
    assert [r[0] for r in one(text.select(progress.strip_ansi(F.col("t"))))] == ["ok", None, "plain"]
    times = spark.createDataFrame([(0.0,), (59.9,), (3600.0,), (60_000.5,), (-1.0,), (float("inf"),), (float("nan"),), (None,)], "s double")
    assert [r[0] for r in one(times.select(progress.fmt_duration(F.col("s"))))] == ["00:00", "00:59", "60:00", "1000:00", "--:--", "--:--", "--:--", "--:--"]
    assert one(spark.range(1).select(progress.eta(F.lit(10.0), F.lit(4), F.lit(10)), progress.eta(F.lit(1.0), F.lit(0), F.lit(5)), progress.eta_by_frame(F.lit(8.0), F.lit(3), F.lit(10)), progress.eta_by_frame(F.lit(8.0), F.lit(0), F.lit(10)))) == [(15.0, math.inf, 12.0, 0.0)]


def test_telemetry_columns(spark):
    lines = ["12, 5, 100, 24000", " 1, 2, 3, 4\n", "1, 2, 3", "1, 2, 3, 4, 5", "a, 2, 3, 4", None, "1,2,3,4"]
    got = [r[0] for r in one(spark.createDataFrame([(x,) for x in lines], "l string").select(telemetry.parse_gpu_csv(F.col("l"))))]
    assert [tuple(g) if g else None for g in got] == [(12, 5, 100, 24000), (1, 2, 3, 4), None, None, None, None, None]
    b = lambda g, c, f: telemetry.bottleneck(F.lit(g).cast("int"), F.lit(c), F.lit(f))
    assert one(spark.range(1).select(b(None, 99.0, 99.0), b(29, 61.0, 99.0), b(29, 60.0, 41.0), b(81, 99.0, 99.0), b(80, 99.0, 99.0), b(30, 99.0, 99.0))) == [("gpu_missing", "cpu", "decode", "gpu_saturated", "balanced", "balanced")]
    assert one(spark.range(1).select(telemetry.util_bar(F.lit(0)), telemetry.util_bar(F.lit(54.9)), telemetry.util_bar(F.lit(100)), telemetry.util_bar(F.lit(120)))) == [("." * 20, "#" * 10 + "." * 10, "#" * 20, "#" * 24)]


def test_box_columns(spark):
    cells = [(0, 0, 0.2, 0.0, 0.0, 0.0, 0.0), (0, 0, 0.9, math.log(2.0), math.log(3.0), 0.5, 0.5), (7, 7, 0.5, 3.0, 3.0, 0.5, 0.5)]
    df = spark.createDataFrame([(1, 1, *c, [0.5] * 10) for c in cells], "video_id long, frame_id long, cell_y int, cell_x int, heat double, scale0 double, scale1 double, off0 double, off1 double, lm array<double>")
    got = boxes.decode_landmarks(boxes.decode_boxes(df, 32, 32)).collect()
    assert len(got) == 2 and [round(v, 6) for v in (got[0].x1, got[0].y1, got[0].x2, got[0].y2)] == [0.0, 0.0, 12.0, 8.0]
    assert [round(v, 6) for v in got[0].landmarks[:2]] == [6.0, 4.0] and max(got[1].x2, got[1].y2) <= 32
    half = boxes.rescale_boxes(spark.createDataFrame([(2.0, 4.0, 6.0, 8.0, [2.0, 4.0])], "x1 double, y1 double, x2 double, y2 double, landmarks array<double>"), F.lit(2.0), F.lit(4.0))
    assert one(half) == [(1.0, 1.0, 3.0, 2.0, [1.0, 1.0])]
    grow = spark.createDataFrame([(10.9, 10.0, 15.0, 20.0), (-3.5, 2.0, 1.0, 4.0), (90.0, 90.0, 120.0, 99.0), (0.0, 0.0, 5.0, 5.0)], "x1 double, y1 double, x2 double, y2 double")
    assert one(boxes.grow_clip_box(grow, F.lit(100), F.lit(100), 1.5).select("gx1", "gy1", "gx2", "gy2")) == [(8, 5, 18, 25), (0, 1, 3, 5), (75, 86, 99, 99), (0, 0, 8, 8)]


@pytest.mark.parametrize("name", ["parse_size"])
def test_sizes(spark, name):
    w, h = media.parse_size(F.col("t"))
    assert one(spark.createDataFrame([("640x360",), ("bad",)], "t string").select(w, h)) == [(640, 360), (None, None)]
    assert one(spark.range(1).select(*media.network_size(F.lit(33), F.lit(64)))) == [(64, 64, 64 / 33, 1.0)]
