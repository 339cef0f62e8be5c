"""Listing of every entry, and raw files beyond two gigabytes."""

import os

import numpy as np
from pyspark.sql import functions as F

from framejobs.functions import media
from framejobs.sources import files


def names(df):
    return sorted(r.path.rsplit("/", 1)[1] for r in df.collect())


def test_hidden_marked_and_empty_files(spark, tmp_path):
    for n in ("a.mp4", "_b.mp4", ".c.mp4"):
        (tmp_path / n).write_bytes(b"xyz")
    (tmp_path / "e.mp4").touch()
    (tmp_path / "deep.mp4").mkdir()
    (tmp_path / "deep.mp4/in.mp4").write_bytes(b"x")
    root = str(tmp_path)
    everything = files.scan_all_files(spark, [root])
    assert sorted((r.path, r.size_bytes, r.is_file) for r in everything.collect()) == sorted(
        [(f"{root}/{n}", 3, 1) for n in ("a.mp4", "_b.mp4", ".c.mp4")] + [(f"{root}/e.mp4", 0, 1), (f"{root}/deep.mp4", None, 0)]
    )
    assert {r.path.rsplit("/", 1)[1]: r.file_type for r in media.classify_media(everything).collect()}["deep.mp4"] == "notfound"
    assert names(files.scan_media(spark, [root])) == ["_b.mp4", "a.mp4", "e.mp4"]
    assert names(files.scan_media(spark, [f"file://{root}"], hidden=True)) == [".c.mp4", "_b.mp4", "a.mp4", "e.mp4"]


def test_patterns_files_and_what_is_not_there(spark, tmp_path):
    for n in ("a b.mp4", "c%20d.txt", "[x].mp4", ".y.mp4"):
        (tmp_path / n).write_bytes(b"1")
    root = str(tmp_path)
    assert names(files.scan_media(spark, [f"{root}/*.mp4", f"{root}/c%20d.txt", f"{root}/no.mp4", f"{root}/none/*.mp4"])) == ["[x].mp4", "a b.mp4", "c%20d.txt"]
    assert names(files.scan_media(spark, [f"{root}/[x].mp4"])) == ["[x].mp4"]
    assert [(r.path, r.size_bytes, r.is_file) for r in files.scan_all_files(spark, ["<video0>", f"{root}/no.mp4"]).orderBy("path").collect()] == [
        (f"{root}/no.mp4", None, 0),
        ("<video0>", None, 0),
    ]
    assert files.scan_media(spark, [root] * 3).count() == 6


def test_frames_across_ranges(spark, tmp_path):
    size = 8 * 6 * 3
    rng = np.random.default_rng(1)
    data = {n: rng.integers(0, 256, size * frames + extra, dtype=np.uint8).tobytes() for n, frames, extra in (("a.raw", 25, 7), ("b.raw", 10, 0), ("c.raw", 0, 5), (".d.raw", 1, 0))}
    for n, d in data.items():
        (tmp_path / n).write_bytes(d)
    df = files.read_raw_frames(spark, str(tmp_path), 8, 6, range_bytes=size * 4)
    got = {(r.path.rsplit("/", 1)[1], r.frame_id): bytes(r.pixels) for r in df.collect()}
    assert got == {(n, k): d[k * size : (k + 1) * size] for n, d in data.items() for k in range(len(d) // size)}
    assert df.rdd.getNumPartitions() == 7 + 3 + 1


def test_a_file_of_five_gigabytes_is_read_by_many_tasks(spark, tmp_path):
    w, h, frames = 1920, 1080, 5 * 10**9 // (1920 * 1080 * 3)
    path, size = str(tmp_path / "big.raw"), 1920 * 1080 * 3
    with open(path, "wb") as f:
        f.truncate(frames * size + 1000)  # a sparse file with a partial frame at its end
        for k in (0, frames // 2, frames - 1):
            f.seek(k * size)
            f.write(bytes([k % 251 + 1]))
    df = files.read_raw_frames(spark, path, w, h)
    got = df.select("frame_id", F.spark_partition_id().alias("task"), F.octet_length("pixels").alias("n"), F.hex(F.substring("pixels", 1, 1)).alias("first")).toPandas()
    assert sorted(got["frame_id"]) == list(range(frames)) and set(got["n"]) == {size} and got["task"].nunique() >= 15
    marked = got[got["first"] != "00"]
    assert dict(zip(marked["frame_id"], marked["first"], strict=True)) == {k: f"{k % 251 + 1:02X}" for k in (0, frames // 2, frames - 1)}
    os.remove(path)
