"""Listing and reading media files."""

from __future__ import annotations

import re
from fnmatch import fnmatchcase

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framejobs.functions.media import extension
from framejobs.sources.lookups import VIDEO_EXTENSIONS

ENTRIES = "n int, path string, size_bytes long, is_file int, given int"
FRAMES = "path string, frame_id long, height int, width int, pixels binary"
#: Bytes of frames that one task reads from a file, and that it hands over at once.
RANGE_BYTES, BATCH_BYTES = 256 << 20, 8 << 20


def locate(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, as seen from a task, and the path in it. Names are taken as they are, without decoding."""
    if m := re.match(r"(?!file:)([A-Za-z][A-Za-z0-9+.-]+)://([^/]*)(.*)$", path):
        where, root = fs.FileSystem.from_uri(f"{m[1]}://{m[2]}/")
        return where, root.rstrip("/") + (m[3] if m[3] else "/")
    return fs.LocalFileSystem(), re.sub("^file:/*", "/", path)


def list_entries(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(n, path, size_bytes, is_file, given) of what each of some paths names, n its number in the list.

    Of a folder all entries are listed, hidden and empty ones and subfolders (is_file 0, without size) too. A pattern in the last part of a path names
    what matches it, dot files left out; other paths name themselves, with is_file 0 if there is no such file. ``given`` is 0 for entries of folders.
    Tasks list folders side by side; a path that is given twice is listed twice.
    """

    def run(batches):
        for b in batches:
            for n, path in zip(b.column("n").to_pylist(), b.column("path").to_pylist(), strict=True):
                where, inside = locate(path)
                folder, _, last = path.rpartition("/")
                info = where.get_file_info(inside)
                if info.type == fs.FileType.Directory:
                    found = [(f"{path.rstrip('/')}/{e.base_name}", e, 0) for e in where.get_file_info(fs.FileSelector(inside))]
                elif info.type == fs.FileType.NotFound and re.search(r"[*?[]", last):
                    above = where.get_file_info(fs.FileSelector(inside.rpartition("/")[0] or "/", allow_not_found=True))
                    found = [(f"{folder}/{e.base_name}", e, 1) for e in above if fnmatchcase(e.base_name, last) and (last[0] == "." or e.base_name[0] != ".")]
                else:
                    found = [(path, info, 1)]
                for s in range(0, len(found), 10_000):
                    part = found[s : s + 10_000]
                    columns = [[n] * len(part), [p for p, _, _ in part], [e.size if e.is_file else None for _, e, _ in part], [int(e.is_file) for _, e, _ in part], [g for _, _, g in part]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["n", "path", "size_bytes", "is_file", "given"])

    asked = spark.createDataFrame(list(enumerate(paths)), "n int, path string")
    return asked.repartition(max(1, min(len(paths), 1000)), "n").mapInArrow(run, ENTRIES)


def scan_media(spark: SparkSession, folders: list[str], extensions: list[str] = VIDEO_EXTENSIONS, hidden: bool = False) -> DataFrame:
    """(path, size_bytes) of the files of folders with one of the extensions, as written, subfolders left out; of files and patterns that are given
    instead of folders, whatever their extension. Empty files are files; dot files are listed if ``hidden``. A folder that is given twice is listed
    twice."""
    found = list_entries(spark, folders).filter("is_file = 1")
    wanted = extension(F.col("path")).isin(extensions)
    if not hidden:
        wanted &= ~F.col("path").rlike(r"/\.[^/]*$")
    return found.filter((F.col("given") == 1) | wanted).select("path", "size_bytes")


def scan_all_files(spark: SparkSession, folders: list[str]) -> DataFrame:
    """(path, size_bytes, is_file) of all entries of folders, and of the paths that are no folders, be they there or not (is_file 0); what they are is
    decided by classify_media."""
    return list_entries(spark, folders).select("path", "size_bytes", "is_file")


def raw_frames(df: DataFrame, content: str, width: Column, height: Column, *keys: str) -> DataFrame:
    """Frames of raw rgb24 streams in a binary column: keys, frame_id, height, width, pixels. A last partial frame is dropped."""
    size = width * height * 3
    n = F.floor(F.octet_length(content) / size).cast("long")
    ids = F.explode(F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<long>")))
    cut = df.select(*keys, F.col(content).alias("_content"), height.cast("int").alias("height"), width.cast("int").alias("width"), ids.alias("frame_id"))
    start = (F.col("frame_id") * F.col("width") * F.col("height") * 3 + 1).cast("int")
    pixels = F.substring("_content", start, F.col("width") * F.col("height") * 3)
    return cut.select(*keys, "frame_id", "height", "width", pixels.alias("pixels"))


def read_raw_frames(spark: SparkSession, paths: str | list[str], width: int, height: int, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Frames of raw rgb24 files of any size: path, frame_id, height, width, pixels. A last partial frame is dropped, and so is what a file loses while it
    is read. Files are cut into ranges of whole frames; each is read by a task of its own, a few frames at a time."""
    size = width * height * 3
    step = max(1, range_bytes // size)
    files = list_entries(spark, [paths] if isinstance(paths, str) else paths).filter("is_file = 1").withColumn("frames", F.floor(F.col("size_bytes") / size).cast("long"))
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("frames") - 1, F.lit(step).cast("long")))
    ranges = files.filter("frames > 0").select("path", "frames", starts.alias("first")).select("path", "first", F.least(F.lit(step), F.col("frames") - F.col("first")).alias("count"))

    def read(batches):
        at_once = max(1, BATCH_BYTES // size)
        for b in batches:
            for path, first, count in zip(*(b.column(c).to_pylist() for c in ("path", "first", "count")), strict=True):
                where, inside = locate(path)
                with where.open_input_file(inside) as f:
                    f.seek(first * size)
                    for s in range(first, first + count, at_once):
                        data = f.read(size * min(at_once, first + count - s))
                        n = len(data) // size
                        pixels = [data[k * size : (k + 1) * size] for k in range(n)]
                        columns = [[path] * n, range(s, s + n), [height] * n, [width] * n, pixels]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["path", "frame_id", "height", "width", "pixels"])
                        if n < min(at_once, first + count - s):
                            break

    return ranges.repartition(max(1, min(ranges.count(), 20_000))).mapInArrow(read, FRAMES)


def read_images(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Decoded images: path, height, width, channels, pixels in RGB(A) order; what cannot be decoded is left out."""
    df = spark.read.format("image").option("dropInvalid", True).load(paths)
    df = df.select(F.col("image.origin").alias("path"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("pixels"))

    def swap(frames):
        for f in frames:
            f["pixels"] = [bgr_to_rgb(p, c) for p, c in zip(f["pixels"], f["channels"], strict=True)]
            yield pd.DataFrame(f)

    return df.mapInPandas(swap, df.schema)


def bgr_to_rgb(pixels: bytes, channels: int) -> bytes:
    if channels < 3:
        return bytes(pixels)
    a = np.frombuffer(pixels, dtype=np.uint8).reshape(-1, channels)
    return a[:, [2, 1, 0, *range(3, channels)]].tobytes()
