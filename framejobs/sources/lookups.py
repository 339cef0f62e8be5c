"""Fixed tables that the jobs join with. Their sizes are fixed, so they are broadcast."""

from __future__ import annotations

from mimetypes import MimeTypes

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: (extension, MIME type) as Python registers them, whatever the machine's own tables say; other extensions are unknown.
MIME = sorted((e.removeprefix("."), t) for e, t in MimeTypes().types_map[True].items())
# Fixed values.
#: (codec, gpu, encoder)
ENCODERS = [
    ("hevc", "nvidia", "hevc_nvenc"),
    ("hevc", "amd", "hevc_amf"),
    ("hevc", "intel", "hevc_qsv"),
    ("hevc", "cpu", "libx265"),
    ("h264", "nvidia", "h264_nvenc"),
    ("h264", "amd", "h264_amf"),
    ("h264", "intel", "h264_qsv"),
    ("h264", "cpu", "libx264"),
    ("vp9", "cpu", "libvpx-vp9"),
    ("av1", "cpu", "libaom-av1"),
]
#: (resolution, width, height)
RESOLUTIONS = [("480p", 854, 480), ("720p", 1280, 720), ("1080p", 1920, 1080), ("4k", 3840, 2160)]
#: Extensions of input videos, as they are written, for the command line and for the desktop tool.
VIDEO_EXTENSIONS = ["mp4", "MP4", "mov", "MOV", "avi", "AVI", "mkv"]
VIDEO_EXTENSIONS_GUI = [*VIDEO_EXTENSIONS, "MKV"]
#: Encoders that take a preset; vendors in the order in which they are preferred.
PRESET_ENCODERS = ["libx265", "libx264", "libvpx-vp9"]
GPU_ORDER = ["nvidia", "amd", "intel"]


def encoders(spark: SparkSession) -> DataFrame:
    return F.broadcast(spark.createDataFrame(ENCODERS, "codec string, gpu string, encoder string"))


def resolutions(spark: SparkSession) -> DataFrame:
    return F.broadcast(spark.createDataFrame(RESOLUTIONS, "resolution string, out_width int, out_height int"))


def mime_types(spark: SparkSession, table: list[tuple[str, str]] | None = None) -> DataFrame:
    return F.broadcast(spark.createDataFrame(MIME if table is None else table, "ext string, mime string"))
