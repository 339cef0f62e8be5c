"""Columns of a media catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framejobs.sources.lookups import mime_types, resolutions

_EXTENSION = r"[^/.][^/]*\.([^./]*)$"


def extension(path: Column) -> Column:
    """Without its dot, case kept; empty if there is none. A leading dot begins a name, not an extension."""
    return F.regexp_extract(path, _EXTENSION, 1)


def folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def stem(path: Column) -> Column:
    """The file name without its folder and extension."""
    return F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"^([^.].*)\.[^.]*$", "$1")


def join_path(where: Column, name: Column) -> Column:
    return F.when(where == "", name).otherwise(F.concat_ws("/", where, name))


def classify_media(df: DataFrame, table: list[tuple[str, str]] | None = None) -> DataFrame:
    """Adds file_type (cam, notfound, video, image, another MIME type, or null), route and skip_reason."""
    known = mime_types(df.sparkSession, table).select(F.col("ext").alias("_ext"), F.col("mime").alias("_mime"))
    typed = df.withColumn("_ext", F.lower(extension(F.col("path")))).join(F.broadcast(known), "_ext", "left")
    kind = (
        F.when(F.col("path").startswith("<video"), "cam").when(F.col("is_file") == 0, "notfound").when(F.col("_mime").isNull(), F.lit(None))
        .when(F.col("_mime").startswith("video"), "video").when(F.col("_mime").startswith("image"), "image").otherwise(F.col("_mime"))
    )
    typed = typed.withColumn("file_type", kind).drop("_ext", "_mime")
    goes = F.coalesce(F.col("file_type").isin("video", "cam", "image"), F.lit(False))
    reason = F.when(goes, F.lit(None)).when(F.col("file_type") == "notfound", "not_found").when(F.col("file_type").isNull(), "unknown_type").otherwise("unsupported_type")
    return typed.withColumn("route", F.when(goes, F.col("file_type")).otherwise("skip")).withColumn("skip_reason", reason)


def _bitrate(size: Column, duration: Column) -> Column:
    return F.when(duration > 0, F.try_divide(F.try_divide(size * 8, duration), F.lit(1000)).cast("long")).otherwise(0)


def probe_columns(df: DataFrame, default_fps: float = 25.0) -> DataFrame:
    """Adds duration, bitrate (kbps) and format, with a default where fps is 0."""
    fps = F.when(F.col("fps") == 0, default_fps).otherwise(F.col("fps"))
    out = df.withColumn("fps", fps).withColumn("duration", F.col("frame_count") / F.col("fps"))
    return out.withColumn("bitrate", _bitrate(F.col("size_bytes"), F.col("duration"))).withColumn("format", extension(F.col("path")))


def probe_columns_strict(df: DataFrame) -> DataFrame:
    """Adds duration and bitrate; both are 0 where fps is not positive."""
    duration = F.when(F.col("fps") > 0, F.try_divide(F.col("frame_count").cast("double"), F.col("fps"))).otherwise(F.lit(0.0))
    out = df.withColumn("duration", duration)
    return out.withColumn("bitrate", _bitrate(F.col("size_bytes"), F.col("duration")))


def fourcc_text(code: Column) -> Column:
    """Four characters of a little-endian integer, stripped."""
    return F.trim(F.concat(*(F.chr(F.shiftright(code, 8 * i).bitwiseAND(255).cast("long")) for i in range(4))))


def frame_range(df: DataFrame) -> DataFrame:
    """Adds first, last (after the last frame, clipped), n_frames and status."""
    last = F.when(F.col("end_frame") < 0, F.col("frame_count")).otherwise(F.least("end_frame", "frame_count"))
    out = df.withColumn("first", F.col("start_frame")).withColumn("last", last).withColumn("n_frames", last - F.col("start_frame"))
    return out.withColumn("status", F.when(F.col("n_frames") > 0, "ok").otherwise("invalid_range"))


def output_path(path: Column, first: Column, last: Column, end_frame: Column, fmt: str = "mp4", output: str | None = None, output_is_folder: bool = True) -> Column:
    """Where an encode goes. An explicit output that is no folder is used as it is."""
    if output and not output_is_folder:
        return F.lit(output)
    part = F.concat(F.lit("_"), first.cast("string"), F.lit("_"), last.cast("string"), F.lit("_compress"))
    suffix = F.when((first != 0) | (end_frame >= 0), part).otherwise("_full_compress")
    return join_path(F.lit(output) if output else folder(path), F.concat(stem(path), suffix, F.lit(f".{fmt}")))


def output_folder_gui(path: Column) -> Column:
    """The desktop tool's output folder, beside the inputs."""
    return join_path(folder(path), F.lit("trans"))


def output_path_redacted(path: Column, file_type: Column) -> Column:
    """Beside the input; none for cameras."""
    name = F.when(extension(path) == "", F.concat(path, F.lit("_anonymized"))).otherwise(F.regexp_replace(path, r"(\.[^./]*)$", "_anonymized$1"))
    return F.when(file_type == "cam", F.lit(None)).otherwise(name)


def target_size(df: DataFrame) -> DataFrame:
    """Adds out_width and out_height (in place of columns of these names): those of the named resolution, or the source's."""
    named = resolutions(df.sparkSession).select("resolution", F.col("out_width").alias("_w"), F.col("out_height").alias("_h"))
    joined = df.join(F.broadcast(named), "resolution", "left")
    return joined.withColumn("out_width", F.coalesce("_w", "width")).withColumn("out_height", F.coalesce("_h", "height")).drop("_w", "_h")


def parse_size(text: Column) -> tuple[Column, Column]:
    """Width and height of a text such as 640x360."""
    parts = F.split(text, "x")
    return F.try_element_at(parts, F.lit(1)).try_cast("int"), F.try_element_at(parts, F.lit(2)).try_cast("int")


def network_size(width: Column, height: Column) -> list[Column]:
    """net_width and net_height, multiples of 32, and the scales of the two axes."""
    w, h = (F.ceil(x / 32) * 32 for x in (width, height))
    return [w.cast("int").alias("net_width"), h.cast("int").alias("net_height"), (w / width).alias("scale_w"), (h / height).alias("scale_h")]
