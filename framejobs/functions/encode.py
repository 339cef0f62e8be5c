"""Command lines and writer settings, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from framejobs.sources.lookups import PRESET_ENCODERS


def _texts(*values) -> Column:
    return F.array(*(v.cast("string") if isinstance(v, Column) else F.lit(str(v)) for v in values))


def _if(test: Column, *values) -> Column:
    return F.when(test, _texts(*values)).otherwise(F.array().cast("array<string>"))


def _filters(fps: Column, resolution: Column, width: Column, height: Column) -> Column:
    rate = F.when(fps.isNotNull(), F.concat(F.lit("fps="), fps.cast("string")))
    scale = F.when(resolution != "original", F.concat(F.lit("scale="), width.cast("string"), F.lit(":"), height.cast("string")))
    joined = F.array_join(F.array_compact(F.array(rate, scale)), ",")
    return _if(joined != "", "-vf", joined)


def _video(encoder: Column, bitrate: int, preset: str) -> list[Column]:
    return [_texts("-c:v", encoder, "-b:v", f"{bitrate}k", "-threads", 0), _if(encoder.isin(PRESET_ENCODERS), "-preset", preset)]


def encode_args(
    path: Column, output: Column, encoder: Column, source_fps: Column, start_frame: Column, end_frame: Column, fps: Column, resolution: Column,
    width: Column, height: Column, keep_audio: Column, bitrate: int = 1000, preset: str = "fast",
) -> Column:
    """Arguments of one encode. The frame limit is taken from the end that was asked for, not the clipped one."""
    return F.concat(
        _texts("-y", "-hide_banner", "-hwaccel", "auto"),
        _if(start_frame > 0, "-ss", F.try_divide(start_frame.cast("double"), source_fps)),
        _texts("-i", path),
        _if(end_frame >= 0, "-frames:v", end_frame - start_frame),
        _filters(fps, resolution, width, height),
        *_video(encoder, bitrate, preset),
        _if(~keep_audio, "-an"),
        _texts("-progress", "pipe:1", "-nostats", output),
    )


def encode_args_after_redact(
    redacted: Column, encoder: Column, fps: Column, resolution: Column, width: Column, height: Column, bitrate: int = 1000, preset: str = "fast"
) -> Column:
    """Arguments for encoding a redacted file once more: whole, with its audio, to a temporary name."""
    return F.concat(
        _texts("-y", "-hide_banner", "-hwaccel", "auto", "-i", redacted),
        _filters(fps, resolution, width, height),
        *_video(encoder, bitrate, preset),
        _texts(F.concat(redacted, F.lit(".tmp_transcode.mp4"))),
    )


def writer_config(cfg: Column, source_fps: Column, source_bitrate: Column, path: Column, is_cam: Column, keep_audio: Column, preset: str | None = "fast") -> Column:
    """Settings of a writer: the JSON text's, with defaults where it has none; a preset replaces output_params for encoders that take one."""
    given = F.coalesce(F.from_json(cfg, "map<string,string>"), F.create_map().cast("map<string,string>"))
    none = F.create_map().cast("map<string,string>")
    defaults = F.map_concat(
        F.create_map(F.lit("fps"), source_fps.cast("string")),
        F.when(is_cam, none).otherwise(F.create_map(F.lit("bitrate"), F.concat(source_bitrate.cast("string"), F.lit("k")))),
        F.when(keep_audio, F.create_map(F.lit("audio_path"), path, F.lit("audio_codec"), F.lit("copy"))).otherwise(none),
    )
    full = F.map_concat(given, F.map_filter(defaults, lambda k, _: ~F.map_contains_key(given, k)))
    if preset is None:
        return full
    takes = F.coalesce(given["codec"], F.lit("libx264")).isin("libx264", "libx265", "libvpx-vp9")
    preset_map = F.create_map(F.lit("output_params"), F.lit(f"-preset {preset}"))
    return F.when(takes, F.map_concat(F.map_filter(full, lambda k, _: k != "output_params"), preset_map)).otherwise(full)
