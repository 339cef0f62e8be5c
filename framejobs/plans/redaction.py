"""Whole jobs, from input tables to sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framejobs.functions import media
from framejobs.functions.encode import encode_args, encode_args_after_redact
from framejobs.operators.catalog import pick_gpu, resolve_encoder, resolve_gpu
from framejobs.operators.redact import redact_frames, score_frames
from framejobs.sources.sinks import write_face_stats, write_redacted


def redact_videos(frames: DataFrame, model_fn, out: str, stats_root: str | None = None, mode: str = "blur", batch: int = 8, threshold: float = 0.2, **options) -> DataFrame:
    """Scores and redacts all frames into ``out``; returns, and optionally appends to ``stats_root``, the face statistics of the videos.

    What is written goes to a folder of its own for each run, and the statistics are read from the box counts there, so that no frame is scored twice
    and those of earlier runs are not counted. With a column ``path``, the source's, statistics go to its folder under its file's name, and cameras,
    whose path begins with <video, are redacted but have no statistics; without one a name is made from video_id."""
    spark, run = frames.sparkSession, uuid.uuid4().hex
    write_redacted(redact_frames(score_frames(frames, model_fn, batch, threshold), mode, **options), f"{out}/run={run}")
    written = spark.read.parquet(f"{out}/run={run}")
    path = F.min("path") if "path" in frames.columns else F.concat(F.lit("videos/"), F.col("video_id").cast("string"), F.lit(".mp4"))
    stats = written.groupBy("video_id").agg(F.count("*").alias("total_frames"), F.count_if(F.size("boxes") > 0).alias("face_frames"), path.alias("path"))
    stats = stats.filter(~F.coalesce(F.col("path").startswith("<video"), F.lit(False)))
    stats = stats.withColumn("face_ratio", F.coalesce(F.try_divide("face_frames", "total_frames"), F.lit(0.0)))
    stats = stats.withColumn("dir", media.folder(F.col("path"))).withColumn("filename", F.regexp_replace("path", r"^.*/", ""))
    if stats_root:
        write_face_stats(stats, stats_root)
    return stats


def encode_plan(files: DataFrame, jobs: DataFrame, probes: DataFrame, fmt: str = "mp4", bitrate: int = 1000, preset: str = "fast") -> DataFrame:
    """One row per file to encode: its range, size, encoder, output and command line. Ranges without frames are marked and have no command.
    Whether outputs collide is another question, see with_collisions."""
    probed = media.probe_columns(files)
    joined = probed.join(jobs.withColumnRenamed("fps", "out_fps"), "file_id")
    ranged = media.target_size(media.frame_range(resolve_encoder(resolve_gpu(joined, pick_gpu(jobs, probes)))))
    named = ranged.withColumn("output_path", media.output_path(F.col("path"), F.col("first"), F.col("last"), F.col("end_frame"), fmt))
    args = encode_args(
        F.col("path"), F.col("output_path"), F.col("encoder"), F.col("fps"), F.col("start_frame"), F.col("end_frame"), F.col("out_fps"), F.col("resolution"),
        F.col("out_width"), F.col("out_height"), F.col("keep_audio") != 0, bitrate, preset,
    )
    return named.withColumn("args", F.when(F.col("status") == "ok", args))


def encode_again_plan(redacted: DataFrame, bitrate: int = 1000, preset: str = "fast") -> DataFrame:
    """Adds the command line that encodes a redacted file once more."""
    sized = media.target_size(resolve_encoder(redacted))
    args = encode_args_after_redact(F.col("redacted_path"), F.col("encoder"), F.col("fps"), F.col("resolution"), F.col("out_width"), F.col("out_height"), bitrate, preset)
    return sized.withColumn("args", args)
