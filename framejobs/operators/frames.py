"""Frame tables: trimming, resampling, statistics. None of these look at pixels; join those back by (video_id, frame_id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framejobs.operators.scan import ranked

KEY = ["video_id", "frame_id"]


def slot(i: Column, fps_in: Column, fps_out: Column) -> Column:
    """Where source frame i goes at another rate, rounded half up."""
    return F.floor(i * F.try_divide(fps_out, fps_in) + 0.5).cast("long")


def _position(frames: DataFrame, dense: bool, first: Column | None) -> DataFrame:
    """Adds _i, a frame's position from 0 in its video: its distance from the first id where ids are dense, else its rank, which tasks count by ranges
    of frames, so that a long video is no task of its own."""
    if dense:
        return frames.withColumn("_i", (F.col("frame_id") - (first if first is not None else F.lit(0))).cast("long"))
    return ranked(frames, ["video_id"], ["frame_id"], "_i").withColumn("_i", (F.col("_i") - 1).cast("long"))


def resample_fps(frames: DataFrame, fps_out: Column, dense: bool = True, first: Column | None = None) -> DataFrame:
    """Frames at a constant rate, dropped or repeated: one row for each output frame, with out_id. Ids that are ``dense`` from the first kept
    frame need no shuffle; otherwise the position of a frame is its rank in the video."""
    ranked_frames = _position(frames, dense, first)
    out = ranked_frames.withColumn("_s", slot(F.col("_i"), F.col("fps"), fps_out)).withColumn("_e", slot(F.col("_i") + 1, F.col("fps"), fps_out))
    return out.filter("_e > _s").withColumn("out_id", F.explode(F.sequence("_s", F.col("_e") - 1))).drop("_i", "_s", "_e")


def retime_fps(frames: DataFrame, fps_out: float = 30.0, first: Column | None = None) -> DataFrame:
    """All frames, played at another rate: adds out_pts in seconds."""
    return frames.withColumn("out_pts", (F.col("frame_id") - (first if first is not None else F.lit(0))) / F.lit(fps_out))


def trim_frames(frames: DataFrame, first: Column, last: Column, fps_out: Column | None = None, limited: Column | None = None, dense: bool = True) -> DataFrame:
    """Frames from ``first`` on, resampled, and at most last - first of the result where ``limited``. Where ids are ``dense`` the limit needs no ranking;
    where frames are missing, those that are there are counted."""
    kept = frames.filter(F.col("frame_id") >= first)
    if fps_out is not None:
        kept = resample_fps(kept, fps_out, dense, first)
    else:
        kept = _position(kept, dense, first).withColumnRenamed("_i", "out_id")
    within = F.col("out_id") < last - first
    return kept.filter(within if limited is None else ~limited | within)


def frames_with_detections(frames: DataFrame, detections: DataFrame) -> DataFrame:
    """Every frame with the array of its detections in their order, empty if it has none."""
    packed = F.struct("det_idx", *(c for c in detections.columns if c not in (*KEY, "det_idx")))
    grouped = detections.groupBy(*KEY).agg(F.sort_array(F.collect_list(packed)).alias("boxes"))
    return frames.join(grouped, KEY, "left").withColumn("boxes", F.coalesce("boxes", F.array().cast(grouped.schema["boxes"].dataType)))


def face_stats(frames: DataFrame, detections: DataFrame, threshold: float = 0.2) -> DataFrame:
    """Per video: total_frames, face_frames (with a detection over the threshold) and their ratio. Detections are counted before they meet the frames."""
    counts = detections.filter(F.col("score") > threshold).groupBy(*KEY).agg(F.count("*").alias("n_det"))
    joined = frames.select(*KEY).join(counts, KEY, "left")
    out = joined.groupBy("video_id").agg(F.count("*").alias("total_frames"), F.count_if(F.col("n_det") > 0).alias("face_frames"))
    return out.withColumn("face_ratio", F.coalesce(F.try_divide("face_frames", "total_frames"), F.lit(0.0)))
