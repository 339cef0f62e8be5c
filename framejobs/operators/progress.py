"""Progress logs and hosts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framejobs.functions.progress import parse_progress
from framejobs.functions.telemetry import is_ffmpeg, parse_gpu_csv


def progress_delta(log: DataFrame, n_frames: int) -> DataFrame:
    """(job_id, line_no, frame, delta): the increment of each good line over the one before, and a last row without line_no that completes the job."""
    good = log.select("job_id", "line_no", parse_progress(F.col("line")).alias("frame")).filter("frame is not null")
    steps = good.withColumn("delta", F.col("frame") - F.lag("frame", 1, 0).over(Window.partitionBy("job_id").orderBy("line_no")))
    reached = log.groupBy("job_id").agg(F.max_by(parse_progress(F.col("line")), F.when(parse_progress(F.col("line")).isNotNull(), F.col("line_no"))).alias("reached"))
    closing = reached.select("job_id", F.lit(None).cast("long").alias("line_no"), F.lit(n_frames).cast("long").alias("frame"), (n_frames - F.coalesce("reached", F.lit(0))).alias("delta"))
    return steps.unionByName(closing)


def latest_progress(log: DataFrame, n_frames: int, *keys: Column) -> DataFrame:
    """Per job: its latest frame, share done, seconds between its first and last line, and seconds left at that speed."""
    frame = parse_progress(F.col("line"))
    out = log.groupBy("job_id", *keys).agg(F.max_by(frame, F.when(frame.isNotNull(), F.col("line_no"))).alias("frame"), (F.max("seconds") - F.min("seconds")).alias("elapsed"))
    left = F.when(F.col("frame") > 0, F.col("elapsed") * (n_frames - F.col("frame")) / F.col("frame"))
    return out.withColumn("done", F.col("frame") / n_frames).withColumn("eta", left)


def ffmpeg_cpu(samples: DataFrame, *keys) -> DataFrame:
    """Summed cpu percent of processes whose name contains ffmpeg; 0 if there are none."""
    return samples.groupBy(*keys).agg(_ffmpeg_sum())


def _ffmpeg_sum() -> Column:
    return F.coalesce(F.sum(F.when(is_ffmpeg(F.col("proc_name")), F.col("cpu_percent"))), F.lit(0.0)).alias("ffmpeg_cpu")


def host_tick_aggregates(gpu: bool = True) -> list[Column]:
    """What one tick of one host combines; the latest good GPU sample counts, or none."""
    sample = parse_gpu_csv(F.col("gpu_csv"))
    found = [_ffmpeg_sum(), F.max("cpu_total").alias("cpu_total"), F.max("mem_used").alias("mem_used"), F.max("mem_total").alias("mem_total")]
    return [*found, F.max_by(sample, F.when(sample.isNotNull(), F.col("sample_id"))).alias("gpu")] if gpu else found


def host_tick(samples: DataFrame, seconds: int = 1) -> DataFrame:
    """One row per host and tick, from one shuffle; tick is its first second."""
    tick = (F.floor(F.col("seconds") / seconds) * seconds).alias("tick")
    return samples.groupBy("host_id", tick).agg(*host_tick_aggregates())


def throttle(updates: DataFrame, gap_ms: int = 200) -> DataFrame:
    """Updates that are shown: the first of a session, those at the end, and those at least ``gap_ms`` after the last one shown. What is shown
    depends on what was, so a session is walked in order; sessions are short next to all of them. Rows without a session are
    dropped."""
    def walk(batches):
        current = last = None
        for b in batches:
            keep = []
            for session, t, cur, total in zip(b["session_id"], b["t_ms"], b["cur"], b["total"], strict=True):
                if session != current:
                    current, last = session, None
                show = last is None or cur >= total or t - last >= gap_ms
                if show:
                    last = t
                keep.append(show)
            yield pd.DataFrame(b[keep])

    dealt = updates.filter("session_id is not null").select("session_id", "seq", "t_ms", "cur", "total").repartition("session_id").sortWithinPartitions("session_id", "t_ms", "seq")
    return dealt.mapInPandas(walk, dealt.schema)
