"""Structured Streaming twins of the batch jobs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from framejobs.functions.progress import parse_progress
from framejobs.functions.telemetry import bottleneck, parse_gpu_csv, util_bar
from framejobs.operators.progress import host_tick_aggregates, latest_progress
from framejobs.operators.redact import redact_frames, score_frames

#: Added to times in milliseconds that count from 0, so that none lies at or before the watermark's beginning, 1970.
SHIFT_MS = 86_400_000
UPDATES = "session_id long, seq long, t_ms long, cur long, total long"


def telemetry_stream(samples: DataFrame, width: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """Ticks of hosts with their bottleneck, from a stream of samples with an event time ``ts``; append mode, state is dropped behind the watermark."""
    ticks = samples.withWatermark("ts", late).groupBy("host_id", F.window("ts", width)).agg(*host_tick_aggregates())
    return ticks.select(
        "host_id", F.unix_seconds("window.start").alias("tick"), "ffmpeg_cpu", "cpu_total", "mem_used", "mem_total", "gpu",
        bottleneck(F.col("gpu.gpu_util"), F.col("cpu_total"), F.col("ffmpeg_cpu")).alias("bottleneck"), util_bar(F.col("cpu_total")).alias("cpu_bar"),
    )


def progress_stream(log: DataFrame, n_frames: int, late: str | None = None) -> DataFrame:
    """The latest progress of each job; update or complete mode. With ``late``, jobs are followed a day at a time by the event time ``ts``: a column
    ``day`` (a window) is added, and in update mode the state of days behind the watermark is dropped."""
    if late is None:
        return latest_progress(log, n_frames)
    return latest_progress(log.withWatermark("ts", late), n_frames, F.window("ts", "1 day").alias("day"))


class JobProgress(StatefulProcessor):
    """Of each job the last good frame and its line, and the time after which it counts as silent."""

    def __init__(self, n_frames: int, silent_ms: int):
        self.n_frames, self.silent_ms = n_frames, silent_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", "frame long, expires long")

    def _closing(self, job: int, frame: int) -> pd.DataFrame:
        return pd.DataFrame({"job_id": [job], "line_no": pd.array([None], dtype="Int64"), "frame": [self.n_frames], "delta": [self.n_frames - frame]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        part = pd.concat(list(rows)).sort_values("line_no")
        frame, expires = self.state.get() if self.state.exists() else (0, 0)
        good = part[part["frame"].notna()]
        if len(good):
            at = good["frame"].astype("int64")
            yield pd.DataFrame({"job_id": key[0], "line_no": good["line_no"].astype("Int64"), "frame": at, "delta": at.diff().fillna(at.iloc[0] - frame).astype("int64")})
            frame = int(at.iloc[-1])
        if part["ended"].any():
            if expires:
                self.handle.deleteTimer(expires)
            self.state.clear()
            yield self._closing(key[0], frame)
            return
        # A job is silent when the watermark, and so all rows to come, is that much later than its last row.
        later = max(expires, int(part["ts"].max().timestamp() * 1000) + self.silent_ms)
        if later != expires:
            if expires:
                self.handle.deleteTimer(expires)
            self.handle.registerTimer(later)
        self.state.update((frame, later))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.state.exists():
            frame, _ = self.state.get()
            self.state.clear()
            yield self._closing(key[0], frame)

    def close(self) -> None:
        pass


def progress_delta_stream(log: DataFrame, n_frames: int, silent: str = "10 minutes", late: str = "0 seconds") -> DataFrame:
    """The increments of jobs and the row that completes each, from a stream with an event time ``ts``; append mode, needs the RocksDB state store.

    A job is completed, and its state dropped, at its line ``progress=end`` or when it has been ``silent`` behind the watermark. Lines of a job
    come in order from one micro-batch to the next; one that comes after its job was completed begins it anew. Rows without a job are dropped.
    """
    silent_ms = int(pd.Timedelta(silent).total_seconds() * 1000)
    frame = parse_progress(F.col("line"))
    rows = log.withWatermark("ts", late).filter("job_id is not null").select(
        "job_id", "line_no", "ts", frame.alias("frame"), F.coalesce(F.trim("line") == "progress=end", F.lit(False)).alias("ended")
    )
    return rows.groupBy("job_id").transformWithStateInPandas(
        JobProgress(n_frames, silent_ms), outputStructType="job_id long, line_no long, frame long, delta long", outputMode="Append", timeMode="EventTime"
    )


class Throttle(StatefulProcessor):
    """One value for each session: the time of the last update shown. With timers it goes as soon as no update to come depends on it."""

    def __init__(self, gap_ms: int = 200, timers: bool = False):
        self.gap_ms, self.timers = gap_ms, timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "t_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = before = self.last.get()[0] if self.last.exists() else None
        for part in [pd.concat(list(rows)).sort_values(["t_ms", "seq"])]:
            keep = []
            for t, cur, total in zip(part["t_ms"], part["cur"], part["total"], strict=True):
                show = last is None or cur >= total or t - last >= self.gap_ms
                if show:
                    last = t
                keep.append(show)
            if last is not None:
                self.last.update((int(last),))
            if self.timers and last != before:
                if before is not None:
                    self.handle.deleteTimer(int(before) + self.gap_ms + SHIFT_MS)
                self.handle.registerTimer(int(last) + self.gap_ms + SHIFT_MS)
            yield part[keep][["session_id", "seq", "t_ms", "cur", "total"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.last.clear()
        yield from ()

    def close(self) -> None:
        pass


def throttle_stream(updates: DataFrame, gap_ms: int = 200, late: str | None = None) -> DataFrame:
    """The updates that are shown, across micro-batches; needs the RocksDB state store. Rows without a session are dropped. Without ``late`` a session's
    state, one number, is kept as long as the query's checkpoint. With it, t_ms is an event time, and the state goes when the watermark is ``gap_ms``
    past the last update shown: any update still to come is then shown whatever was before, so results are the same."""
    known = updates.filter("session_id is not null").select(*(c.split()[0] for c in UPDATES.split(", ")))
    if late is None:
        return known.groupBy("session_id").transformWithStateInPandas(Throttle(gap_ms), outputStructType=UPDATES, outputMode="Append", timeMode="None")
    timed = known.withColumn("ts", F.timestamp_millis(F.col("t_ms") + SHIFT_MS)).withWatermark("ts", late)
    return timed.groupBy("session_id").transformWithStateInPandas(Throttle(gap_ms, True), outputStructType=UPDATES, outputMode="Append", timeMode="EventTime")


def host_tick_joined(cpu: DataFrame, gpu: DataFrame, width: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """Ticks of hosts from two streams: CPU samples (ts, host_id, proc_name, cpu_percent, cpu_total, mem_used, mem_total) and GPU samples (ts, host_id,
    sample_id, gpu_csv). Each is gathered by host and window, and the windows are joined when the watermarks of both have passed them; a tick without
    GPU samples has the bottleneck gpu_missing, and GPU samples without a CPU tick are left out. Append mode."""
    sample = parse_gpu_csv(F.col("gpu_csv"))
    ticks = cpu.withWatermark("ts", late).groupBy("host_id", F.window("ts", width)).agg(*host_tick_aggregates(gpu=False))
    gpus = gpu.withWatermark("ts", late).groupBy("host_id", F.window("ts", width)).agg(F.max_by(sample, F.when(sample.isNotNull(), F.col("sample_id"))).alias("gpu"))
    both = ticks.join(gpus, ["host_id", "window"], "left")
    return both.select(
        "host_id", F.unix_seconds("window.start").alias("tick"), "ffmpeg_cpu", "cpu_total", "mem_used", "mem_total", "gpu",
        bottleneck(F.col("gpu.gpu_util"), F.col("cpu_total"), F.col("ffmpeg_cpu")).alias("bottleneck"), util_bar(F.col("cpu_total")).alias("cpu_bar"),
    )


def frame_stream(frames: DataFrame, model_fn, mode: str = "blur", batch: int = 8, threshold: float = 0.2, **options) -> DataFrame:
    """Frames of an unbounded source, scored and redacted as they come, by the code of the batch jobs."""
    return redact_frames(score_frames(frames, model_fn, batch, threshold), mode, **options)


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Writes what a stream has now to Parquet and stops."""
    q = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def run_by_epoch(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes what a stream has now to Parquet, one folder for each micro-batch, and stops. A micro-batch that is run again after a failure has the
    same number and overwrites what it had begun, so that each row is there once; read_epochs reads finished ones only."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    q = df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def read_epochs(spark: SparkSession, path: str, schema) -> DataFrame:
    """What run_by_epoch has written."""
    return spark.read.schema(schema).parquet(path).select(*(f.name for f in schema.fields))
