"""Streams that end, forget, join and restart."""

from datetime import UTC, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from framejobs.operators import progress
from framejobs.streaming import jobs as streams
from tests.media.test_jobs import stream_of

at = lambda t: datetime.fromtimestamp(1_700_000_000 + t, UTC)


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(key, before)


def kept(query) -> int:
    return sum(s["numRowsTotal"] for s in query.lastProgress["stateOperators"])


LOG = "job_id long, line_no long, ts timestamp, line string"


def test_jobs_are_completed_and_dropped(spark, tmp_path, rocksdb):
    rows = [(j, k, at(k + j), f"frame={k * 5 - j}" if (j + k) % 4 else "x") for j in range(4) for k in range(30)]
    rows += [(3, 30, at(40), "progress=end"), (4, 0, at(5), "x"), (None, 1, at(1), "frame=3")]
    parts = [[r for r in rows if 10 * n <= r[1] < 10 * n + 10] for n in range(4)]
    beyond = [[(9, 0, at(5000), "x")], [(9, 1, at(5001), "progress=end")]]
    out = streams.progress_delta_stream(stream_of(spark, tmp_path, LOG, parts + beyond), 200, "1 minute")
    q = streams.run_available(out, f"{tmp_path}/out", f"{tmp_path}/state")
    got = spark.read.parquet(f"{tmp_path}/out").filter("job_id <> 9")
    want = progress.progress_delta(spark.createDataFrame([r for r in rows if r[0] is not None], LOG), 200)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert kept(q) == 0


def test_a_silent_session_is_forgotten(spark, tmp_path, rocksdb):
    parts = [[(1, 1, 0, 0, 9), (1, 2, 100, 0, 9)], [(1, 3, 150, 0, 9)], [(2, 4, 5000, 0, 9)], [(2, 5, 5100, 0, 9)], [(1, 6, 90_000, 0, 9), (1, 7, 90_100, 0, 9)], [(3, 8, 400_000, 0, 9)], [(3, 9, 400_050, 0, 9)]]
    out = streams.throttle_stream(stream_of(spark, tmp_path, streams.UPDATES, parts), late="0 seconds")
    q = streams.run_available(out, f"{tmp_path}/out", f"{tmp_path}/state")
    shown = sorted(r.seq for r in spark.read.parquet(f"{tmp_path}/out").collect())
    batch = progress.throttle(spark.createDataFrame([r for p in parts for r in p], streams.UPDATES))
    assert shown == sorted(r.seq for r in batch.collect()) == [1, 4, 6, 8]
    print(kept(q), q.lastProgress["stateOperators"])
    assert kept(q) <= 4  # of three sessions only the last one's value and timer are left


def test_ticks_of_two_streams(spark, tmp_path):
    cpu = "ts timestamp, host_id long, proc_name string, cpu_percent double, cpu_total double, mem_used long, mem_total long"
    gpu = "ts timestamp, host_id long, sample_id long, gpu_csv string"
    c = [[(at(t), h, "ffmpeg", 10.0, 70.0, t, 100) for t in range(n * 20, n * 20 + 20) for h in (1, 2)] for n in range(3)] + [[(at(500), 1, None, 0.0, 0.0, 0, 1)], [(at(501), 1, None, 0.0, 0.0, 0, 1)]]
    g = [[(at(t), 1, t, f"{90 if t < 20 else 10}, 1, 2, 3") for t in range(n * 20, n * 20 + 20) if t < 30] for n in range(3)] + [[(at(500), 3, 500, "1, 2, 3, 4")], [(at(501), 3, 501, "1, 2, 3, 4")]]
    out = streams.host_tick_joined(stream_of(spark, tmp_path / "c", cpu, c), stream_of(spark, tmp_path / "g", gpu, [p or [(at(40), 3, 40, "x")] for p in g]), "10 seconds", "5 seconds")
    streams.run_available(out, f"{tmp_path}/out", f"{tmp_path}/state")
    got = {(r.host_id, r.tick - 1_700_000_000): (r.bottleneck, r.ffmpeg_cpu) for r in spark.read.parquet(f"{tmp_path}/out").collect() if r.tick < 1_700_000_400}
    want = {(1, t): ("gpu_saturated" if t < 20 else "cpu" if t < 30 else "gpu_missing", 100.0) for t in range(0, 60, 10)} | {(2, t): ("gpu_missing", 100.0) for t in range(0, 60, 10)}
    assert got == want


def test_a_killed_frame_stream_writes_each_frame_once(spark, tmp_path, monkeypatch):
    from framejobs.plans.queries import bright_model

    schema = "video_id long, frame_id long, height int, width int, channels int, pixels binary"
    rng = np.random.default_rng(3)
    parts = [[(1, 10 * n + k, 32, 32, 1, rng.integers(0, 256, 1024, dtype=np.uint8).tobytes()) for k in range(10)] for n in range(4)]
    out = lambda: streams.frame_stream(stream_of_once(), bright_model, "solid", threshold=0.7)
    source = stream_of(spark, tmp_path, schema, parts)
    stream_of_once = lambda: source
    write, calls = type(out().writeStream).foreachBatch, []

    def dies_once(self, f):
        def g(batch, epoch):
            f(batch, epoch)
            calls.append(epoch)
            if calls == [0, 1]:
                raise RuntimeError("killed after it had written")

        return write(self, g)

    monkeypatch.setattr(type(out().writeStream), "foreachBatch", dies_once)
    with pytest.raises(Exception, match="killed"):
        streams.run_by_epoch(out(), f"{tmp_path}/out", f"{tmp_path}/state")
    streams.run_by_epoch(out(), f"{tmp_path}/out", f"{tmp_path}/state")
    assert calls == [0, 1, 1, 2, 3]
    got = streams.read_epochs(spark, f"{tmp_path}/out", out().schema)
    assert sorted(r.frame_id for r in got.collect()) == list(range(40))
    before = {r[1]: r[5] for p in parts for r in p}
    assert all((bytes(r.pixels) == before[r.frame_id]) == (not r.boxes) for r in got.collect())
    assert got.filter(F.size("boxes") > 0).count() > 0
