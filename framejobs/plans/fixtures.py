"""Input tables of the registered queries, derived from the driver's tables. The same SQL runs in Spark and, as common table expressions, in DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIXTURES = {
    "media_files": """
select o_orderkey as file_id,
  case when o_orderkey % 101 = 0 then '<video0>' else
  '/media/d' || cast(o_custkey % 20 as string) || '/clip' || cast(o_orderkey as string) ||
  case o_orderkey % 12 when 0 then '.mp4' when 1 then '.MP4' when 2 then '.mov' when 3 then '.MOV'
    when 4 then '.avi' when 5 then '.AVI' when 6 then '.mkv' when 7 then '.MKV' when 8 then '.jpg'
    when 9 then '.png' when 10 then '.txt' else '' end end as path,
  case when o_orderkey % 97 = 0 then 0 else 1 end as is_file,
  cast(floor(o_totalprice * 100) as bigint) as size_bytes,
  o_orderkey % 900 as frame_count,
  case o_custkey % 5 when 0 then 0e0 when 1 then 24e0 when 2 then 25e0 when 3 then 30e0 else 60e0 end as fps,
  cast(case o_custkey % 3 when 0 then 1920 when 1 then 1280 else 640 end as int) as width,
  cast(case o_custkey % 3 when 0 then 1080 when 1 then 720 else 360 end as int) as height,
  case o_orderkey % 3 when 0 then 875967080 when 1 then 828601960 else 808466553 end as fourcc
from orders""",
    "encode_jobs": """
select o_orderkey as file_id, o_custkey % 150 as worker_id,
  case o_orderkey % 4 when 0 then 'hevc' when 1 then 'h264' when 2 then 'vp9' else 'av1' end as codec,
  case o_custkey % 5 when 0 then 'nvidia' when 1 then 'amd' when 2 then 'intel' when 3 then 'cpu' else 'auto' end as gpu,
  case o_orderkey % 5 when 0 then '480p' when 1 then '720p' when 2 then '1080p' when 3 then '4k' else 'original' end as resolution,
  case o_orderkey % 3 when 0 then 0 else o_orderkey % 200 end as start_frame,
  case o_custkey % 4 when 0 then -1 else o_orderkey % 1000 end as end_frame,
  case o_orderkey % 3 when 1 then 29.97e0 end as fps,
  o_orderkey % 2 as keep_audio,
  case o_orderstatus when 'P' then 1 else 0 end as rc
from orders""",
    "worker_probes": """
select user_id as worker_id,
  case event_id % 3 when 0 then 'nvidia' when 1 then 'amd' else 'intel' end as gpu,
  cast(event_id % 3 + 1 as int) as priority,
  max(case when value > 150 then 1 else 0 end) as ok
from events group by 1, 2, 3""",
    "frames": """
select o_orderkey % 50 as video_id, cast(floor(o_orderkey / 50) as bigint) as frame_id,
  cast(case o_orderkey % 50 % 3 when 0 then 1080 when 1 then 720 else 360 end as int) as height,
  cast(case o_orderkey % 50 % 3 when 0 then 1920 when 1 then 1280 else 640 end as int) as width,
  case o_orderkey % 50 % 4 when 0 then 24e0 when 1 then 25e0 when 2 then 30e0 else 60e0 end as fps
from orders""",
    "detections": """
select l_orderkey % 50 as video_id, cast(floor(l_orderkey / 50) as bigint) as frame_id,
  cast(row_number() over (partition by l_orderkey
       order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 as int) as det_idx,
  cast(l_partkey % 60 as double) as x1, cast(l_suppkey % 60 as double) as y1,
  cast(l_partkey % 60 as double) + 20 + l_quantity as x2,
  cast(l_suppkey % 60 as double) + 30 + l_quantity as y2,
  l_extendedprice / 110000e0 as score
from lineitem""",
    "progress_log": """
select user_id as job_id, event_id as line_no, ts,
  case event_type when 'click' then 'frame=' || cast(event_id % 1000 as string)
    when 'view' then 'frame=  ' || cast(event_id % 1000 as string)
    when 'error' then 'frame=N/A' when 'signup' then 'fps=' || cast(value as string)
    else 'progress=continue' end as line
from events""",
    "telemetry": """
select event_id as sample_id, ts, user_id as host_id,
  case event_type when 'click' then 'ffmpeg' when 'view' then 'FFmpeg.exe' when 'error' then 'python3'
    when 'signup' then 'ffmpeg-6.1' else cast(null as string) end as proc_name,
  value as cpu_percent,
  cast(event_id * 7 % 101 as double) as cpu_total,
  event_id % 64 * cast(1073741824 as bigint) as mem_used, 64 * cast(1073741824 as bigint) as mem_total,
  case when event_id % 13 = 0 then 'not available' else
  regexp_extract(props, '[0-9]+', 0) || ', ' || cast(user_id % 100 as string) || ', ' ||
  cast(event_id % 24000 as string) || ', 24000' end as gpu_csv
from events""",
    "ui_updates": """
select user_id % 10 as session_id, event_id as seq, event_id * 7 as t_ms,
  event_id % 51 as cur, cast(50 as bigint) as total
from events""",
}
CELLS_SPARK = """
select label as video_id, vec_id as frame_id, cast(floor(p / 8) as int) as cell_y, cast(p % 8 as int) as cell_x,
  v as heat, e[(p + 7) % 64] as scale0, e[(p + 13) % 64] as scale1, e[(p + 19) % 64] as off0, e[(p + 29) % 64] as off1,
  transform(sequence(0, 9), k -> e[(p + 31 + k) % 64]) as lm
from (select label, vec_id, embedding as e, posexplode(embedding) as (p, v) from embeddings)"""
CELLS_DUCKDB = """
select label as video_id, vec_id as frame_id, cast(floor(p / 8) as int) as cell_y, cast(p % 8 as int) as cell_x,
  e[p + 1] as heat, e[(p + 7) % 64 + 1] as scale0, e[(p + 13) % 64 + 1] as scale1,
  e[(p + 19) % 64 + 1] as off0, e[(p + 29) % 64 + 1] as off1,
  list_transform(range(0, 10), lambda k: e[(p + 31 + k) % 64 + 1]) as lm
from (select label, vec_id, embedding as e, unnest(range(0, 64)) as p from embeddings)"""
TABLES = ("orders", "events", "lineitem", "embeddings")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = CELLS_SPARK if name == "cells" else FIXTURES[name]
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if re.search(rf"from {t}\b", sql)}
    for t in tables:
        sql = re.sub(rf"from {t}\b", f"from {{{t}}}", sql)
    df = spark.sql(sql, **tables)
    return df.withColumn("seconds", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long")) if "ts" in df.columns else df


def ctes(*names: str) -> str:
    """A with clause for DuckDB."""
    parts = []
    for n in names:
        sql = CELLS_DUCKDB if n == "cells" else FIXTURES[n]
        if n in ("progress_log", "telemetry"):
            sql = sql.replace(", ts,", ", ts, cast(floor(epoch(ts)) as bigint) as seconds,")
        parts.append(f"{n} as ({sql})")
    return "with " + ", ".join(parts)
