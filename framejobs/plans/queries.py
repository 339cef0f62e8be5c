"""The registered queries of the media jobs, and SQL that DuckDB can run for each that SQL can express."""

from __future__ import annotations

import re
import struct
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framejobs.functions import boxes, encode, media, progress, telemetry
from framejobs.operators import catalog, detections, frames, pixels, redact
from framejobs.operators import progress as logs
from framejobs.plans import redaction
from framejobs.plans.fixtures import FIXTURES, ctes, fixture
from framejobs.sources.folders import new_folder
from framejobs.plans.redaction import encode_again_plan, encode_plan
from framejobs.sources import files, sinks
from framejobs.sources.lookups import ENCODERS, MIME, RESOLUTIONS, VIDEO_EXTENSIONS, VIDEO_EXTENSIONS_GUI
from framejobs.streaming import jobs as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def values(name: str, columns: str, rows: list[tuple]) -> str:
    return f", {name}({columns}) as (values {', '.join(str(tuple(r)) for r in rows)})"


EXT = r"regexp_extract(path, '[^/.][^/]*\.([^./]*)$', 1)"
STEM = r"regexp_replace(regexp_replace(path, '^.*/', ''), '^([^.].*)\.[^.]*$', '\1')"
FOLDER = "regexp_extract(path, '^(.*)/[^/]*$', 1)"
IN_FOLDER = lambda name: f"case when {FOLDER} = '' then {name} else {FOLDER} || '/' || {name} end"
r4 = lambda *names: [F.bround(F.col(n), 4).alias(n) for n in names]

# Sources and sinks


@query(f"{ctes('media_files')} select file_id, path, size_bytes from media_files where is_file = 1 and {EXT} in {tuple(VIDEO_EXTENSIONS)}")
def scan_media(spark, sf_dir):
    return catalog.media_by_extension(fixture(spark, sf_dir, "media_files")).select("file_id", "path", "size_bytes")


@query(f"{ctes('media_files')} select {FOLDER} as folder, count(*) as n_files, cast(sum(size_bytes) as bigint) as size_bytes from media_files where is_file = 1 group by 1")
def scan_all_files(spark, sf_dir):
    df = fixture(spark, sf_dir, "media_files").filter("is_file = 1")
    return df.groupBy(media.folder(F.col("path")).alias("folder")).agg(F.count("*").alias("n_files"), F.sum("size_bytes").alias("size_bytes"))


@query(
    "with d as (select doc_id, hex(encode(text)) as x from documents), n as (select doc_id, x, unnest(range(0, length(x) // 2 // 144)) as frame_id from d) "
    "select doc_id, frame_id, md5(substr(x, frame_id * 288 + 1, 288)) as pixels_md5 from n"
)
def read_raw_frames(spark, sf_dir):
    """Texts stand in for raw streams of 8 x 6 frames."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.encode("text", "UTF-8").alias("stream"))
    return files.raw_frames(docs, "stream", F.lit(8), F.lit(6), "doc_id").select("doc_id", "frame_id", F.md5(F.hex("pixels")).alias("pixels_md5"))


@query(f"""{ctes("telemetry")}, p as (select sample_id, string_split(trim(gpu_csv), ', ') as s from telemetry),
g as (select sample_id, case when len(s) = 4 then list_transform(s, lambda v: try_cast(trim(v) as int)) end as v from p),
k as (select sample_id, case when len(list_filter(v, lambda i: i is not null)) = 4 then v end as v from g)
select sample_id, v[1] as gpu_util, v[2] as mem_util, v[3] as mem_used, v[4] as mem_total from k""")
def parse_gpu_csv(spark, sf_dir):
    df = fixture(spark, sf_dir, "telemetry").select("sample_id", telemetry.parse_gpu_csv(F.col("gpu_csv")).alias("gpu"))
    return df.select("sample_id", "gpu.*")


@query(f"""{ctes("frames", "detections")}, f as (select video_id, frame_id, count(x1) as n from frames left join (select * from detections where score > 0.8) d using (video_id, frame_id) group by 1, 2)
select 'v' || video_id % 5 as dir, video_id || '.mp4' as filename, count(*) as total_frames, count(*) filter (n > 0) as face_frames,
  round(count(*) filter (n > 0) / count(*), 4) as face_ratio from f group by video_id""")
def write_face_stats(spark, sf_dir):
    """Written to the shared folder and read again."""
    stats = frames.face_stats(fixture(spark, sf_dir, "frames"), fixture(spark, sf_dir, "detections"), 0.8)
    root = new_folder(spark, "stats")
    sinks.write_face_stats(stats.select(F.concat(F.lit("v"), (F.col("video_id") % 5).cast("string")).alias("dir"), F.concat(F.col("video_id").cast("string"), F.lit(".mp4")).alias("filename"), "total_frames", "face_frames", "face_ratio"), root)
    return sinks.read_face_stats(spark, root).withColumn("face_ratio", F.col("face_ratio").cast("double"))


# Catalog columns


@query(f"""{ctes("media_files")}{values("mime", "ext, mime", MIME)}, t as (select file_id, case when path like '<video%' then 'cam' when is_file = 0 then 'notfound'
  when mime is null then null when mime like 'video%' then 'video' when mime like 'image%' then 'image' else mime end as file_type
  from media_files left join mime on lower({EXT}) = ext)
select *, case when file_type in ('video', 'cam', 'image') then file_type else 'skip' end as route,
  case when file_type in ('video', 'cam', 'image') then null when file_type = 'notfound' then 'not_found' when file_type is null then 'unknown_type' else 'unsupported_type' end as skip_reason from t""")
def classify_media(spark, sf_dir):
    return media.classify_media(fixture(spark, sf_dir, "media_files")).select("file_id", "file_type", "route", "skip_reason")


@query(f"""{ctes("media_files")}, f as (select *, case when fps = 0 then 25e0 else fps end as f from media_files), d as (select *, frame_count / f as duration from f)
select file_id, f as fps, round_even(duration, 4) as duration, case when duration > 0 then trunc(size_bytes * 8 / duration / 1000)::bigint else 0 end as bitrate, {EXT} as format from d""")
def probe_columns(spark, sf_dir):
    return media.probe_columns(fixture(spark, sf_dir, "media_files")).select("file_id", "fps", *r4("duration"), "bitrate", "format")


@query(f"""{ctes("media_files")}, d as (select *, case when fps > 0 then frame_count / fps else 0 end as duration from media_files)
select file_id, round_even(duration, 4) as duration, case when duration > 0 then trunc(size_bytes * 8 / duration / 1000)::bigint else 0 end as bitrate from d""")
def probe_columns_strict(spark, sf_dir):
    return media.probe_columns_strict(fixture(spark, sf_dir, "media_files")).select("file_id", *r4("duration"), "bitrate")


@query(f"{ctes('media_files')} select file_id, trim(chr(fourcc & 255) || chr((fourcc >> 8) & 255) || chr((fourcc >> 16) & 255) || chr((fourcc >> 24) & 255)) as codec from media_files")
def fourcc_text(spark, sf_dir):
    return fixture(spark, sf_dir, "media_files").select("file_id", media.fourcc_text(F.col("fourcc")).alias("codec"))


def _jobs(spark, sf_dir) -> DataFrame:
    return fixture(spark, sf_dir, "media_files").withColumnRenamed("fps", "source_fps").join(fixture(spark, sf_dir, "encode_jobs"), "file_id")


JOBS = ctes("media_files", "encode_jobs", "worker_probes") + """, j as (select m.* exclude (fps), m.fps as source_fps, e.* exclude (file_id),
  case when end_frame < 0 then frame_count else least(end_frame, frame_count) end as last from media_files m join encode_jobs e using (file_id))"""


@query(f"{JOBS} select file_id, start_frame as first, last, last - start_frame as n_frames, case when last > start_frame then 'ok' else 'invalid_range' end as status from j")
def frame_range(spark, sf_dir):
    return media.frame_range(_jobs(spark, sf_dir)).select("file_id", "first", "last", "n_frames", "status")


OUT = IN_FOLDER(f"{STEM} || case when start_frame <> 0 or end_frame >= 0 then '_' || start_frame || '_' || last || '_compress' else '_full_compress' end || '.mp4'")


@query(f"{JOBS}, o as (select file_id, {OUT} as output_path from j) select *, count(*) over (partition by output_path) > 1 as collides from o")
def output_path(spark, sf_dir):
    df = media.frame_range(_jobs(spark, sf_dir))
    df = df.select("file_id", media.output_path(F.col("path"), F.col("first"), F.col("last"), F.col("end_frame")).alias("output_path"))
    return catalog.with_collisions(df)


@query(f"{ctes('media_files')} select file_id, {IN_FOLDER(repr('trans'))} as out_folder from media_files")
def output_path_gui(spark, sf_dir):
    return fixture(spark, sf_dir, "media_files").select("file_id", media.output_folder_gui(F.col("path")).alias("out_folder"))


REDACTED = rf"case when {EXT} = '' then path || '_anonymized' else regexp_replace(path, '(\.[^./]*)$', '_anonymized\1') end"


@query(f"{ctes('media_files')} select file_id, case when path like '<video%' then null else {REDACTED} end as redacted_path from media_files")
def output_path_redacted(spark, sf_dir):
    df = media.classify_media(fixture(spark, sf_dir, "media_files"))
    return df.select("file_id", media.output_path_redacted(F.col("path"), F.col("file_type")).alias("redacted_path"))


SIZES = values("sizes", "resolution, w, h", RESOLUTIONS)


@query(f"{JOBS}{SIZES} select file_id, coalesce(w, width) as out_width, coalesce(h, height) as out_height from j left join sizes using (resolution)")
def target_size(spark, sf_dir):
    return media.target_size(_jobs(spark, sf_dir)).select("file_id", "out_width", "out_height")


@query(f"""{ctes("media_files")} select file_id, width, height, (ceil(width / 32) * 32)::int as net_width, (ceil(height / 32) * 32)::int as net_height,
  round_even(ceil(width / 32) * 32 / width, 4) as scale_w, round_even(ceil(height / 32) * 32 / height, 4) as scale_h from media_files""")
def network_size(spark, sf_dir):
    size = F.concat_ws("x", F.col("width").cast("string"), F.col("height").cast("string"))
    w, h = media.parse_size(size)
    df = fixture(spark, sf_dir, "media_files").select("file_id", w.alias("width"), h.alias("height"))
    return df.select("*", *media.network_size(F.col("width"), F.col("height"))).select("file_id", "width", "height", "net_width", "net_height", *r4("scale_w", "scale_h"))


# Encoders and command lines

GPUS = """, w as (select distinct worker_id from encode_jobs), g as (select w.worker_id, coalesce(arg_min(gpu, priority), 'cpu') as picked
  from w left join (select * from worker_probes where ok = 1) p on w.worker_id = p.worker_id group by 1)"""
ENC = values("enc", "codec, gpu, encoder", ENCODERS)
RESOLVED = f"""{JOBS}{GPUS}{ENC}{SIZES}, r as (select j.* exclude (gpu), case when j.gpu = 'auto' then picked else j.gpu end as gpu from j join g using (worker_id)),
x as (select r.*, coalesce(a.encoder, b.encoder) as encoder, coalesce(w, width) as ow, coalesce(h, height) as oh,
  case when source_fps = 0 then 25e0 else source_fps end as f, {OUT} as output_path
  from r left join enc a on r.codec = a.codec and r.gpu = a.gpu left join enc b on r.codec = b.codec and b.gpu = 'cpu' left join sizes s on r.resolution = s.resolution)"""
FILTERS = "array_to_string(list_filter([case when fps is not null then 'fps=' || fps end, case when resolution <> 'original' then 'scale=' || ow || ':' || oh end], lambda v: v is not null), ',')"
VIDEO = "' -c:v ' || encoder || ' -b:v 1000k -threads 0' || case when encoder in ('libx265', 'libx264', 'libvpx-vp9') then ' -preset fast' else '' end"
VF = f"case when {FILTERS} <> '' then ' -vf ' || {FILTERS} else '' end"


@query(f"{JOBS}{GPUS} select worker_id, picked as gpu from g")
def pick_gpu(spark, sf_dir):
    return catalog.pick_gpu(fixture(spark, sf_dir, "encode_jobs"), fixture(spark, sf_dir, "worker_probes"))


@query(f"{RESOLVED} select file_id, gpu, encoder from x")
def resolve_encoder(spark, sf_dir):
    jobs = fixture(spark, sf_dir, "encode_jobs")
    return catalog.resolve_encoder(catalog.resolve_gpu(jobs, catalog.pick_gpu(jobs, fixture(spark, sf_dir, "worker_probes")))).select("file_id", "gpu", "encoder")


@query(f"""{RESOLVED} select file_id, case when last > start_frame then '-y -hide_banner -hwaccel auto' ||
  case when start_frame > 0 then ' -ss ' || (start_frame / f)::varchar else '' end || ' -i ' || path ||
  case when end_frame >= 0 then ' -frames:v ' || (end_frame - start_frame) else '' end || {VF} || {VIDEO} ||
  case when keep_audio = 0 then ' -an' else '' end || ' -progress pipe:1 -nostats ' || output_path end as command from x""")
def encode_args(spark, sf_dir):
    plan = encode_plan(*(fixture(spark, sf_dir, n) for n in ("media_files", "encode_jobs", "worker_probes")))
    return plan.select("file_id", F.array_join("args", " ").alias("command"))


@query(f"""{RESOLVED} select file_id, '-y -hide_banner -hwaccel auto -i ' || {REDACTED} || {VF} || {VIDEO} || ' ' || {REDACTED} || '.tmp_transcode.mp4' as command from x""")
def encode_args_after_redact(spark, sf_dir):
    jobs = _jobs(spark, sf_dir)
    jobs = catalog.resolve_gpu(jobs, catalog.pick_gpu(jobs, fixture(spark, sf_dir, "worker_probes")))
    named = jobs.withColumn("redacted_path", media.output_path_redacted(F.col("path"), F.lit("video")))
    return encode_again_plan(named).select("file_id", F.array_join("args", " ").alias("command"))


CONFIGS = ['{"codec":"libx264"}', '{"codec":"libx265","fps":"12"}', '{"bitrate":"500k"}', '{"codec":"libx264","output_params":"x"}']


@query(f"""{ctes("media_files")}, c as (select *, file_id % 4 as k, path like '<video%' as cam, file_id % 2 = 0 as audio,
  case when fps > 0 and frame_count > 0 then trunc(size_bytes * 8 / (frame_count / fps) / 1000)::bigint else 0 end as b from media_files)
select file_id, array_to_string(list_sort(list_filter([case when k in (0, 3) then 'codec=libx264' when k = 1 then 'codec=libx265' end,
  'fps=' || case when k = 1 then '12' else fps::varchar end, case when k = 2 then 'bitrate=500k' when not cam then 'bitrate=' || b || 'k' end,
  case when audio then 'audio_path=' || path end, case when audio then 'audio_codec=copy' end, 'output_params=-preset fast'], lambda v: v is not null)), ';') as config from c""")
def writer_config(spark, sf_dir):
    df = media.probe_columns_strict(fixture(spark, sf_dir, "media_files")).withColumn("cfg", F.element_at(F.array(*map(F.lit, CONFIGS)), (F.col("file_id") % 4 + 1).cast("int")))
    cfg = encode.writer_config(F.col("cfg"), F.col("fps"), F.col("bitrate"), F.col("path"), F.col("path").startswith("<video"), F.col("file_id") % 2 == 0)
    entries = F.transform(F.map_entries(cfg), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return df.select("file_id", F.array_join(F.array_sort(entries), ";").alias("config"))


# Catalog joins and aggregates


@query(f"{ctes('media_files')} select distinct {FOLDER} as folder from media_files where {FOLDER} <> '' and {FOLDER} not in ('/media/d0', '/media/d1', '/media/d2', '/media/d3', '/media/d4') order by 1")
def new_folders(spark, sf_dir):
    df = fixture(spark, sf_dir, "media_files")
    listed = df.select(media.folder(F.col("path")).alias("folder")).filter(F.col("folder").rlike("^/media/d[0-4]$")).distinct()
    return catalog.new_folders(df, listed)


@query(f"{ctes('media_files')} select path, count(*) as n from (select path from media_files where {EXT} in {tuple(VIDEO_EXTENSIONS_GUI)} union all select path from media_files where {FOLDER} = '/media/d3') group by 1")
def union_inputs(spark, sf_dir):
    df = fixture(spark, sf_dir, "media_files")
    both = catalog.union_inputs(df.filter(media.extension(F.col("path")).isin(VIDEO_EXTENSIONS_GUI)).select("path"), df.filter(media.folder(F.col("path")) == "/media/d3").select("path"))
    return both.groupBy("path").agg(F.count("*").alias("n"))


@query(f"""{JOBS} select worker_id % 10 as batch_id, count(*) as n_files, count(*) filter (rc <> 0) as n_errors,
  coalesce(sum(size_bytes) filter (rc = 0), 0)::bigint as output_bytes, max(file_id + frame_count) - min(file_id) as elapsed from j group by 1""")
def batch_summary(spark, sf_dir):
    df = _jobs(spark, sf_dir).withColumn("batch_id", F.col("worker_id") % 10)
    return catalog.batch_summary(df, "batch_id", F.col("file_id"), F.col("file_id") + F.col("frame_count"))


@query(f"""{ctes("encode_jobs")} select file_id, worker_id, row_number() over w - 1 as done_before, row_number() over w as done_after,
  count(*) over (partition by worker_id) as total, file_id - min(file_id) over (partition by worker_id) as elapsed from encode_jobs window w as (partition by worker_id order by file_id)""")
def batch_progress(spark, sf_dir):
    df = fixture(spark, sf_dir, "encode_jobs").select("file_id", "worker_id")
    return catalog.batch_progress(df, "worker_id", "file_id", F.col("file_id"))


# Frames and detections


@query(f"{ctes('frames', 'detections')} select video_id, frame_id, count(x1) as n_boxes, coalesce(sum(det_idx), 0)::bigint as idx_sum, min(det_idx) as first_idx from frames left join detections using (video_id, frame_id) group by 1, 2")
def frames_with_detections(spark, sf_dir):
    df = frames.frames_with_detections(fixture(spark, sf_dir, "frames"), fixture(spark, sf_dir, "detections"))
    total = F.aggregate("boxes", F.lit(0).cast("long"), lambda n, b: n + b["det_idx"])
    return df.select("video_id", "frame_id", F.size("boxes").cast("long").alias("n_boxes"), total.alias("idx_sum"), F.try_element_at("boxes", F.lit(1))["det_idx"].alias("first_idx"))


@query(f"""{ctes("frames", "detections")}, f as (select video_id, frame_id, count(x1) as n from frames left join (select * from detections where score > 0.8) d using (video_id, frame_id) group by 1, 2)
select video_id, count(*) as total_frames, count(*) filter (n > 0) as face_frames, count(*) filter (n > 0) / count(*) as face_ratio from f group by video_id""")
def face_stats(spark, sf_dir):
    return frames.face_stats(fixture(spark, sf_dir, "frames"), fixture(spark, sf_dir, "detections"), 0.8)


IOU = """greatest(0, least(k.x2, b.x2) - greatest(k.x1, b.x1)) * greatest(0, least(k.y2, b.y2) - greatest(k.y1, b.y1))"""


@query(
    ctes("detections").replace("with ", "with recursive ", 1) + f""", r as (select *, row_number() over (partition by video_id, frame_id order by score desc, det_idx desc) as n from detections),
walk(video_id, frame_id, n, kept) as (select video_id, frame_id, 1, [{{'det_idx': det_idx, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'score': score}}] from r where n = 1
  union all select w.video_id, w.frame_id, w.n + 1, case when len(list_filter(w.kept, lambda k: ((k.x2 - k.x1) * (k.y2 - k.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - {IOU}) > 0
    and {IOU} >= 0.3 * ((k.x2 - k.x1) * (k.y2 - k.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - {IOU}))) > 0 then w.kept
    else list_append(w.kept, {{'det_idx': b.det_idx, 'x1': b.x1, 'y1': b.y1, 'x2': b.x2, 'y2': b.y2, 'score': b.score}}) end
  from walk w join r b on b.video_id = w.video_id and b.frame_id = w.frame_id and b.n = w.n + 1),
last as (select video_id, frame_id, arg_max(kept, n) as kept from walk group by 1, 2)
select video_id, frame_id, k.det_idx, k.x1, k.y1, k.x2, k.y2, k.score from (select video_id, frame_id, unnest(kept) as k from last)"""
)
def nms(spark, sf_dir):
    return detections.nms(fixture(spark, sf_dir, "detections"))


CROWDED = ctes("detections") + """, crowded as (select video_id, frame_id // 100 as frame_id, (frame_id % 100 * 20 + det_idx)::int as det_idx, x1 + frame_id % 10 * 40 as x1, y1 + frame_id % 100 // 10 * 40 as y1,
  x2 + frame_id % 10 * 40 as x2, y2 + frame_id % 100 // 10 * 40 as y2, score from detections)"""


@query(CROWDED.replace("with ", "with recursive ", 1) + ORACLES["nms"].removeprefix(ctes("detections").replace("with ", "with recursive ", 1)).replace("from detections)", "from crowded)"))
def nms_crowded(spark, sf_dir):
    """A hundred frames' detections side by side in one."""
    df = fixture(spark, sf_dir, "detections")
    right, down = F.col("frame_id") % 10 * 40, F.floor(F.col("frame_id") % 100 / 10) * 40
    moved = df.select(
        "video_id", F.floor(F.col("frame_id") / 100).alias("frame_id"), (F.col("frame_id") % 100 * 20 + F.col("det_idx")).cast("int").alias("det_idx"),
        *((F.col(c) + by).alias(c) for c, by in (("x1", right), ("y1", down), ("x2", right), ("y2", down))), "score",
    )
    return detections.nms(moved)


@query(f"""{ctes("cells")} select video_id, frame_id, cell_y, cell_x, row_number() over (partition by video_id, frame_id order by cell_y, cell_x) - 1 as det_idx from cells where heat > 0.2""")
def det_index(spark, sf_dir):
    return detections.det_index(fixture(spark, sf_dir, "cells").filter("heat > 0.2").select("video_id", "frame_id", "cell_y", "cell_x"))


DECODED = ctes("cells") + """, s as (select *, exp(scale0::double) * 4 as h, exp(scale1::double) * 4 as w from cells where heat::double > 0.2),
b as (select *, least(greatest(0, (cell_x + off1::double + 0.5) * 4 - w / 2), 32) as x1, least(greatest(0, (cell_y + off0::double + 0.5) * 4 - h / 2), 32) as y1 from s),
d as (select *, least(x1 + w, 32) as x2, least(y1 + h, 32) as y2 from b)"""
BOX_COLUMNS = ("x1", "y1", "x2", "y2")
ROUNDED = ", ".join(f"round_even({c}, 3) as {c}" for c in BOX_COLUMNS)


def _decoded(spark, sf_dir) -> DataFrame:
    return boxes.decode_boxes(fixture(spark, sf_dir, "cells"), 32, 32)


def _r3(*names: str):
    return [F.bround(F.col(n), 3).alias(n) for n in names]


@query(f"{DECODED} select video_id, frame_id, cell_y, cell_x, {ROUNDED}, round_even(heat::double, 3) as score from d")
def decode_boxes(spark, sf_dir):
    return _decoded(spark, sf_dir).select("video_id", "frame_id", "cell_y", "cell_x", *_r3(*BOX_COLUMNS, "score"))


@query(f"""{DECODED} select video_id, frame_id, cell_y, cell_x, j, round_even(lm[2 * j + 2]::double * w + x1, 3) as x, round_even(lm[2 * j + 1]::double * h + y1, 3) as y
from (select *, unnest(range(0, 5)) as j from d)""")
def decode_landmarks(spark, sf_dir):
    df = boxes.decode_landmarks(_decoded(spark, sf_dir)).select("video_id", "frame_id", "cell_y", "cell_x", "landmarks", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("j"))
    at = lambda k: F.bround(F.element_at("landmarks", 2 * F.col("j") + k), 3)
    return df.select("video_id", "frame_id", "cell_y", "cell_x", F.col("j").cast("long").alias("j"), at(1).alias("x"), at(2).alias("y"))


@query(f"""{DECODED} select video_id, frame_id, cell_y, cell_x, round_even(x1 / 1.6, 3) as x1, round_even(y1 / 1.28, 3) as y1, round_even(x2 / 1.6, 3) as x2, round_even(y2 / 1.28, 3) as y2,
  round_even((lm[2]::double * w + x1) / 1.6, 3) as lm_x, round_even((lm[1]::double * h + y1) / 1.28, 3) as lm_y from d""")
def rescale_boxes(spark, sf_dir):
    """Source frames of 20 x 25 pixels, scored at 32 x 32."""
    df = boxes.rescale_boxes(boxes.decode_landmarks(_decoded(spark, sf_dir)), F.lit(1.6), F.lit(1.28))
    at = lambda k: F.bround(F.element_at("landmarks", k), 3)
    return df.select("video_id", "frame_id", "cell_y", "cell_x", *_r3(*BOX_COLUMNS), at(1).alias("lm_x"), at(2).alias("lm_y"))


def grown_sql(source: str, width: str, height: str, keep: str) -> str:
    w, h = "(trunc(x2) - trunc(x1))", "(trunc(y2) - trunc(y1))"
    s = "(1.3e0 - 1.0e0)"
    return f"""select {keep}, greatest(0, round_even(trunc(x1) - {w} * {s}, 0)::int) as gx1, greatest(0, round_even(trunc(y1) - {h} * {s}, 0)::int) as gy1,
  least({width} - 1, round_even(trunc(x2) + {w} * {s}, 0)::int) as gx2, least({height} - 1, round_even(trunc(y2) + {h} * {s}, 0)::int) as gy2 from {source}"""


@query(f"{ctes('frames', 'detections')}, j as (select d.*, f.width, f.height from detections d join frames f using (video_id, frame_id)) {grown_sql('j', 'width', 'height', 'video_id, frame_id, det_idx')}")
def grow_clip_box(spark, sf_dir):
    df = fixture(spark, sf_dir, "detections").join(fixture(spark, sf_dir, "frames").drop("fps"), ["video_id", "frame_id"])
    return boxes.grow_clip_box(df, F.col("width"), F.col("height")).select("video_id", "frame_id", "det_idx", "gx1", "gy1", "gx2", "gy2")


def _slots(i: str) -> str:
    return f"select video_id, frame_id, unnest(range(s, e)) as out_id from (select video_id, frame_id, floor({i} * (25e0 / fps) + 0.5)::bigint as s, floor(({i} + 1) * (25e0 / fps) + 0.5)::bigint as e from frames where frame_id >= 10) where e > s"


@query(f"{ctes('frames')} select video_id, frame_id, unnest(range(s, e)) as out_id from (select video_id, frame_id, floor(frame_id * (25e0 / fps) + 0.5)::bigint as s, floor((frame_id + 1) * (25e0 / fps) + 0.5)::bigint as e from frames) where e > s")
def resample_fps(spark, sf_dir):
    return frames.resample_fps(fixture(spark, sf_dir, "frames"), F.lit(25.0)).select("video_id", "frame_id", "out_id")


@query(f"{ctes('frames')} select video_id, frame_id, round_even((frame_id - 10) / 30e0, 4) as out_pts from frames where frame_id >= 10")
def retime_fps(spark, sf_dir):
    df = fixture(spark, sf_dir, "frames").filter("frame_id >= 10")
    return frames.retime_fps(df, 30.0, F.lit(10)).select("video_id", "frame_id", *r4("out_pts"))


@query(f"{ctes('frames')} select * from ({_slots('(frame_id - 10)')}) where out_id < 60")
def trim_frames(spark, sf_dir):
    return frames.trim_frames(fixture(spark, sf_dir, "frames"), F.lit(10), F.lit(70), F.lit(25.0)).select("video_id", "frame_id", "out_id")


@query(f"""{ctes("frames")}, k as (select *, row_number() over (partition by video_id order by frame_id) - 1 as i from frames where frame_id >= 10 and frame_id % 3 <> 1),
s as (select video_id, frame_id, floor(i * (25e0 / fps) + 0.5)::bigint as s, floor((i + 1) * (25e0 / fps) + 0.5)::bigint as e from k)
select * from (select video_id, frame_id, unnest(range(s, e)) as out_id from s where e > s) where out_id < 60""")
def trim_frames_gaps(spark, sf_dir):
    """Each third frame is missing."""
    kept = fixture(spark, sf_dir, "frames").filter("frame_id % 3 <> 1")
    return frames.trim_frames(kept, F.lit(10), F.lit(70), F.lit(25.0), dense=False).select("video_id", "frame_id", "out_id")


# Progress and telemetry

GOOD = ctes("progress_log") + """, g as (select job_id, line_no, seconds, case when line like 'frame=%' then try_cast(trim(string_split(line, '=')[2]) as bigint) end as frame from progress_log)"""


@query(f"{GOOD} select line_no, frame from g where frame is not null")
def parse_progress(spark, sf_dir):
    return fixture(spark, sf_dir, "progress_log").select("line_no", progress.parse_progress(F.col("line")).alias("frame")).filter("frame is not null")


@query(f"{ctes('progress_log')} select line_no, line as text from progress_log where line_no % 7 <> 0")
def strip_ansi(spark, sf_dir):
    """Lines dressed up with colour codes; each seventh has nothing but codes."""
    dressed = F.when(F.col("line_no") % 7 == 0, "\x1b[1;31m\r").otherwise(F.concat(F.lit("\x1b[32m"), "line", F.lit("\x1b[0m\r")))
    return fixture(spark, sf_dir, "progress_log").select("line_no", progress.strip_ansi(dressed).alias("text")).filter("text is not null")


@query(f"{ctes('ui_updates')} select session_id, seq, case when seq % 11 = 0 then '--:--' else lpad((t_ms // 1000 // 60)::varchar, greatest(2, length((t_ms // 1000 // 60)::varchar))::int, '0') || ':' || lpad((t_ms // 1000 % 60)::varchar, 2, '0') end as text from ui_updates")
def fmt_duration(spark, sf_dir):
    seconds = F.when(F.col("seq") % 11 == 0, float("inf")).otherwise(F.col("t_ms") / 1000)
    return fixture(spark, sf_dir, "ui_updates").select("session_id", "seq", progress.fmt_duration(seconds).alias("text"))


@query(f"""{ctes("ui_updates")} select session_id, seq, case when cur > 0 then floor(t_ms / 1000 / cur * (total - cur) * 1000)::bigint else -1 end as eta_ms,
  case when cur > 0 then floor(t_ms / 1000 / (cur + 1) * (total - cur - 1) * 1000)::bigint else 0 end as eta_by_frame_ms from ui_updates""")
def eta(spark, sf_dir):
    seconds = F.col("t_ms") / 1000
    left, by_frame = progress.eta(seconds, F.col("cur"), F.col("total")), progress.eta_by_frame(seconds, F.col("cur"), F.col("total"))
    ms = lambda x: F.floor(x * 1000).cast("long")
    return fixture(spark, sf_dir, "ui_updates").select("session_id", "seq", F.when(left < float("inf"), ms(left)).otherwise(-1).alias("eta_ms"), ms(by_frame).alias("eta_by_frame_ms"))


@query(f"""{GOOD}, d as (select job_id, line_no, frame, frame - lag(frame, 1, 0) over (partition by job_id order by line_no) as delta from g where frame is not null)
select * from d union all select job_id, null, 1000, 1000 - coalesce(arg_max(frame, line_no) filter (frame is not null), 0) from g group by job_id""")
def progress_delta(spark, sf_dir):
    return logs.progress_delta(fixture(spark, sf_dir, "progress_log"), 1000)


TICKS = """t as (select host_id, {w} as tick, coalesce(sum(cpu_percent) filter (lower(proc_name) like '%ffmpeg%'), 0) as ffmpeg_cpu, max(cpu_total) as cpu_total,
  max(mem_used) as mem_used, max(mem_total) as mem_total, arg_max(v, sample_id) filter (v is not null) as v from k group by 1, 2)"""
SAMPLES = ctes("telemetry") + """, p as (select *, string_split(trim(gpu_csv), ', ') as s from telemetry),
g as (select *, case when len(s) = 4 then list_transform(s, lambda v: try_cast(trim(v) as int)) end as q from p),
k as (select *, case when len(list_filter(q, lambda i: i is not null)) = 4 then q end as v from g)"""
LABEL = "case when v is null then 'gpu_missing' when v[1] < 30 and cpu_total > 60 then 'cpu' when v[1] < 30 and ffmpeg_cpu > 40 then 'decode' when v[1] > 80 then 'gpu_saturated' else 'balanced' end"
BAR = "repeat('#', (trunc(cpu_total)::int // 5)) || repeat('.', greatest(0, 20 - trunc(cpu_total)::int // 5))"


@query(f"{SAMPLES}, {TICKS.format(w='seconds // 3600 * 3600')} select host_id, tick, round_even(ffmpeg_cpu, 3) as ffmpeg_cpu, cpu_total, mem_used, mem_total, v[1] as gpu_util, v[3] as gpu_mem_used from t")
def host_tick(spark, sf_dir):
    df = logs.host_tick(fixture(spark, sf_dir, "telemetry"), 3600)
    return df.select("host_id", "tick", *_r3("ffmpeg_cpu"), "cpu_total", "mem_used", "mem_total", "gpu.gpu_util", F.col("gpu.mem_used").alias("gpu_mem_used"))


@query(f"{ctes('telemetry')} select host_id, round_even(coalesce(sum(cpu_percent) filter (lower(proc_name) like '%ffmpeg%'), 0), 3) as ffmpeg_cpu from telemetry group by 1")
def ffmpeg_cpu(spark, sf_dir):
    return logs.ffmpeg_cpu(fixture(spark, sf_dir, "telemetry"), "host_id").select("host_id", *_r3("ffmpeg_cpu"))


@query(f"{SAMPLES}, {TICKS.format(w='seconds')} select host_id, tick, {LABEL} as bottleneck from t")
def bottleneck(spark, sf_dir):
    df = logs.host_tick(fixture(spark, sf_dir, "telemetry"))
    return df.select("host_id", "tick", telemetry.bottleneck(F.col("gpu.gpu_util"), F.col("cpu_total"), F.col("ffmpeg_cpu")).alias("bottleneck"))


@query(f"{ctes('telemetry')} select sample_id, {BAR} as cpu_bar from telemetry")
def util_bar(spark, sf_dir):
    return fixture(spark, sf_dir, "telemetry").select("sample_id", telemetry.util_bar(F.col("cpu_total")).alias("cpu_bar"))


@query(f"{ctes('telemetry')} select sample_id, mem_used / 1073741824 as used_gib, mem_total / 1073741824 as total_gib, round_even(mem_used * 100.0 / mem_total, 0) as mem_percent from telemetry")
def mem_columns(spark, sf_dir):
    return fixture(spark, sf_dir, "telemetry").select("sample_id", *(c.cast("double").alias(n) for c, n in zip(telemetry.mem_columns(F.col("mem_used"), F.col("mem_total")), ("used_gib", "total_gib", "mem_percent"), strict=True)))


@query(
    ctes("ui_updates").replace("with ", "with recursive ", 1) + """, u as (select *, row_number() over (partition by session_id order by t_ms, seq) as n from ui_updates),
walk(session_id, n, seq, t_ms, cur, total, last, shown) as (select session_id, n, seq, t_ms, cur, total, t_ms, true from u where n = 1
  union all select u.session_id, u.n, u.seq, u.t_ms, u.cur, u.total, case when u.cur >= u.total or u.t_ms - w.last >= 200 then u.t_ms else w.last end,
    u.cur >= u.total or u.t_ms - w.last >= 200 from walk w join u on u.session_id = w.session_id and u.n = w.n + 1)
select session_id, seq, t_ms, cur, total from walk where shown"""
)
def throttle(spark, sf_dir):
    return logs.throttle(fixture(spark, sf_dir, "ui_updates"))


# Pixels

CHANNELS = (1, 3, 4)


def pixel_frames(spark: SparkSession, sf_dir: str, best_only: bool = True) -> DataFrame:
    """Small frames with made-up pixels for the frames of the table, and the detections over 0.8 (or the best of them) scaled into them."""
    found = fixture(spark, sf_dir, "detections").filter("score > 0.8")
    if best_only:
        row = F.struct("score", "det_idx", "x1", "y1", "x2", "y2")
        found = found.groupBy("video_id", "frame_id").agg(F.max(row).alias("r")).select("video_id", "frame_id", "r.*")
    scaled = found.select("video_id", "frame_id", "det_idx", *((F.col(c) / 8).alias(c) for c in BOX_COLUMNS), "score")
    base = fixture(spark, sf_dir, "frames").select(
        "video_id", "frame_id", F.when(F.col("video_id") % 2 == 0, 16).otherwise(20).cast("int").alias("height"), F.when(F.col("video_id") % 2 == 0, 16).otherwise(24).cast("int").alias("width"),
        F.element_at(F.array(*map(F.lit, CHANNELS)), (F.col("frame_id") % 3 + 1).cast("int")).alias("channels"),
    )
    # By the join's key: where the detections are broadcast, frames of one file are many tasks, and where they are not, the join needs no other shuffle.
    df = frames.frames_with_detections(base.repartition(paint_tasks(base), "video_id", "frame_id"), scaled)
    return painted(df, lambda b: of(b, "frame_id") * 31, lambda y, x, c: y * 17 + x * 7 + c * 101)


of = lambda b, name: b.column(name).to_numpy(zero_copy_only=False)


def painted(df: DataFrame, start: Callable, pattern: Callable) -> DataFrame:
    """Adds pixels: a pattern of (y, x, channel) in the frame's shape, and a number of each frame on top; whole bytes, so both are taken modulo 256."""

    def run(batches):
        for b in batches:
            for s in range(0, b.num_rows, 4096):
                some = b.slice(s, 4096)
                shapes, shape_of = np.unique(np.stack([of(some, c) for c in ("height", "width", "channels")], axis=1), axis=0, return_inverse=True)
                tops, parts, rows = (start(some) % 256).astype(np.uint8), [], []
                for k, (h, w, c) in enumerate(shapes.tolist()):
                    y, x, z = np.ogrid[:h, :w, :c]
                    base = np.broadcast_to((pattern(y, x, z) % 256).astype(np.uint8), (h, w, c)).ravel()
                    rows.append(np.nonzero(shape_of.ravel() == k)[0])
                    data = tops[rows[-1], None] + base
                    parts.append(redact.binary_column(data.ravel(), np.arange(len(data) + 1) * len(base), pa.binary()))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.concat_arrays(parts).take(pa.array(np.argsort(np.concatenate(rows))))], names=[*some.schema.names, "pixels"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("pixels", T.BinaryType())]))


#: Frames that a task paints.
FRAMES_A_TASK = 20_000


def dealt(base: DataFrame) -> DataFrame:
    """Frames by ranges of their ids, some ten thousand a task. The keys of a million frames are one row group, and so one task, and a hundred times as
    large when they have pixels; so keys are dealt out before they get them."""
    return base.repartitionByRange(paint_tasks(base), "video_id", "frame_id")


def paint_tasks(base: DataFrame) -> int:
    return max(1, -(-base.count() // FRAMES_A_TASK))


def byte_sums(df: DataFrame) -> DataFrame:
    """Of each frame the sum of its bytes, and that of each byte times its place from 1, which tells moved and swapped values."""

    def run(batches):
        for b in batches:
            data, at = redact.flat_bytes(b.column("pixels"))
            lengths, sums = np.diff(at), np.zeros((b.num_rows, 2), dtype=np.int64)
            for n in np.unique(lengths[lengths > 0]).tolist():
                rows, place = np.nonzero(lengths == n)[0], np.arange(1, n + 1)
                for s in range(0, len(rows), step := max(1, (1 << 20) // n)):
                    some = rows[s : s + step]
                    a = data[at[some[0]] : at[some[-1] + 1]].reshape(-1, n) if at[some[-1] + 1] - at[some[0]] == n * len(some) else np.stack([data[at[k] : at[k] + n] for k in some])
                    sums[some, 0] = a.sum(axis=1, dtype=np.int64)
                    sums[some, 1] = a.astype(np.float64) @ place if n < 1 << 22 else (a * place).sum(axis=1)  # exact: below 2^53
            yield pa.RecordBatch.from_arrays([*(b.column(c).cast(pa.int64()) for c in ("video_id", "frame_id")), *map(pa.array, sums.T)], names=["video_id", "frame_id", "byte_sum", "place_sum"])

    return df.select("video_id", "frame_id", "pixels").mapInArrow(run, "video_id long, frame_id long, byte_sum long, place_sum long")


PLACE = "((y * w + x) * ch + c + 1)"


def sums_sql(value: str, place: str = PLACE) -> str:
    return f"sum({value})::bigint as byte_sum, sum(({value}) * {place})::bigint as place_sum"


PIXELS = ctes("frames", "detections") + f""", pf as (select video_id, frame_id, case when video_id % 2 = 0 then 16 else 20 end as h, case when video_id % 2 = 0 then 16 else 24 end as w,
  [1, 3, 4][frame_id % 3 + 1] as ch from frames),
best as (select video_id, frame_id, unnest(max({{'score': score, 'det_idx': det_idx, 'x1': x1 / 8, 'y1': y1 / 8, 'x2': x2 / 8, 'y2': y2 / 8}})) from detections where score > 0.8 group by 1, 2),
bj as (select * from best join pf using (video_id, frame_id)), gb as ({grown_sql("bj", "w", "h", "video_id, frame_id")}),
px as (select *, unnest(range(0, w)) as x from (select *, unnest(range(0, h)) as y from (select *, unnest(range(0, ch)) as c from pf)))"""


VALUE = "(frame_id * 31 + y * 17 + x * 7 + c * 101) % 256"


@query(f"{PIXELS} select video_id, frame_id, {sums_sql(VALUE)} from px group by 1, 2")
def redact_none(spark, sf_dir):
    return byte_sums(redact.redact_frames(pixel_frames(spark, sf_dir), "none"))


SOLID = f"{PIXELS} select px.video_id, px.frame_id, {sums_sql('case when x between gx1 and gx2 and y between gy1 and gy2 then 0 else (px.frame_id * 31 + y * 17 + x * 7 + c * 101) % 256 end')} from px left join gb on px.video_id = gb.video_id and px.frame_id = gb.frame_id group by 1, 2"


@query(SOLID)
def redact_solid(spark, sf_dir):
    return byte_sums(redact.redact_frames(pixel_frames(spark, sf_dir), "solid"))


IN_MOSAIC = "x between gx1 and least(gx2, gx1 + ((gx2 - gx1 + 3) // 4) * 4 - 1) and y between gy1 and least(gy2, gy1 + ((gy2 - gy1 + 3) // 4) * 4 - 1) and gx2 > gx1 and gy2 > gy1"


MOSAIC = f"""case when {IN_MOSAIC} then (px.frame_id * 31 + (gy1 + (y - gy1) // 4 * 4) * 17 + (gx1 + (x - gx1) // 4 * 4) * 7 + c * 101) % 256
  else (px.frame_id * 31 + y * 17 + x * 7 + c * 101) % 256 end"""


@query(f"{PIXELS} select px.video_id, px.frame_id, {sums_sql(MOSAIC)} from px left join gb on px.video_id = gb.video_id and px.frame_id = gb.frame_id group by 1, 2")
def redact_mosaic(spark, sf_dir):
    return byte_sums(redact.redact_frames(pixel_frames(spark, sf_dir), "mosaic", mosaic_size=4))


def blur_sql(inside: str) -> str:
    """Byte sums with the box filter over the crop, borders mirrored; ``inside`` says which pixels of the crop change."""
    mirror = lambda i, n: f"case when {i} < 0 then -({i}) when {i} >= {n} then 2 * ({n} - 1) - ({i}) else {i} end"
    value = lambda y, x: f"(frame_id * 31 + ({y}) * 17 + ({x}) * 7 + c * 101) % 256"
    return f"""{PIXELS}, cr as (select *, cw // 2 as kw, ch2 // 2 as kh from (select *, gx2 - gx1 as cw, gy2 - gy1 as ch2 from gb) where cw >= 2 and ch2 >= 2),
i as (select px.video_id, px.frame_id, c, {PLACE} as place, x - gx1 as bx, y - gy1 as byy, gx1, gy1, cw, ch2, kw, kh from px join cr on px.video_id = cr.video_id and px.frame_id = cr.frame_id
  and x >= gx1 and x < gx2 and y >= gy1 and y < gy2),
n as (select *, unnest(range(0, kw)) as dx from (select *, unnest(range(0, kh)) as dy from i where {inside})),
f as (select video_id, frame_id, c, bx, byy, any_value(place) as place, any_value({value("gy1 + byy", "gx1 + bx")}) as was, round_even(sum({value(f"gy1 + {mirror('(byy - kh // 2 + dy)', 'ch2')}", f"gx1 + {mirror('(bx - kw // 2 + dx)', 'cw')}")}) / any_value(kw * kh), 0) as now
  from n group by 1, 2, 3, 4, 5),
t as (select video_id, frame_id, sum({value("y", "x")}) as total, sum(({value("y", "x")}) * {PLACE}) as placed from px group by 1, 2)
select video_id, frame_id, (any_value(total) + coalesce(sum(now - was), 0))::bigint as byte_sum, (any_value(placed) + coalesce(sum((now - was) * place), 0))::bigint as place_sum from t left join f using (video_id, frame_id) group by 1, 2"""


@query(blur_sql("true"))
def redact_blur(spark, sf_dir):
    return byte_sums(redact.redact_frames(pixel_frames(spark, sf_dir), "blur", ellipse=False))


CENTRED = "((byy - ch2 // 2) / (ch2 // 2)::double) * ((byy - ch2 // 2) / (ch2 // 2)::double) + ((bx - cw // 2) / (cw // 2)::double) * ((bx - cw // 2) / (cw // 2)::double)"


@query(blur_sql(f"{CENTRED} < 1"))
def redact_blur_ellipse(spark, sf_dir):
    return byte_sums(redact.redact_frames(pixel_frames(spark, sf_dir), "blur"))


# The queries above see the best box of each frame, as their SQL does; these see all boxes over 0.8, in the order of det_idx.

ALL_BOXES = ctes("frames", "detections") + f""", pf as (select video_id, frame_id, case when video_id % 2 = 0 then 16 else 20 end as h, case when video_id % 2 = 0 then 16 else 24 end as w,
  [1, 3, 4][frame_id % 3 + 1] as ch from frames),
aj as (select video_id, frame_id, det_idx, x1 / 8 as x1, y1 / 8 as y1, x2 / 8 as x2, y2 / 8 as y2, w, h from detections join pf using (video_id, frame_id) where score > 0.8),
ab as ({grown_sql("aj", "w", "h", "video_id, frame_id")}),
al as (select video_id, frame_id, list({{'gx1': gx1, 'gy1': gy1, 'gx2': gx2, 'gy2': gy2}}) as covers from ab group by 1, 2),
ax as (select *, unnest(range(0, w)) as x from (select *, unnest(range(0, h)) as y from (select *, unnest(range(0, ch)) as c from pf left join al using (video_id, frame_id))))"""


@query(f"""{ALL_BOXES} select video_id, frame_id, {sums_sql(f"case when len(list_filter(covers, lambda b: x between b.gx1 and b.gx2 and y between b.gy1 and b.gy2)) > 0 then 0 else {VALUE} end")} from ax group by 1, 2""")
def redact_solid_all(spark, sf_dir):
    return byte_sums(redact.redact_frames(pixel_frames(spark, sf_dir, best_only=False), "solid"))


@query()
def redact_mosaic_all(spark, sf_dir):
    return byte_sums(redact.redact_frames(pixel_frames(spark, sf_dir, best_only=False), "mosaic", mosaic_size=4))


@query()
def redact_blur_all(spark, sf_dir):
    return byte_sums(redact.redact_frames(pixel_frames(spark, sf_dir, best_only=False), "blur", ellipse=False))


@query()
def redact_blur_ellipse_all(spark, sf_dir):
    return byte_sums(redact.redact_frames(pixel_frames(spark, sf_dir, best_only=False), "blur"))


def bilinear_sql(value: Callable[[str, str], str]) -> str:
    """A value between the pixels (iy0, ix0) and (iy1, ix1), at the fractions fy and fx."""
    row = lambda y: f"(({value(y, 'ix0')}) * (1 - fx) + ({value(y, 'ix1')}) * fx)"
    return f"({row('iy0')} * (1 - fy) + {row('iy1')} * fy)"


def source_sql(out: str, n_out: str, n: str, axis: str) -> str:
    return f"greatest(0e0, least({n} - 1, ({out} + 0.5e0) * {n} / {n_out} - 0.5e0)) as s{axis}"


TAPS = "floor(sy)::int as iy0, least(floor(sy)::int + 1, ny - 1) as iy1, sy - floor(sy) as fy, floor(sx)::int as ix0, least(floor(sx)::int + 1, nx - 1) as ix1, sx - floor(sx) as fx"
IMAGE = lambda c: f"round_even({bilinear_sql(lambda y, x: f'(20 * {y} + 4 * {x} + {c})')}, 0)"


@query(f"""{ALL_BOXES}, ib as ({grown_sql("aj", "w", "h", "video_id, frame_id, det_idx")}),
all_px as (select *, unnest(range(0, w)) as x from (select *, unnest(range(0, h)) as y from (select *, unnest(range(0, ch)) as c from pf))),
hit as (select *, 6 as ny, 5 as nx, {source_sql("(y - gy1)", "(gy2 - gy1)", "6", "y")}, {source_sql("(x - gx1)", "(gx2 - gx1)", "5", "x")}
  from all_px join ib using (video_id, frame_id) where c < 3 and x >= gx1 and x < gx2 and y >= gy1 and y < gy2),
tap as (select *, {TAPS} from hit),
drawn as (select video_id, frame_id, c, y, x, list({{'a': {IMAGE("3")} / 255, 'r': {IMAGE("c")}}} order by det_idx) as d from tap group by 1, 2, 3, 4, 5),
v as (select p.*, {VALUE} as was, d from all_px p left join drawn using (video_id, frame_id, c, y, x)),
n as (select *, case when d is null then was else list_reduce(list_prepend({{'a': 0e0, 'r': was::double}}, d), lambda p, q: {{'a': 0e0, 'r': trunc(p.r * (1 - q.a) + q.r * q.a)}}).r end as now from v)
select video_id, frame_id, {sums_sql("now")} from n group by 1, 2""")
def redact_img(spark, sf_dir):
    image = np.arange(6 * 5 * 4, dtype=np.uint8).reshape(6, 5, 4)
    return byte_sums(redact.redact_frames(pixel_frames(spark, sf_dir, best_only=False), "img", image=image))


@query(f"""{PIXELS}, o as (select *, h as ny, w as nx, {source_sql("oy", "10", "h", "y")}, {source_sql("ox", "12", "w", "x")}
  from (select *, unnest(range(0, 12)) as ox from (select *, unnest(range(0, 10)) as oy from (select *, unnest(range(0, ch)) as c from pf)))),
tap as (select *, {TAPS} from o), r as (select *, round_even({bilinear_sql(lambda y, x: f"((frame_id * 31 + {y} * 17 + {x} * 7 + c * 101) % 256)")}, 0) as v from tap)
select video_id, frame_id, {sums_sql("v", "((oy * 12 + ox) * ch + c + 1)")} from r group by 1, 2""")
def resize_frames(spark, sf_dir):
    return byte_sums(redact.resize_frames(pixel_frames(spark, sf_dir), 12, 10))


@query(SOLID)
def write_redacted(spark, sf_dir):
    """Written to the shared folder, partitioned by video, and read again."""
    root = new_folder(spark, "redacted")
    sinks.write_redacted(redact.redact_frames(pixel_frames(spark, sf_dir), "solid"), root)
    return byte_sums(spark.read.parquet(root).withColumn("video_id", F.col("video_id").cast("long")))


@query(f"""{PIXELS}, rgb as (select *, case when ch = 1 then k else c end as k3 from px, unnest([0, 1, 2]) as t(k) where case when ch = 1 then true else c = k end)
select video_id, frame_id, {sums_sql(VALUE, "((y * w + x) * 3 + k3 + 1)")} from rgb group by 1, 2""")
def ensure_rgb(spark, sf_dir):
    return byte_sums(redact.rgb_frames(pixel_frames(spark, sf_dir)))


@query(f"""{PIXELS}, k as (select n, k, greatest(0e0, least(n - 1, (k + 0.5e0) * n / 32 - 0.5e0)) as s from (select unnest([16, 20, 24]) as n), range(0, 32) as r(k)),
taps as (select n, k, floor(s)::int as i, 1 - (s - floor(s)) as t from k union all select n, k, least(floor(s)::int + 1, n - 1), s - floor(s) from k),
wt as (select n, i, sum(t) as t, sum(t * k) as tk from taps group by 1, 2),
rgb as (select *, case when ch = 1 then k else c end as k3 from px, unnest([0, 1, 2]) as u(k) where case when ch = 1 then true else c = k end)
select video_id, frame_id, round(sum(({VALUE}) * a.t * b.t), 2) as input_sum, round(sum(({VALUE}) * ((k3 * 1024 + 1) * a.t * b.t + 32 * a.tk * b.t + a.t * b.tk)), 2) as place_sum
from rgb join wt a on a.n = h and a.i = y join wt b on b.n = w and b.i = x group by 1, 2""")
def network_input(spark, sf_dir):
    """What the model gets: the sum of each frame's resized channels, and that of each value times its place from 1."""

    def run(batches):
        place = np.arange(1, 3 * 32 * 32 + 1, dtype=np.float64)
        for b in batches:
            data, at = redact.flat_bytes(b.column("pixels"))
            sizes, sums = np.stack([of(b, c) for c in ("height", "width", "channels")], axis=1), np.zeros((b.num_rows, 2))
            for shape in np.unique(sizes, axis=0):
                rows = np.nonzero((sizes == shape).all(axis=1))[0]
                for s in range(0, len(rows), 1024):
                    some = rows[s : s + 1024]
                    flat = pixels.to_network_input([data[at[k] : at[k + 1]].reshape(shape) for k in some.tolist()], 32, 32).reshape(len(some), -1).astype(np.float64)
                    sums[some] = np.stack([flat.sum(axis=1), flat @ place], axis=1)
            yield pa.RecordBatch.from_arrays([b.column("video_id"), b.column("frame_id"), *map(pa.array, np.round(sums, 2).T)], names=["video_id", "frame_id", "input_sum", "place_sum"])

    return pixel_frames(spark, sf_dir).drop("boxes").mapInArrow(run, "video_id long, frame_id long, input_sum double, place_sum double")


def bright_model():
    """Faces are where a cell's mean is high; all of one size."""

    def run(x: np.ndarray):
        b, _, h, w = x.shape
        rows = x.reshape(b, 3, h // 4, 4, w).sum(axis=3, dtype=np.float64)
        cells = sum(rows[..., k::4] for k in range(4)) / 16 / 255
        flat = np.zeros_like(cells[:, :2])
        return cells.mean(axis=1, keepdims=True), flat, flat, np.zeros((b, 10, h // 4, w // 4))

    return run


def toy_model():
    """Bright cells are faces; sizes and landmarks come from the colours."""

    def run(x: np.ndarray):
        b, _, h, w = x.shape
        cells = x.reshape(b, 3, h // 4, 4, w // 4, 4).mean(axis=(3, 5)) / 255
        marks = np.repeat(cells[:, :1], 10, axis=1) - 0.5
        return cells.mean(axis=1, keepdims=True), cells[:, :2], cells[:, 1:] - 0.5, marks

    return run


SPREAD = "(frame_id * 29 + y * y * 17 + x * 7 * y + video_id) % 256"
SCORED = f"""{ctes("frames")}, sized as (select video_id, frame_id, case video_id % 3 when 0 then 64 else 32 end as w from frames),
px as (select *, unnest(range(0, w)) as x from (select *, unnest(range(0, 32)) as y from sized)),
cell as (select video_id, frame_id, y // 4 as cy, x // 4 as cx, sum({SPREAD}) / 16e0 / 255 as heat from px group by 1, 2, 3, 4),
face as (select * from cell where heat > 0.7501)"""


def spread_frames(base: DataFrame) -> DataFrame:
    """Frames with one channel, two shapes and made-up pixels for (video_id, frame_id)."""
    size = base.select("video_id", "frame_id", F.lit(32).alias("height"), F.when(F.col("video_id") % 3 == 0, 64).otherwise(32).cast("int").alias("width"), F.lit(1).alias("channels"))

    return painted(size, lambda b: of(b, "frame_id") * 29 + of(b, "video_id"), lambda y, x, c: y * y * 17 + x * 7 * y)


@query(f"""{SCORED} select s.video_id, s.frame_id, count(heat)::int as n_boxes, coalesce(round(sum(4 * (cx + cy) + 4 * (cx + cy + 2)), 3), 0)::double as corner_sum, round(coalesce(sum(heat), 0), 6) as score_sum
from sized s left join face f on s.video_id = f.video_id and s.frame_id = f.frame_id group by 1, 2""")
def score_frames(spark, sf_dir):
    """Cells that are bright on average are faces of four pixels."""
    scored = redact.score_frames(spread_frames(dealt(fixture(spark, sf_dir, "frames").select("video_id", "frame_id"))), bright_model, threshold=0.7501)
    total = lambda *names: F.aggregate("boxes", F.lit(0.0), lambda n, b: sum((b[c] for c in names), n))
    return scored.select("video_id", "frame_id", F.size("boxes").alias("n_boxes"), F.round(total(*BOX_COLUMNS), 3).alias("corner_sum"), F.round(total("score"), 6).alias("score_sum"))


def write_files(df: DataFrame, root: str) -> None:
    """Writes the binary column ``content`` of each row to the file ``name`` below ``root``."""

    def run(batches):
        for b in batches:
            for name, content in zip(b["name"], b["content"], strict=True):
                where, path = fs.FileSystem.from_uri(f"{root}/{name}")
                where.create_dir(path.rsplit("/", 1)[0], recursive=True)
                with where.open_output_stream(path) as f:
                    f.write(content)
            yield b[["name"]]

    df.select("name", "content").mapInPandas(run, "name string").write.format("noop").mode("overwrite").save()


LISTED = ["mp4", "MP4", "Mov", "avi", "mkv", "txt", "jpg"]


def _listing(spark, sf_dir) -> str:
    """A file for each supplier, in five folders; some begin with a dot or an underscore, some are empty."""
    root, key = new_folder(spark, "listing"), F.col("s_suppkey")
    mark = F.when(key % 11 == 0, ".").when(key % 11 == 1, "_").otherwise("")
    name = F.concat(F.lit("d"), (key % 5).cast("string"), F.lit("/"), mark, F.lit("s"), key.cast("string"), F.lit("."), F.element_at(F.array(*map(F.lit, LISTED)), (key % 7 + 1).cast("int")))
    df = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(name.alias("name"), F.encode(F.expr("repeat('x', cast(s_suppkey % 10 * 9 as int))"), "UTF-8").alias("content"))
    write_files(df, root)
    return root


LISTING = f"""with l as (select 'd' || s_suppkey % 5 as folder, {LISTED}[s_suppkey % 7 + 1] as ext,
  case s_suppkey % 11 when 0 then '.' when 1 then '_' else '' end || 's' || s_suppkey || '.' || {LISTED}[s_suppkey % 7 + 1] as name, s_suppkey % 10 * 9 as size_bytes from supplier)"""


@query(f"{LISTING} select name, size_bytes from l where ext in {tuple(VIDEO_EXTENSIONS)} and folder <> 'd4' and name not like '.%'")
def list_media(spark, sf_dir):
    """Files written for each supplier, listed by extension in four of their folders."""
    root = _listing(spark, sf_dir)
    found = files.scan_media(spark, [f"{root}/d{k}" for k in range(4)])
    return found.select(F.regexp_replace("path", "^.*/", "").alias("name"), "size_bytes")


@query(f"""{LISTING}{values("mime", "ext, mime", MIME)}, t as (select folder, size_bytes, case when mime like 'video%' then 'video' when mime like 'image%' then 'image' else mime end as file_type
  from l left join mime on lower(l.ext) = mime.ext) select folder, file_type, count(*) as n_files, sum(size_bytes)::bigint as size_bytes from t group by 1, 2""")
def list_all_files(spark, sf_dir):
    """All of them, then classified by their names."""
    root = _listing(spark, sf_dir)
    found = media.classify_media(files.scan_all_files(spark, [f"{root}/d{k}" for k in range(5)]))
    return found.groupBy(F.regexp_extract("path", "([^/]*)/[^/]*$", 1).alias("folder"), "file_type").agg(F.count("*").alias("n_files"), F.sum("size_bytes").alias("size_bytes"))


@query("""with f as (select doc_id // 100 as k, string_agg(coalesce(text, ''), '' order by doc_id) as t from documents group by 1), h as (select k, hex(encode(t)) as x from f),
n as (select k, x, unnest(range(0, length(x) // 2 // 3072)) as frame_id from h) select 'r' || k || '.raw' as name, frame_id, md5(substr(x, frame_id * 6144 + 1, 6144)) as pixels_md5 from n""")
def read_raw_files(spark, sf_dir):
    """The texts of a hundred documents each, written as a raw stream of 64 x 16 frames, and all streams read by ranges of ten frames."""
    root = new_folder(spark, "raw")
    rows = F.transform(F.sort_array(F.collect_list(F.struct("doc_id", F.coalesce("text", F.lit("")).alias("text")))), lambda r: r["text"])
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").groupBy(F.floor(F.col("doc_id") / 100).alias("k")).agg(F.encode(F.array_join(rows, ""), "UTF-8").alias("content"))
    write_files(docs.select(F.concat(F.lit("r"), F.col("k").cast("string"), F.lit(".raw")).alias("name"), "content"), root)
    found = files.read_raw_frames(spark, root, 64, 16, range_bytes=10 * 3072)
    return found.select(F.regexp_replace("path", "^.*/", "").alias("name"), "frame_id", F.md5(F.hex("pixels")).alias("pixels_md5"))


def _images(spark, sf_dir) -> DataFrame:
    """An image for each supplier, 9 x 7 pixels, written as a bitmap and read again."""
    root = new_folder(spark, "images")

    def encode_images(batches):
        for b in batches:
            out = []
            for k in b["s_suppkey"].tolist():
                y, x, c = np.ogrid[:7, :9, :3]
                rows = np.pad(((k * 31 + y * 17 + x * 7 + c * 101) % 256).astype(np.uint8)[::-1, :, ::-1].reshape(7, 27), ((0, 0), (0, 1)))
                out.append(b"BM" + struct.pack("<IHHIIiiHHIIiiII", 54 + rows.size, 0, 0, 54, 40, 9, 7, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes())
            yield pd.DataFrame({"name": [f"i{k}.bmp" for k in b["s_suppkey"]], "content": out})

    keys = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey")
    write_files(keys.mapInPandas(encode_images, "name string, content binary"), root)
    found = files.read_images(spark, root)
    return found.withColumn("video_id", F.regexp_extract("path", "i([0-9]+).bmp$", 1).cast("long")).withColumn("frame_id", F.lit(0).cast("long"))


IMAGES = "with px as (select s_suppkey as video_id, 0::bigint as frame_id, s_suppkey as k, 9 as w, 7 as h, 3 as ch, y, x, c from supplier, range(0, 7) as a(y), range(0, 9) as b(x), range(0, 3) as d(c))"
IMAGE_VALUE = "(k * 31 + y * 17 + x * 7 + c * 101) % 256"


@query(f"{IMAGES} select video_id, frame_id, {sums_sql(IMAGE_VALUE)} from px group by 1, 2")
def read_images(spark, sf_dir):
    return byte_sums(_images(spark, sf_dir))


TWO = f"case when y <= 3 and x <= 4 or y >= 3 and x >= 4 and k % 2 = 0 then 9 else {IMAGE_VALUE} end"


@query(f"{IMAGES} select video_id, frame_id, {sums_sql(TWO)} from px group by 1, 2")
def redact_images(spark, sf_dir):
    """One box in the odd images, two that overlap in the even ones."""
    box = lambda k, *at: F.struct(F.lit(k).alias("det_idx"), *(F.lit(float(v)).alias(n) for v, n in zip(at, BOX_COLUMNS, strict=True)))
    boxed = _images(spark, sf_dir).withColumn("boxes", F.when(F.col("video_id") % 2 == 0, F.array(box(1, 4, 3, 9, 9), box(0, 0, 0, 4, 3))).otherwise(F.array(box(0, 0, 0, 4, 3))))
    return byte_sums(redact.redact_images(boxed, "solid", mask_scale=1.0, color=(9, 9, 9)))


@query(f"""{ctes("frames")}, px as (select video_id, frame_id, y // 4 as cy, x // 4 as cx, avg((frame_id * 29 + y * y * 17 + x * 7 * y) % 256) / 255 as heat from frames, range(0, 32) as a(y), range(0, 32) as b(x) group by 1, 2, 3, 4),
f as (select video_id, frame_id, max(heat) > 0.8001 as face from px group by 1, 2)
select '/cam/d' || video_id % 5 as dir, 'v' || video_id || '.mp4' as filename, count(*) as total_frames, count(*) filter (face) as face_frames, round_even(count(*) filter (face) / count(*), 4) as face_ratio
from f where video_id % 10 <> 9 group by video_id""")
def redact_videos(spark, sf_dir):
    """The whole job, run twice into one folder: the second run's statistics have the second run's frames alone, and none of cameras."""
    camera = F.col("video_id") % 10 == 9
    path = F.concat(F.lit("/cam/d"), (F.col("video_id") % 5).cast("string"), F.lit("/v"), F.col("video_id").cast("string"), F.lit(".mp4"))
    base = fixture(spark, sf_dir, "frames").select("video_id", "frame_id", F.when(camera, "<video0>").otherwise(path).alias("path"), *(F.lit(n).cast("int").alias(c) for c, n in (("height", 32), ("width", 32), ("channels", 1))))

    frames_ = painted(dealt(base), lambda b: of(b, "frame_id") * 29, lambda y, x, c: y * y * 17 + x * 7 * y)
    root = new_folder(spark, "videos")
    for _ in range(2):
        stats = redaction.redact_videos(frames_, bright_model, f"{root}/out", f"{root}/stats", mode="solid", threshold=0.8001)
    return stats.select("dir", "filename", "total_frames", "face_frames", F.bround("face_ratio", 4).alias("face_ratio"))


# Streams


def _stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    path = f"{sf_dir}/{table}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")  # a stream takes one file only by a pattern


def _streamed(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    path = new_folder(spark, name)
    streams.run_available(df, f"{path}/out", f"{path}/state")
    return spark.read.schema(df.schema).parquet(f"{path}/out")


def _from_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture over a stream of events."""
    return spark.sql(re.sub(r"from events\b", "from {events}", FIXTURES[name]), events=_stream(spark, sf_dir, "events"))


@query(
    f"""{SAMPLES}, {TICKS.format(w="seconds // 3600 * 3600")}, lim as (select max(ts) - interval 10 second as mark from telemetry)
select host_id, tick, round_even(ffmpeg_cpu, 3) as ffmpeg_cpu, {LABEL} as bottleneck, {BAR} as cpu_bar from t, lim where tick + 3600 <= epoch(mark)"""
)
def telemetry_stream(spark, sf_dir):
    """Hours that the watermark has passed when the stream is at its end."""
    samples = _from_stream(spark, sf_dir, "telemetry").withColumn("ts", F.col("ts").cast("timestamp"))
    out = streams.telemetry_stream(samples, "1 hour")
    return _streamed(spark, out, "ticks").select("host_id", "tick", *_r3("ffmpeg_cpu"), "bottleneck", "cpu_bar")


@query(f"""{GOOD} select job_id, arg_max(frame, line_no) filter (frame is not null) as frame, (max(seconds) - min(seconds))::bigint as elapsed,
  arg_max(frame, line_no) filter (frame is not null) / 1000 as done from g group by 1""")
def progress_stream(spark, sf_dir):
    log = _from_stream(spark, sf_dir, "progress_log").withColumn("seconds", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long"))
    path = new_folder(spark, "progress")
    latest = streams.progress_stream(log, 1000).select("job_id", "frame", "elapsed", "done")

    def updated(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/out/epoch={epoch}")  # the same folder if the batch is run again

    latest.writeStream.foreachBatch(updated).outputMode("update").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(latest.schema).parquet(f"{path}/out")
    return rows.groupBy("job_id").agg(*(F.max_by(c, "epoch").alias(c) for c in ("frame", "elapsed", "done")))


NEAR = "list_contains(c, ({y}) * 16 + {x})"
COVERED = " or ".join(NEAR.format(y=y, x=x) + on for y, x, on in (
    ("y // 4", "x // 4", ""), ("y // 4", "(x // 4 - 1)", " and x % 4 = 0 and x > 0"), ("y // 4 - 1", "x // 4", " and y % 4 = 0 and y > 0"), ("y // 4 - 1", "(x // 4 - 1)", " and x % 4 = 0 and y % 4 = 0 and x > 0 and y > 0"),
))


@query(f"""{SCORED}, faces as (select video_id, frame_id, list(cy * 16 + cx) as c from face group by 1, 2),
v as (select p.video_id, p.frame_id, y * w + x + 1 as place, case when c is not null and ({COVERED}) then 0 else {SPREAD.replace("frame_id", "p.frame_id").replace("video_id", "p.video_id")} end as v
  from px p left join faces f on p.video_id = f.video_id and p.frame_id = f.frame_id)
select video_id, frame_id, sum(v)::bigint as byte_sum, sum(v * place)::bigint as place_sum from v group by 1, 2""")
def frame_stream(spark, sf_dir):
    """Frames of orders as they come, scored and redacted; a box covers its last row and column too."""
    base = _stream(spark, sf_dir, "orders").select((F.col("o_orderkey") % 50).alias("video_id"), F.floor(F.col("o_orderkey") / 50).cast("long").alias("frame_id"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # a stream's rows are not counted before
    out = streams.frame_stream(spread_frames(base.repartition(tasks, "video_id", "frame_id")), bright_model, "solid", threshold=0.7501, mask_scale=1.0)
    path = new_folder(spark, "frames")
    streams.run_by_epoch(out, f"{path}/out", f"{path}/state")
    return byte_sums(streams.read_epochs(spark, f"{path}/out", out.schema))


def _rocksdb(spark: SparkSession, run: Callable[[], DataFrame]) -> DataFrame:
    """Runs a stream that keeps its state in RocksDB."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return run()
    finally:
        spark.conf.set(key, before)


@query(ORACLES["progress_delta"])
def progress_delta_stream(spark, sf_dir):
    """A second stream has one line a year later, whose time completes all jobs."""
    log = _from_stream(spark, sf_dir, "progress_log").withColumn("ts", F.col("ts").cast("timestamp"))
    path = new_folder(spark, "beat")
    last = fixture(spark, sf_dir, "progress_log").agg((F.max(F.col("ts").cast("timestamp")) + F.expr("interval 365 days")).alias("ts"))
    last.select(F.lit(-1).cast("long").alias("job_id"), F.lit(0).cast("long").alias("line_no"), "ts", F.lit("progress=end").alias("line")).write.parquet(path)
    beat = spark.readStream.schema(log.schema).parquet(path)
    out = streams.progress_delta_stream(log.unionByName(beat), 1000)
    return _rocksdb(spark, lambda: _streamed(spark, out, "deltas")).filter("job_id <> -1")


@query(f"""{ctes("telemetry")}, p as (select *, string_split(trim(gpu_csv), ', ') as s from telemetry),
q as (select *, case when len(s) = 4 then list_transform(s, lambda v: try_cast(trim(v) as int)) end as q from p),
k as (select * exclude (cpu_total), cpu_total, case when host_id % 3 <> 0 and len(list_filter(q, lambda i: i is not null)) = 4 then q end as v from q),
{TICKS.format(w="seconds // 3600 * 3600")}, lim as (select least(max(ts), max(ts) filter (host_id % 3 <> 0)) - interval 10 second as mark from telemetry)
select host_id, tick, round_even(ffmpeg_cpu, 3) as ffmpeg_cpu, {LABEL} as bottleneck from t, lim where tick + 3600 <= epoch(mark)""")
def host_tick_joined(spark, sf_dir):
    """Samples of processes and of GPUs as two streams; each third host has no GPU samples."""
    rows = lambda: _from_stream(spark, sf_dir, "telemetry").withColumn("ts", F.col("ts").cast("timestamp"))
    out = streams.host_tick_joined(rows(), rows().filter("host_id % 3 <> 0").select("ts", "host_id", "sample_id", "gpu_csv"), "1 hour")
    return _streamed(spark, out, "joined").select("host_id", "tick", *_r3("ffmpeg_cpu"), "bottleneck")


@query(ORACLES["throttle"])
def throttle_stream(spark, sf_dir):
    out = streams.throttle_stream(_from_stream(spark, sf_dir, "ui_updates"), late="1 second")
    return _rocksdb(spark, lambda: _streamed(spark, out, "throttle"))
