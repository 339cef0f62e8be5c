"""Detections: their order, and suppression of overlapping ones."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framejobs.operators.pixels import suppress_groups

KEY = ["video_id", "frame_id"]
#: Boxes of a frame up to which each is compared with all kept ones.
MANY = 100
#: Boxes of crowded frames that are compared in one go.
BOXES_AT_ONCE = 200_000


def det_index(boxes: DataFrame) -> DataFrame:
    """Adds det_idx: a frame's detections in the order of their cells, row by row."""
    order = Window.partitionBy(*KEY).orderBy("cell_y", "cell_x")
    return boxes.withColumn("det_idx", (F.row_number().over(order) - 1).cast("int"))


def _overlap(a, b, limit: float):
    w = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    h = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    area = lambda r: (r["x2"] - r["x1"]) * (r["y2"] - r["y1"])
    union = area(a) + area(b) - w * h
    return (union > 0) & (w * h >= F.lit(limit) * union)


def nms(detections: DataFrame, limit: float = 0.3, many: int = MANY) -> DataFrame:
    """Detections that no better kept one of their frame overlaps by ``limit`` or more. Of equal scores the higher index is better. Two empty
    boxes do not overlap. Frames of up to ``many`` boxes are folded by built-in expressions, which compare each box with all kept ones; larger ones
    compare it with those beside it, many frames at a time."""
    fields = F.struct("score", "det_idx", "x1", "y1", "x2", "y2")
    ranked = detections.groupBy(*KEY).agg(F.sort_array(F.collect_list(fields), False).alias("boxes"))
    none = F.array().cast(ranked.schema["boxes"].dataType)
    kept = F.aggregate("boxes", none, lambda got, b: F.when(F.exists(got, lambda k: _overlap(k, b, limit)), got).otherwise(F.concat(got, F.array(b))))
    few = ranked if limit <= 0 else ranked.filter(F.size("boxes") <= many)
    out = few.select(*KEY, F.inline(kept))
    if limit > 0:
        out = out.unionByName(_thinned(ranked.filter(F.size("boxes") > many), limit).select(*KEY, F.inline("boxes")))
    return out.select(*KEY, "det_idx", "x1", "y1", "x2", "y2", "score")


def _thinned(frames: DataFrame, limit: float) -> DataFrame:
    """Frames with their ``boxes``, best first, without the suppressed ones."""

    def run(batches):
        for b in batches:
            ends, row = b.column("boxes").value_lengths().to_numpy(zero_copy_only=False).cumsum(), 0
            while row < b.num_rows:
                began = ends[row - 1] if row else 0
                some = b.slice(row, max(1, int(np.searchsorted(ends, began + BOXES_AT_ONCE, side="right")) - row))
                row += some.num_rows
                lists = some.column("boxes")
                boxes, lengths = lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False)
                corners = np.stack([boxes.field(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("x1", "y1", "x2", "y2")], axis=1)
                frame = np.repeat(np.arange(some.num_rows), lengths)
                kept = suppress_groups(corners, frame, limit)
                at = np.concatenate(([0], np.bincount(frame[kept], minlength=some.num_rows).cumsum()))
                out = pa.ListArray.from_arrays(pa.array(at, pa.int32()), boxes.filter(pa.array(kept)))
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], out], names=some.schema.names)

    return frames.select(*KEY, "boxes").mapInArrow(run, frames.select(*KEY, "boxes").schema)
