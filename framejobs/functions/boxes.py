"""Columns of boxes and landmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def decode_boxes(cells: DataFrame, width: int, height: int, threshold: float = 0.2, stride: int = 4) -> DataFrame:
    """Cells over the threshold as boxes: adds x1, y1, x2, y2, score and the box's sizes w, h before clipping."""
    d = lambda c: F.col(c).cast("double")
    zero = F.lit(0.0)
    out = cells.filter(d("heat") > threshold).withColumn("h", F.exp(d("scale0")) * stride).withColumn("w", F.exp(d("scale1")) * stride)
    x1 = F.least(F.greatest(zero, (F.col("cell_x") + d("off1") + 0.5) * stride - F.col("w") / 2), F.lit(float(width)))
    y1 = F.least(F.greatest(zero, (F.col("cell_y") + d("off0") + 0.5) * stride - F.col("h") / 2), F.lit(float(height)))
    out = out.withColumn("x1", x1).withColumn("y1", y1)
    out = out.withColumn("x2", F.least(F.col("x1") + F.col("w"), F.lit(float(width)))).withColumn("y2", F.least(F.col("y1") + F.col("h"), F.lit(float(height))))
    return out.withColumn("score", d("heat"))


def decode_landmarks(boxes: DataFrame) -> DataFrame:
    """Adds landmarks: x and y of five points, from the cell's lm and its box."""
    at = lambda i: F.element_at(F.col("lm"), i.cast("int") + 1).cast("double")
    points = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda j: F.array(at(2 * j + 1) * F.col("w") + F.col("x1"), at(2 * j) * F.col("h") + F.col("y1")))
    return boxes.withColumn("landmarks", F.flatten(points))


def rescale_boxes(df: DataFrame, scale_w: Column, scale_h: Column) -> DataFrame:
    """Boxes, and landmarks if there are any, back in source pixels."""
    out = df.withColumns({"x1": F.col("x1") / scale_w, "x2": F.col("x2") / scale_w, "y1": F.col("y1") / scale_h, "y2": F.col("y2") / scale_h})
    if "landmarks" in df.columns:
        out = out.withColumn("landmarks", F.transform("landmarks", lambda v, i: F.when(i % 2 == 0, v / scale_w).otherwise(v / scale_h)))
    return out


def grow_clip_box(df: DataFrame, width: Column, height: Column, mask_scale: float = 1.3) -> DataFrame:
    """Adds gx1, gy1, gx2, gy2: truncated, grown on each side by (mask_scale - 1) times the size, rounded half to even, clipped to the frame."""
    s = mask_scale - 1.0
    t = {c: F.col(c).cast("int") for c in ("x1", "y1", "x2", "y2")}
    w, h = t["x2"] - t["x1"], t["y2"] - t["y1"]
    low = lambda v: F.greatest(F.lit(0), F.rint(v).cast("int"))
    high = lambda v, size: F.least(size - 1, F.rint(v).cast("int"))
    return df.withColumns({
        "gx1": low(t["x1"] - w * s), "gy1": low(t["y1"] - h * s), "gx2": high(t["x2"] + w * s, width), "gy2": high(t["y2"] + h * s, height),
    })
