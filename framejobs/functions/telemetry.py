"""Columns of telemetry samples."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GIB = 1024**3


def parse_gpu_csv(line: Column) -> Column:
    """A struct of four integers, or null if there are not four or one is bad."""
    parts = F.split(F.trim(line), ", ")
    names = ("gpu_util", "mem_util", "mem_used", "mem_total")
    values = [F.trim(F.try_element_at(parts, F.lit(i + 1))).try_cast("int") for i in range(4)]
    good = F.size(parts) == 4
    for v in values:
        good &= v.isNotNull()
    return F.when(good, F.struct(*(v.alias(n) for v, n in zip(values, names, strict=True))))


def is_ffmpeg(name: Column) -> Column:
    return F.coalesce(F.lower(name).contains("ffmpeg"), F.lit(False))


def bottleneck(gpu_util: Column, cpu: Column, ffmpeg_cpu: Column) -> Column:
    return (
        F.when(gpu_util.isNull(), "gpu_missing").when((gpu_util < 30) & (cpu > 60), "cpu").when((gpu_util < 30) & (ffmpeg_cpu > 40), "decode")
        .when(gpu_util > 80, "gpu_saturated").otherwise("balanced")
    )


def util_bar(percent: Column) -> Column:
    """Twenty characters, a # for each full five percent."""
    n = F.floor(percent.cast("int") / 5).cast("int")
    return F.concat(F.repeat(F.lit("#"), F.greatest(n, F.lit(0))), F.repeat(F.lit("."), F.greatest(20 - n, F.lit(0))))


def mem_columns(used: Column, total: Column) -> list[Column]:
    """Used and total in GiB with one decimal, and the percentage."""
    return [F.bround(used / GIB, 1).alias("used_gib"), F.bround(total / GIB, 1).alias("total_gib"), F.bround(F.try_divide(used * 100.0, total.cast("double")), 0).alias("mem_percent")]
