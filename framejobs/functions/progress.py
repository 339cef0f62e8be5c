"""Columns of progress logs and displays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_progress(line: Column) -> Column:
    """The frame number of a progress line; null for other lines and bad numbers."""
    value = F.try_element_at(F.split(line, "="), F.lit(2))
    return F.when(line.startswith("frame="), F.trim(value).try_cast("long"))


def strip_ansi(text: Column) -> Column:
    """Without colour codes and carriage returns; null if nothing is left."""
    return F.nullif(F.regexp_replace(F.regexp_replace(text, "\\x1b\\[[0-9;]*[A-Za-z]", ""), "\r", ""), F.lit(""))


def fmt_duration(seconds: Column) -> Column:
    """MM:SS, minutes uncapped; --:-- for negative, infinite and missing times."""
    whole = seconds.cast("long")
    ok = seconds.isNotNull() & ~F.isnan(seconds) & (seconds >= 0) & (seconds < float("inf"))
    return F.when(ok, F.format_string("%02d:%02d", F.floor(whole / 60), whole % 60)).otherwise("--:--")


def eta(elapsed: Column, done: Column, total: Column) -> Column:
    """Seconds left at the mean speed so far; infinite before the first step."""
    return F.when(done > 0, F.try_divide(elapsed, done.cast("double")) * (total - done)).otherwise(float("inf"))


def eta_by_frame(elapsed: Column, index: Column, total: Column) -> Column:
    """Seconds left after frame ``index`` (from 0); 0 after the first."""
    return F.when(index > 0, elapsed / (index + 1) * (total - index - 1)).otherwise(0.0)
