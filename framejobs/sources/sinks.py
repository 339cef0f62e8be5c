"""Where results go."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATS = "filename string, total_frames long, face_frames long, face_ratio string"


def write_face_stats(stats: DataFrame, root: str) -> None:
    """Appends (dir, filename, total_frames, face_frames, face_ratio) to CSV files with headers, one folder for each source folder. A second
    run appends again. Ratios have four decimals."""
    text = F.format_string("%.4f", F.bround("face_ratio", 4))
    stats.select("dir", "filename", "total_frames", "face_frames", text.alias("face_ratio")).write.mode("append").option("header", True).partitionBy("dir").csv(root)


def read_face_stats(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(f"{STATS}, dir string").option("header", True).csv(root)


def write_redacted(frames: DataFrame, root: str, keep_metadata: bool = True) -> None:
    """Redacted frames as Parquet, one folder for each video; a column ``metadata`` goes along or is dropped."""
    out = frames if keep_metadata or "metadata" not in frames.columns else frames.drop("metadata")
    out.write.mode("append").partitionBy("video_id").parquet(root)
