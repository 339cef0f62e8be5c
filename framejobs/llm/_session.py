"""Where intermediate tables go: the folder that the cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """Spark's checkpoint folder, which it takes from spark.checkpoint.dir; only where that is unset and all is on one machine, a temporary one."""
    if not spark.sparkContext.getCheckpointDir():
        named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("name a folder that the whole cluster shares in spark.checkpoint.dir")
        spark.sparkContext.setCheckpointDir(named or f"file://{tempfile.mkdtemp()}")
    return re.sub("^file:/+", "file:///", spark.sparkContext.getCheckpointDir().rstrip("/"))


def with_checkpoints(spark: SparkSession) -> SparkSession:
    """The session, with a checkpoint folder."""
    shared_folder(spark)
    return spark


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a new subfolder, not yet made."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder of intermediate results, wherever Spark can write."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def drop_at_end(spark: SparkSession, path: str) -> None:
    """Deletes a folder when the session's process ends: for what DataFrames read that the caller has yet to use."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)


def hash_sample(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """About ``rows`` rows, twice as many at most, chosen by a hash of columns that tell rows apart. Tasks filter: no task and no driver sorts them."""
    steps = 1 << 40
    n = df.count()
    return df.filter(F.pmod(F.xxhash64(*by), F.lit(steps)) < min(steps, -(-steps * rows // max(n, 1)))).limit(2 * rows)
