"""Where jobs put files and checkpoints of their own: the folder that the cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Spark's checkpoint folder, which it takes from spark.checkpoint.dir; only where that is unset and all is on one machine, a temporary one."""
    if not spark.sparkContext.getCheckpointDir():
        named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("name a folder that the whole cluster shares in spark.checkpoint.dir")
        spark.sparkContext.setCheckpointDir(named or f"file://{tempfile.mkdtemp()}")
    return re.sub("^file:/+", "file:///", spark.sparkContext.getCheckpointDir().rstrip("/"))


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, not yet made."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
