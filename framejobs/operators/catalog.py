"""Joins and aggregates over catalogs and encode batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framejobs.functions.media import extension, folder
from framejobs.operators.scan import ranked
from framejobs.sources.lookups import GPU_ORDER, VIDEO_EXTENSIONS, encoders


def media_by_extension(files: DataFrame, extensions: list[str] = VIDEO_EXTENSIONS) -> DataFrame:
    """Files of a catalog whose extension, as written, is one of the list."""
    return files.filter((F.col("is_file") == 1) & extension(F.col("path")).isin(extensions))


def union_inputs(*parts: DataFrame) -> DataFrame:
    """All inputs one after the other; what is given twice stays twice."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def new_folders(files: DataFrame, listed: DataFrame) -> DataFrame:
    """Folders of the catalog that are not listed yet, by name."""
    found = files.select(folder(F.col("path")).alias("folder")).filter("folder <> ''").distinct()
    return found.join(listed.select("folder"), "folder", "left_anti").orderBy("folder")


def pick_gpu(workers: DataFrame, probes: DataFrame) -> DataFrame:
    """(worker_id, gpu): the preferred vendor whose encoder probe succeeded, else cpu."""
    order = F.array_position(F.array(*map(F.lit, GPU_ORDER)), F.col("gpu"))
    best = probes.filter((F.col("ok") == 1) & F.col("gpu").isin(GPU_ORDER)).groupBy("worker_id").agg(F.min_by("gpu", order).alias("gpu"))
    return workers.select("worker_id").distinct().join(best, "worker_id", "left").select("worker_id", F.coalesce("gpu", F.lit("cpu")).alias("gpu"))


def resolve_gpu(jobs: DataFrame, picked: DataFrame) -> DataFrame:
    """Jobs whose gpu is auto get that of their worker; other settings win."""
    auto = picked.select("worker_id", F.col("gpu").alias("picked"))
    return jobs.join(auto, "worker_id", "left").withColumn("gpu", F.when(F.col("gpu") == "auto", F.coalesce("picked", F.lit("cpu"))).otherwise(F.col("gpu"))).drop("picked")


def resolve_encoder(jobs: DataFrame) -> DataFrame:
    """Adds encoder: that of (codec, gpu), else the codec's for the cpu."""
    table = encoders(jobs.sparkSession)
    cpu = F.broadcast(table.filter("gpu = 'cpu'").select("codec", F.col("encoder").alias("cpu_encoder")))
    return jobs.join(table, ["codec", "gpu"], "left").join(cpu, "codec", "left").withColumn("encoder", F.coalesce("encoder", "cpu_encoder")).drop("cpu_encoder")


def with_collisions(df: DataFrame, path: str = "output_path") -> DataFrame:
    """Adds collides: whether another file goes to the same output. A null path collides with none."""
    several = df.groupBy(path).agg(F.count("*").alias("_n")).filter(F.col(path).isNotNull() & (F.col("_n") > 1))
    return df.join(several, path, "left").withColumn("collides", F.col("_n").isNotNull()).drop("_n")


def batch_summary(results: DataFrame, batch: str, started: Column | None = None, ended: Column | None = None) -> DataFrame:
    """One row per batch: files, errors (return code not 0), output bytes of the successes, elapsed seconds if times are given."""
    aggregates = [F.count("*").alias("n_files"), F.count_if(F.col("rc") != 0).alias("n_errors"), F.coalesce(F.sum(F.when(F.col("rc") == 0, F.col("size_bytes"))), F.lit(0)).alias("output_bytes")]
    if started is not None and ended is not None:
        aggregates.append((F.max(ended) - F.min(started)).alias("elapsed"))
    return results.groupBy(batch).agg(*aggregates)


def batch_progress(df: DataFrame, batch: str, order: str, seconds: Column) -> DataFrame:
    """Adds done_before, done_after, total and elapsed (since the batch's first time) for each file of a batch. A large batch is counted by many tasks."""
    out = ranked(df, [batch], [order], "done_after", total="total", least={"_began": seconds})
    return out.withColumns({"done_before": F.col("done_after") - 1, "elapsed": seconds - F.col("_began")}).select(*df.columns, "done_after", "total", "elapsed", "done_before")
