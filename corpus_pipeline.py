"""A training corpus in five stages, each one of the operators in framejobs/llm: documents that the toxicity model rejects go; of near duplicates one
stays; byte strings that occur earlier go; documents with benchmark passages go; what is left is packed into sequences.

Every stage but the last returns the columns of ``documents``; other columns of the input are left behind. Null texts are treated as empty and stay:
an empty text is neither toxic nor contaminated, and is a duplicate of other empty ones only. A row without doc_id cannot be named as a duplicate
and stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framejobs.llm._joins import join_frequent
from framejobs.llm._session import drop_folder, new_folder, with_checkpoints
from framejobs.llm.decontamination import find_contaminated
from framejobs.llm.packing import pack_documents
from framejobs.llm.simhash import near_duplicates
from framejobs.llm.suffix_dedup import find_repeats
from framejobs.llm.toxicity import score_toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
CARRY = ("lang", "source", "n_chars")


def _columns(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "text", *(F.col(f"rest.{c}").alias(c) for c in CARRY))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _columns(score_toxicity(docs, labels, carry=CARRY, with_text=True).filter("predicted = 0"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group one row: that with the smallest doc_id, of unlike texts with that id the one with the smallest hash, of equal ones any one, with
    the smallest other columns. Rows are told apart by id and text, so two texts with one id are decided each by its own group."""
    key = ["doc_id", "text_key"]
    keyed = docs.select(*COLUMNS, F.xxhash64("text").alias("text_key"))
    rows = near_duplicates(keyed, carry=("text_key",)).filter("doc_id is not null").groupBy("doc_id", "rest.text_key", "root").agg(F.count("*").alias("n"))
    kept = rows.groupBy("root").agg(F.min(F.struct(*key, "n")).alias("row")).select("row.*").checkpoint()
    named = keyed.filter("doc_id is not null")
    total = kept.agg(F.sum("n")).first()[0] or 0
    out = join_frequent(named, kept.filter("n = 1"), key, "n", total).select(*COLUMNS)
    repeated = kept.filter("n > 1")
    if not repeated.isEmpty():
        once = join_frequent(named, repeated, key, "n", total).groupBy(*key).agg(F.min("text").alias("text"), F.min(F.struct(*CARRY)).alias("rest"))
        out = out.unionByName(_columns(once))
    return out.unionByName(docs.filter("doc_id is null").select(*COLUMNS))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the byte strings that occur earlier. A document may be left empty."""
    out = _columns(find_repeats(docs, carry=CARRY, with_text=True).withColumnRenamed("kept", "text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _columns(find_contaminated(docs, benchmark, carry=CARRY, with_text=True, with_matches=False).filter("not contaminated"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in which sequence."""
    return pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("suffix_dedup", drop_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]
#: SQL cannot express the stages; tests compare them with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again as the next one's input. What a stage has read is
    deleted when it has written its own."""
    docs, before = with_checkpoints(spark).read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = new_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            drop_folder(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
