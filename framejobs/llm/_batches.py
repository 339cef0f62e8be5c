"""How the corpus-wide text operators use Spark.

Documents are dealt by a hash of their id, or of id and text, into batches of a few megabytes. A batch sends its distinct keys to buckets (the keys' top bits),
a bucket compares what all batches have sent it, and its answers go back to the batches. Each of these steps is a grouped Arrow function, so
Spark deals, sorts, spills and retries the work. Keys that repeat within a batch are merged before they are sent, so that a key with a third of
all rows arrives as one entry a batch.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text in a batch, and entries in a bucket, on average.
BATCH_BYTES = 3_000_000
BUCKET_ENTRIES = 750_000


def text_bytes(docs: DataFrame, text: str) -> int:
    """Bytes of all texts: one number on the driver."""
    return docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0


def in_batches(
    docs: DataFrame, doc_id: str, text: str, total: int, batch_bytes: int = BATCH_BYTES, carry: tuple[str, ...] = (), by_text: bool = False
) -> tuple[DataFrame, int]:
    """(doc_id, text, batch) dealt by batch, and the number of partitions: one for each batch, or, of more than 10,000 batches, for up to 32 of them.
    Texts are compressed for the way, each by itself (see texts()). Null texts become empty; ``carry`` columns come along in a struct ``rest``.
    Rows of one id come together; with ``by_text`` only those with one text do, so that an id, or none, that very many rows have is no batch of its own."""
    n = max(1, -(-total // batch_bytes))
    cut = docs.select(F.col(doc_id).cast("long").alias("doc_id"), *([F.struct(*carry).alias("rest")] if carry else []), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def shrink(batches):
        pack = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            short = pa.array([pack(t) for t in b.column("text").cast(pa.binary()).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], short], names=b.schema.names)

    schema = T.StructType(cut.schema.fields[:-1]).add("text", T.BinaryType())
    partitions = min(n, max(10_000, n // 32))
    dealt = cut.mapInArrow(shrink, schema).withColumn("batch", F.pmod(F.xxhash64("doc_id", *(["text"] if by_text else [])), F.lit(n)).cast("int"))
    return dealt.repartition(partitions, "batch"), partitions


def texts(table: pa.Table) -> list[bytes]:
    """The texts of a batch."""
    unpack = zstandard.ZstdDecompressor().decompress
    return [unpack(t.as_py()) for t in table.column("text")]


def bucket_bits(entries: int, per_bucket: int = BUCKET_ENTRIES) -> int:
    """The number of key bits that name a bucket."""
    return max(0, (max(1, -(-entries // per_bucket)) - 1).bit_length())


def slices(batches, column: str, size: int):
    """Arrow batches, cut so that a slice has about ``size`` bytes in a column or is a single row."""
    for batch in batches:
        at = total = 0
        for k, n in enumerate(pc.binary_length(batch.column(column)).fill_null(0).to_pylist()):
            if k > at and total + n > size:
                yield batch.slice(at, k - at)
                at, total = k, 0
            total += n
        if batch.num_rows > at:
            yield batch.slice(at)
