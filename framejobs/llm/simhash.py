"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at distance 4 or less have a fingerprint in the middle that differs from each in 2 bits or fewer. If each emits its ball of half
the radius and the balls are shuffled on what they hold, linked ones meet. A ball of radius 2 in 64 bits has 2,081 members, too many to shuffle for
every document, so the method is used twice:

* Of two linked fingerprints, the upper or the lower 32 bits differ in 2 bits or fewer. Each distinct fingerprint emits, for each half, the ball
  of radius 1 there: 66 keys. Fingerprints that share a key meet; whole distances are then verified.
* A key that more than ``dense`` fingerprints share is not verified pair by pair. All its fingerprints emit their whole ball of radius 2. Those
  that share a member of it are linked through the smallest of them: that star has a row for each fingerprint, where pairs would be a square. Two
  in a star can be twice the half radius apart, no more, so they need no verifying.

Both ways lose no link: of a linked pair, the key on which it meets is either sparse, and the pair is verified there, or dense, and both emit balls.
Exact copies share a fingerprint and are merged before anything is emitted. A sparse key returns a forest of its links rather than all of them.

Defined results: a null text and one without words have fingerprint zero and are linked like any other; with fewer words than a shingle has the whole
sequence is one; rows with one doc_id get a row each; null ids never name a component unless it has no other; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framejobs.llm import _arrays as A
from framejobs.llm._batches import slices
from framejobs.llm._joins import join_frequent
from framejobs.llm._session import with_checkpoints
from framejobs.llm.components import components

RADIUS = 4
SHINGLE = 4
SEED = 42
DENSE = 256
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64 bits, each set if it is set in over half of the shingles' hashes."""
    words = _WORD.findall(text.translate(A.LOWER))
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - shingle + 1)
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    hashes = map(xxhash.xxh64_intdigest, [joined[a:b] for a, b in zip(starts, ends[len(words) - n :].tolist(), strict=True)], repeat(SEED))
    bits = np.zeros(64, dtype=np.int64)
    full = np.fromiter(hashes, dtype=np.uint64, count=n)
    for s in range(0, n, 65_536):
        part = full[s : s + 65_536]
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * bits > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp), fp as a signed long, and the ``carry`` columns in a struct ``rest``."""
    cut = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), *([F.struct(*carry).alias("rest")] if carry else []))
    kept = [c for c in cut.columns if c != "text"]

    def run(batches):
        for b in slices(batches, "text", 2_000_000):
            fp = [fingerprint(t or b"", shingle) for t in b.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(fp, pa.int64())], names=[*kept, "fp"])

    return cut.mapInArrow(run, cut.select(kept).schema.add("fp", "long"))


def ball(bits: int, radius: int) -> list[int]:
    """Masks of up to ``radius`` bits, as signed longs."""
    masks = [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(bits), r)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _half_keys(fp: Column, radius: int) -> Column:
    """The balls of both halves; the half is the key's bit 32."""
    masks = F.array(*(F.lit(m).cast("long") for m in ball(32, radius // 2 // 2)))
    low, high = fp.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(fp, 32)
    return F.concat(F.transform(masks, lambda m: low.bitwiseXOR(m)), F.transform(masks, lambda m: high.bitwiseXOR(m) + (1 << 32)))


def _forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among a few hundred fingerprints, each tree from its smallest member."""
    left, out = np.sort(fps), []
    while len(left):
        front, left = left[:1], left[1:]
        root = front
        while len(front) and len(left):
            near = (np.bitwise_count((front[:, None] ^ left[None, :]).view(np.uint64)) <= radius).any(axis=0)  # of signed numbers it counts the absolute value
            front, left = left[near], left[~near]
            out += [(int(root[0]), int(f)) for f in front]
    return out


def links(fps: DataFrame, radius: int = RADIUS, dense: int = DENSE) -> DataFrame:
    """(a, b): links that join all distinct fingerprints (column fp) within ``radius`` of each other, in the same components as all links would."""
    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # the few rows become many, which small partitions merged would not carry
    keys = fps.repartition(tasks, "fp").select("fp", F.explode(_half_keys(F.col("fp"), radius)).alias("key"))
    shared = keys.groupBy("key").count().filter("count > 1")
    met = join_frequent(keys, shared, "key", "count", fps.count() * 2 * len(ball(32, radius // 2 // 2))).checkpoint()

    def verify(batches):
        for b in batches:
            out = {e for f in b.column("fps").to_pylist() for e in _forest(np.array(f, dtype=np.int64), radius)}
            yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    groups = met.filter(F.col("count") <= dense).groupBy("key").agg(F.array_sort(F.collect_list("fp")).alias("fps"))
    found = groups.select("fps").distinct().mapInArrow(verify, "a long, b long").distinct()
    crowd = met.filter(F.col("count") > dense).select("fp").distinct()
    if crowd.isEmpty():
        return found
    masks = F.array(*(F.lit(m).cast("long") for m in ball(64, radius // 2)))
    variants = crowd.select("fp", F.explode(masks).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    least = variants.groupBy("variant").agg(F.min("fp").alias("least"), F.count("*").alias("n")).filter("n > 1")
    stars = join_frequent(variants, least, "variant", "n", crowd.count() * len(ball(64, radius // 2))).filter("fp <> least").select(F.col("least").alias("a"), F.col("fp").alias("b")).distinct()
    return found.unionByName(stars)


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, shingle: int = SHINGLE, dense: int = DENSE, carry: tuple[str, ...] = ()
) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id that can be reached) and root, the smallest
    fingerprint of the component as a signed long, which tells components apart where their ids do not. ``carry``: columns that come along in a
    struct ``rest``."""
    if radius % 4:
        raise ValueError("the radius must be a multiple of 4: half of it is halved again between the two halves of a fingerprint")
    with_checkpoints(docs.sparkSession)
    each = fingerprints(docs, doc_id, text, shingle, carry).checkpoint()
    classes = each.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).checkpoint()
    roots = components(links(classes.select("fp"), radius, dense))
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")).checkpoint()
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    named = join_frequent(rooted.drop("least"), least, "root", "members", classes.count()).select("fp", "n", "root", "component_id")
    out = join_frequent(each, named, "fp", "n", each.count())
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "root", *(["rest"] if carry else []))


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("root")
