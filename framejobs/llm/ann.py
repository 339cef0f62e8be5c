"""Approximate nearest neighbours with additive quantisation.

A vector is coded as the sum of one codeword from each of several full-dimensional codebooks. The codebooks are fitted on a bounded sample: k-means
of residuals, then least squares over all codebooks at once between beam-search encodings. Every vector is encoded by beam search, once and where the
scan put it, and stored with the squared norm of its decoded form, so that a table of inner products of the query with all codewords scores it by
lookups. The best of a shard are ranked anew by exact distance. Vectors are dealt to tasks once and stay there: a task codes its shards, as many as
``HOLD_BYTES`` has room for, and reads the queries, which Spark has written to the shared folder, in blocks. It returns ``k`` rows for a query, however
many shards it has, and a query's rows are merged by a window. So vectors are shuffled once, whatever the number of queries, and rows found are queries
times tasks.

Vectors that are null, zero, or hold null or non-finite components take no part, neither as queries nor as candidates. Vectors of one length are
searched apart from those of another. Distances are of the vectors as they are, in double precision. Rows with a query's own vec_id are not its
candidates; equal query rows are asked once; a null vec_id takes no part; without valid vectors the result is empty.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framejobs.llm._session import drop_at_end, hash_sample, new_folder

K = 10
BOOKS, CODES, BEAM = 16, 256, 4
#: About as many vectors as the codebooks are fitted on; of a shard; of a block of queries; candidates of a shard that are ranked anew.
SAMPLE, SHARD, BLOCK, RERANK = 10_000, 8192, 1024, 256
#: Bytes of vectors, codes, norms and ids that a task searches at once.
HOLD_BYTES = 150_000_000
FOUND = "query_id long, query_key long, vec_id long, score double"


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = np.argmin((c * c).sum(1) - 2 * (x @ c.T), axis=1)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
        if (n == 0).any():
            c[n == 0] = x[rng.choice(len(x), int((n == 0).sum()))]
    return c


def fit(x: np.ndarray, books: int = BOOKS, codes: int = CODES, beam: int = BEAM, rounds: int = 1, seed: int = 11) -> np.ndarray:
    """Codebooks, (books, codes, dimensions)."""
    rng = np.random.default_rng(seed)
    x = x.astype(np.float32)
    left, out = x.copy(), []
    for _ in range(books):
        c = _kmeans(left, codes, 6, rng)
        left -= c[np.argmin((c * c).sum(1) - 2 * (left @ c.T), axis=1)]
        out.append(c)
    c = np.stack(out)
    for _ in range(rounds):
        b = encode(x, c, beam)
        flat = b.astype(np.int64) + np.arange(books) * codes
        gram = np.zeros((books * codes,) * 2, dtype=np.float32)
        right = np.zeros((books * codes, x.shape[1]), dtype=np.float32)
        for i in range(books):
            np.add.at(right, flat[:, i], x)
            for j in range(books):
                np.add.at(gram, (flat[:, i], flat[:, j]), 1)
        # Codewords that no vector uses keep their place: the ridge pulls to what they were.
        ridge = np.float32(1e-1)
        gram[np.diag_indices(len(gram))] += ridge
        c = np.linalg.solve(gram, right + ridge * c.reshape(len(gram), -1)).reshape(c.shape).astype(np.float32)
    return c


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Codes of each vector, keeping the ``beam`` best partial sums from one codebook to the next."""
    out = np.empty((len(x), len(books)), dtype=np.uint8)
    for s in range(0, len(x), 2048):
        part = x[s : s + 2048].astype(np.float32)
        n, rows = len(part), np.arange(len(part))[:, None]
        left, chosen = part[:, None, :], np.zeros((n, 1, 0), dtype=np.uint8)
        for c in books:
            cost = (left * left).sum(2)[:, :, None] - 2 * (left @ c.T) + (c * c).sum(1)
            flat = cost.reshape(n, -1)
            keep = min(beam, flat.shape[1])
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
            old, code = best // len(c), best % len(c)
            left = left[rows, old] - c[code]
            chosen = np.concatenate((chosen[rows, old], code[:, :, None].astype(np.uint8)), axis=2)
        out[s : s + 2048] = chosen[np.arange(n), (left * left).sum(2).argmin(1)]
    return out


def decoded(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return sum(books[m][codes[:, m]] for m in range(len(books)))


@dataclass
class Shard:
    ids: np.ndarray  # ascending
    vecs: np.ndarray
    codes: np.ndarray
    norms: np.ndarray


def search(shard: Shard, ids: np.ndarray, queries: np.ndarray, books: np.ndarray, k: int, rerank: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(query row, ids, distances), nearest first."""
    out = []
    tables = np.einsum("qd,mcd->qmc", queries.astype(np.float32), books)
    for q in range(len(ids)):
        score = shard.norms.copy()
        for m in range(len(books)):
            score -= 2 * tables[q, m][shard.codes[:, m]]
        score[shard.ids == ids[q]] = np.inf
        n = min(max(rerank, k), len(score))
        edge = np.partition(score, n - 1)[n - 1]
        # All below the edge, and of those on it, which may be copies of one vector, the smallest ids.
        below = np.flatnonzero(score < edge)
        pick = np.concatenate((below, np.flatnonzero(score == edge)[: n - len(below) + k]))
        pick = pick[np.isfinite(score[pick])]
        d = np.sqrt(((shard.vecs[pick].astype(np.float64) - queries[q].astype(np.float64)) ** 2).sum(1))
        best = np.lexsort((shard.ids[pick], d))[:k]
        out.append((q, shard.ids[pick][best], d[best]))
    return out


def _valid(vector: Column) -> Column:
    """The contract's vectors: complete, finite, not zero."""
    inf = float("inf")
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == inf)
    return vector.isNotNull() & ~F.exists(vector, bad) & F.exists(vector, lambda v: v != 0)


def nearest(
    vectors: DataFrame, queries: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = K, rerank: int = RERANK, sample: int = SAMPLE,
    shard: int = SHARD, block: int = BLOCK, books: int = BOOKS, codes: int = CODES, beam: int = BEAM, hold_bytes: int = HOLD_BYTES,
) -> DataFrame:
    """The ``k`` nearest found for each row of ``queries`` among the rows of ``vectors``: query_id, rank, vec_id, score."""
    element = vectors.schema[vector].dataType.elementType.simpleString()
    kind = "float" if element in ("float", "tinyint", "smallint") else "double"  # exact for the column's values
    cut = lambda df: df.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast(f"array<{kind}>").alias("v")).filter(F.col("id").isNotNull() & _valid(F.col("v")))
    base, asked = cut(vectors), cut(queries).distinct()
    found = None
    for r in base.groupBy(F.size("v").alias("size")).count().orderBy("size").collect():  # one row for each length of vectors
        of = lambda df, n=r["size"]: df.filter(F.size("v") == n)
        part = _nearest(of(base), of(asked), r["size"], r["count"], np.dtype(np.float32 if kind == "float" else np.float64), k, rerank, sample, shard, block, books, codes, beam, hold_bytes)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return base.limit(0).select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score"))
    best = Window.partitionBy("query_id", "query_key").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _nearest(base, asked, size, count, kind, k, rerank, sample, shard, block, books, codes, beam, hold_bytes) -> DataFrame:
    """``k`` rows for each query of each task, of vectors of one length."""
    spark = base.sparkSession
    fitted = hash_sample(base, sample, "id", "v").toPandas()  # at most twice ``sample``
    c = fit(np.stack(fitted["v"].to_numpy()), books, min(codes, max(1, len(fitted))), beam) if len(fitted) else np.zeros((1, 1, size), np.float32)
    folder = new_folder(spark, "queries")
    asked.write.parquet(folder)
    drop_at_end(spark, folder)
    shards = max(1, hold_bytes // (shard * (size * kind.itemsize + len(c) + 12)))
    # Enough tasks for the cluster, unless they had less than a shard each; as many as it takes beyond that.
    tasks = max(-(-count // (shard * shards)), min(-(-count // shard), 2 * spark.sparkContext.defaultParallelism))

    def arrays(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return b.column("id").to_numpy(zero_copy_only=False), b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)

    def index(ids: list[np.ndarray], vecs: list[np.ndarray]) -> Shard:
        joined = np.concatenate(ids)
        by = np.argsort(joined, kind="stable")
        x = np.ascontiguousarray(np.concatenate(vecs)[by], dtype=kind)
        coded = encode(x, c, beam)
        return Shard(joined[by], x, coded, (decoded(coded, c) ** 2).sum(1).astype(np.float32))

    def gather(batches):
        ids, vecs, n = [], [], 0
        for b in batches:
            at = 0
            while at < b.num_rows:
                i, v = arrays(b.slice(at, shard - n))
                ids.append(i)
                vecs.append(v)
                n, at = n + len(i), at + len(i)
                if n == shard:
                    yield index(ids, vecs)
                    ids, vecs, n = [], [], 0
        if n:
            yield index(ids, vecs)

    def blocks():
        where, base = fs.FileSystem.from_uri(folder)
        for file in where.get_file_info(fs.FileSelector(base)):
            if file.path.endswith(".parquet"):
                with where.open_input_file(file.path) as f:
                    for b in pq.ParquetFile(f).iter_batches(batch_size=block):
                        yield arrays(b)

    def best(held: list[Shard]):
        for q_ids, q in blocks():
            keys = np.array([xxhash.xxh3_64_intdigest(v.tobytes()) >> 1 for v in q], dtype=np.int64)
            found = [f for part in held for f in search(part, q_ids, q, c, k, rerank)]
            row = np.repeat([f[0] for f in found], [len(f[1]) for f in found])
            ids, score = np.concatenate([f[1] for f in found]), np.concatenate([f[2] for f in found])
            order = np.lexsort((ids, score, row))
            n = np.bincount(row, minlength=len(q_ids))
            pick = order[np.arange(len(order)) - np.repeat(np.cumsum(n) - n, n) < k]
            yield pa.RecordBatch.from_arrays([pa.array(x[pick]) for x in (q_ids[row], keys[row], ids, score)], names=["query_id", "query_key", "vec_id", "score"])

    def run(batches):
        held = []
        for s in gather(batches):
            held.append(s)
            if len(held) == shards:
                yield from best(held)
                held = []
        if held:
            yield from best(held)

    return base.repartition(tasks).mapInArrow(run, FOUND)


def op6_ann(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.filter("vec_id % 100 = 0"))
