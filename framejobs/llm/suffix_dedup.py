"""Exact removal of repeated byte strings with a sparse, distributed suffix order (bucket-pointer refinement).

Suffixes are sampled by content: of each window of ``min_len`` bytes, the one whose q-gram has the smallest digest (the first of equals). Equal
windows sample the same suffix. The windows of one sampled suffix are a run of starts lo..hi, at most ``min_len - q + 1`` of them.

1. Initial buckets: the sampled suffixes, by the q-gram at them. Equal runs are merged: all but the smallest (doc_id, start) go, whole. Runs are told
   apart by 96 bits of two digests of their bytes. Buckets that are left with one run are finished.
2. The other buckets are refined, each in one task, from the bytes of their runs. Every offset gets a pointer to its bucket: first by the next 8
   bytes. A bucket with several members is then sorted by the pointers at a later offset, 8 bytes on, and the pointers of its members are updated
   to the buckets so made; the next refinement, 16 bytes on, uses the updated pointers of that offset, and so on, until a bucket holds the offsets
   whose next ``min_len`` bytes are equal. Of those all but the smallest (doc_id, start) go. These comparisons are of the bytes themselves.
3. A q-gram with more than ``crowd`` runs would be too much for one task. Such buckets are split by all later offsets at once: each window goes, by
   96 bits of its digests, to the task of that digest.

This is exact: equal windows lie in runs of one bucket, and equal runs have equal windows, so the smallest start of a window is in the smallest of
some run. Only runs and comparisons are shuffled (see _batches.py); the text is dealt once.

Defined results: a null text is empty; a null doc_id is smaller than all others; rows with one doc_id are ordered by text and each is returned;
texts shorter than ``min_len`` keep all bytes; an empty table gives an empty result; columns other than those named do not matter.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from framejobs.llm import _arrays as A
from framejobs.llm import _batches as B

#: Text that is sampled at once; longer texts are sampled in overlapping pieces of this size.
CHUNK_BYTES = 200_000
#: Runs of a q-gram that one task refines, and bytes of runs that are refined at once.
CROWD, REFINE_BYTES = 10_000, 400_000
BUCKET_ENTRIES = 500_000
RUNS = "bucket int, batch int, seg binary, seg_low binary, seg_doc binary, gram binary, gram_tag binary, gram_n binary"
ANSWER = "batch int, bucket int, seg binary, gram binary"
REFINE = "bucket int, batch int, kind int, key binary, low binary, doc binary, at binary, size binary, bytes binary"
COVERED = "batch int, start binary, length binary"
SPANS, BYTES, WINDOWS = 0, 1, 2


@dataclass
class Sample:
    """The sampled suffixes of a batch in document order. lo, hi: the first and last start of the run, in the joined bytes of the batch."""

    gram: np.ndarray
    seg: np.ndarray
    low: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    doc: np.ndarray


def _smallest(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours."""
    s = 1
    while s * 2 <= w:
        x = np.minimum(x[:-s], x[s:])
        s *= 2
    return np.minimum(x[: len(x) - (w - s)], x[w - s :]) if w > s else x


def _names(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """96 bits for each byte string [start, end)."""
    return A.digests(A.prefixes(buf), start, end), A.digests(A.prefixes(buf, 1), start, end, 1) >> A.U64(32)


def _sample(texts: list[bytes], n: int, q: int) -> Sample:
    found: list[tuple] = []

    def take(pieces: list[tuple[int, int, bytes]]) -> None:
        buf = np.frombuffer(b"".join(p[2] for p in pieces), dtype=np.uint8)
        sizes = np.array([len(p[2]) for p in pieces])
        ends = np.cumsum(sizes)
        start = np.arange(len(buf) - q + 1)
        grams = A.digests(A.prefixes(buf), start, start + q)
        packed = (grams >> A.U64(24) << A.U64(24)) | start.astype(A.U64)
        least = (_smallest(packed, n - q + 1) & A.U64(0xFFFFFF)).astype(np.int64)
        piece = np.repeat(np.arange(len(pieces)), sizes)[: len(least)]
        p = np.flatnonzero(np.arange(len(least)) + n <= ends[piece])
        least, piece = least[p], piece[p]
        at = np.flatnonzero(np.concatenate(([True], (least[1:] != least[:-1]) | (piece[1:] != piece[:-1]))))
        lo, hi, piece = p[at], p[np.append(at[1:], len(p)) - 1], piece[at]
        shift = np.array([p[1] for p in pieces]) - (ends - sizes)
        doc = np.array([p[0] for p in pieces])
        found.append((grams[least[at]], *_names(buf, lo, hi + n), lo + shift[piece], hi + shift[piece], doc[piece]))

    room: list[tuple[int, int, bytes]] = []
    size = total = 0
    for k, text in enumerate(texts):
        for s in range(0, max(1, len(text)), CHUNK_BYTES):
            part = text[s : s + CHUNK_BYTES + n - 1]
            if len(part) >= n:
                room.append((k, total + s, part))
                size += len(part)
            if size >= CHUNK_BYTES:
                take(room)
                room, size = [], 0
        total += len(text)
    if room:
        take(room)
    if not found:
        none = np.empty(0, dtype=np.int64)
        return Sample(*[none.astype(A.U64)] * 3, *[none] * 3)
    return Sample(*(np.concatenate([f[i] for f in found]) for i in range(6)))


def _load(table: pa.Table) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Ids as ordered unsigned numbers, texts and row numbers, by (doc_id, text)."""
    texts = B.texts(table)
    ids = table.column("doc_id").combine_chunks()
    key = np.array(ids.fill_null(-(2**63)).to_numpy(zero_copy_only=False), dtype=np.int64)
    order = np.lexsort((np.arange(len(key)), key))
    if len(key) > len(np.unique(key)):
        order = np.array(sorted(range(len(key)), key=lambda i: (key[i], texts[i])), dtype=np.int64)
    return (key.view(A.U64) ^ A.U64(1 << 63))[order], [texts[i] for i in order], order


def _named(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorts names of 96 bits: the order, equal ones as they stand, and where in it a new name begins."""
    order = np.argsort(high, kind="stable")
    h, x = high[order], low[order]
    if ((h[1:] == h[:-1]) & (x[1:] != x[:-1])).any():
        order = np.lexsort((low, high))
        h, x = high[order], low[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (x[1:] != x[:-1])
    return order, np.flatnonzero(new)


@dataclass
class Classes:
    """Equal runs of a batch by ascending name: the first sampled suffix of each, and the buckets with what tells their runs apart."""

    first: np.ndarray
    number: np.ndarray  # of each sampled suffix
    grams: np.ndarray  # distinct, ascending
    tags: np.ndarray  # 40 bits of the only run's name; 0 if there are several
    runs: np.ndarray  # their number
    gram: np.ndarray  # of each class


def _classes(s: Sample) -> Classes:
    order, at = _named(s.seg, s.low)
    number = np.empty(len(order), dtype=np.int64)
    number[order] = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(order))))
    first = order[at]
    grams, one, gram, n = np.unique(A.mix(s.gram[first]), return_index=True, return_inverse=True, return_counts=True)  # mixed anew: minima crowd at small values
    tags = np.where(n == 1, s.seg[first][one] >> A.U64(24) | A.U64(1), A.U64(0))
    return Classes(first, number, grams, tags, n, gram)


def _table(rows: list[dict], ddl: str) -> pa.Table:
    fields = [f.split() for f in ddl.split(", ")]
    return pa.table([pa.array([r.get(n) for r in rows], pa.int32() if k == "int" else pa.binary()) for n, k in fields], names=[n for n, _ in fields])


def _merge_runs(crowd: int):
    """In a bucket of step 1: which runs of each batch an earlier document has too, and which q-grams have several runs (1) or a crowd of them (2)."""

    def run(table: pa.Table) -> pa.Table:
        answers = [{"batch": a, "bucket": b} for a, b in zip(table.column("batch").to_pylist(), table.column("bucket").to_pylist(), strict=True)]
        column = lambda name, ascending=False: [A.unpack(x.as_py(), ascending) for x in table.column(name)]

        def answer(name: str, values: np.ndarray, sizes: list[int]) -> None:
            for a, part in zip(answers, np.split(values, np.cumsum(sizes)[:-1]), strict=True):
                a[name] = A.pack(part)

        keys = column("seg", True)
        sizes = [len(k) for k in keys]
        if sum(sizes):
            order, at = _named(np.concatenate(keys), np.concatenate(column("seg_low")))
            docs = np.concatenate(column("seg_doc"))[order]
            least = np.minimum.reduceat(docs, at)
            seen = np.empty(len(order), dtype=np.uint8)
            seen[order] = docs > np.repeat(least, np.diff(np.append(at, len(order))))
            answer("seg", seen, sizes)
        keys = column("gram", True)
        sizes = [len(k) for k in keys]
        if sum(sizes):
            joined = np.concatenate(keys)
            order = np.argsort(joined, kind="stable")
            at = A.runs(joined[order])
            tags, n = np.concatenate(column("gram_tag"))[order], np.concatenate(column("gram_n"))[order].astype(np.int64)
            low, high = np.minimum.reduceat(tags, at), np.maximum.reduceat(tags, at)
            several = ((low != high) | (low == 0)).astype(np.uint8)
            several[(several > 0) & (np.add.reduceat(n, at) > crowd)] = 2
            out = np.empty(len(order), dtype=np.uint8)
            out[order] = np.repeat(several, np.diff(np.append(at, len(order))))
            answer("gram", out, sizes)
        return _table(answers, ANSWER)

    return run


def _answered(rows: list[dict], column: str, keys: np.ndarray, bits: int) -> np.ndarray:
    """The answers of all buckets in the order of the keys."""
    got = {r["bucket"]: r[column] for r in rows}
    buckets, _ = A.bucket_cuts(keys, bits)
    parts = [A.unpack(got[b]) for b in buckets.tolist()]
    return np.concatenate(parts).astype(np.int8) if parts else np.empty(0, dtype=np.int8)


def _spread(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions of the strings [start, start + size), one after the other, and the string of each."""
    of = np.repeat(np.arange(len(start)), size)
    return np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + start[of], of


def _covered(start: np.ndarray, end: np.ndarray) -> dict:
    """Intervals, merged and packed."""
    if not len(start):
        return {}
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.concatenate(([True], start[1:] > reach[:-1])))
    start = start[new]
    return {"start": A.pack(start, ascending=True), "length": A.pack(reach[np.append(new[1:], len(reach)) - 1] - start)}


def refined(buf: np.ndarray, n: int) -> np.ndarray:
    """For each offset of a byte array, a pointer to the bucket of the offsets with the same next n bytes, by bucket-pointer refinement.

    Pointers of the last n - 1 offsets mean nothing.
    """
    size, depth = len(buf), min(8, n)
    padded = np.append(buf, np.zeros(8, dtype=np.uint8))
    first = np.ndarray((size,), dtype=">u8", buffer=padded, strides=(1,)).astype(A.U64) >> A.U64(8 * (8 - depth))
    pointer = np.empty(size, dtype=np.int64)
    order = np.argsort(first, kind="stable")
    at = A.runs(first[order])
    many = np.diff(np.append(at, size))
    pointer[order] = np.repeat(at, many)
    active = order[np.repeat(many > 1, many)]  # members of buckets with several
    while depth < n and len(active):
        later = min(depth, n - depth)
        active = active[active + later < size]
        key = pointer[active] << 32 | pointer[active + later]
        order = np.argsort(key, kind="stable")
        active, key = active[order], key[order]
        at = A.runs(key)
        many = np.diff(np.append(at, len(key)))
        bucket = key >> 32
        old = A.runs(bucket)
        inside = np.repeat(at, many) - np.repeat(old, np.diff(np.append(old, len(key))))
        pointer[active] = bucket + inside
        active = active[np.repeat(many > 1, many)]
        depth += later
    return pointer


def _later(bucket: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of the members of each bucket, all but the one with the smallest (doc, at)."""
    order = np.lexsort((at, doc, bucket))
    out = np.ones(len(bucket), dtype=bool)
    out[order[A.runs(bucket[order])]] = False
    return out


def _refine(n: int):
    """In a bucket of step 2: what windows of each batch occur earlier, as covered intervals."""

    def run(table: pa.Table) -> pa.Table:
        kinds, out = table.column("kind").to_numpy(), []
        batches = table.column("batch").to_numpy()
        for i in np.flatnonzero(kinds == SPANS).tolist():
            out.append({"batch": int(batches[i]), "start": table.column("at")[i].as_py(), "length": table.column("size")[i].as_py()})
        for kind, of in ((BYTES, _refine_bytes), (WINDOWS, _refine_windows)):
            rows = np.flatnonzero(kinds == kind)
            if len(rows):
                part = table.take(pa.array(rows))
                source, start = of(part, n)
                for k in np.unique(source).tolist():
                    mine = start[source == k]
                    out.append({"batch": int(batches[rows[k]])} | _covered(mine, mine + n))
        return _table(out, COVERED)

    return run


def _columns(table: pa.Table, *names: str) -> tuple[list[np.ndarray], np.ndarray]:
    parts = [[A.unpack(x.as_py()) for x in table.column(name)] for name in names]
    return [np.concatenate(p) for p in parts], np.repeat(np.arange(table.num_rows), [len(x) for x in parts[0]])


def _refine_windows(table: pa.Table, n: int) -> tuple[np.ndarray, np.ndarray]:
    (high, low, doc, at), source = _columns(table, "key", "low", "doc", "at")
    at = at.astype(np.int64)
    order, new = _named(high, low)
    bucket = np.empty(len(order), dtype=np.int64)
    bucket[order] = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(order))))
    later = _later(bucket, doc, at)
    return source[later], at[later]


def _refine_bytes(table: pa.Table, n: int) -> tuple[np.ndarray, np.ndarray]:
    (gram, doc, at, size), source = _columns(table, "key", "doc", "at", "size")
    at, size = at.astype(np.int64), size.astype(np.int64)
    buf = np.frombuffer(b"".join(zstandard.ZstdDecompressor().decompress(x.as_py()) for x in table.column("bytes")), dtype=np.uint8)
    where = np.cumsum(size) - size
    order = np.argsort(gram, kind="stable")
    new = A.runs(gram[order])
    sums = np.add.reduceat(size[order], new)
    found, starts = [], []
    k = 0
    while k < len(new):  # some buckets at a time
        e = max(k + 1, int(np.searchsorted(np.cumsum(sums[k:]), REFINE_BYTES, side="right")) + k)
        runs = order[new[k] : new[e] if e < len(new) else len(order)]
        k = e
        joined, _ = _spread(where[runs], size[runs])
        pointer = refined(buf[joined], n)
        p, run = _spread(np.cumsum(size[runs]) - size[runs], size[runs] - n + 1)
        start = p - (np.cumsum(size[runs]) - size[runs])[run] + at[runs][run]
        later = _later(pointer[p], doc[runs][run], start)
        found.append(source[runs][run][later])
        starts.append(start[later])
    return np.concatenate(found), np.concatenate(starts)


def find_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_len: int = 100, carry: tuple[str, ...] = (), with_text: bool = False,
    batch_bytes: int = B.BATCH_BYTES, bucket_entries: int = BUCKET_ENTRIES, crowd: int = CROWD,
) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (start and end of each removed run, in bytes).

    ``carry`` names columns that come along in a struct ``rest``. With ``with_text`` a column ``kept`` has what is left as text; bytes of
    characters that a removed run has cut are left out there.
    """
    q = min(32, max(1, min_len // 3))
    total = B.text_bytes(docs, text)
    full, partitions = B.in_batches(docs, doc_id, text, total, batch_bytes, carry)
    bits = B.bucket_bits(total // max(1, (min_len - q) // 2), bucket_entries)

    def ask(table: pa.Table) -> pa.Table:
        ids, texts, _ = _load(table)
        s = _sample(texts, min_len, q)
        c = _classes(s)
        batch, rows = table.column("batch")[0].as_py(), {}
        columns = {"seg": (s.seg[c.first], {"seg_low": s.low[c.first], "seg_doc": ids[s.doc[c.first]]}), "gram": (c.grams, {"gram_tag": c.tags, "gram_n": c.runs})}
        for name, (keys, more) in columns.items():
            buckets, cuts = A.bucket_cuts(keys, bits)
            for k, b in enumerate(buckets.tolist()):
                row = rows.setdefault(b, {"bucket": b, "batch": batch})
                row[name] = A.pack(keys[cuts[k] : cuts[k + 1]], ascending=True)
                row |= {m: A.pack(v[cuts[k] : cuts[k + 1]]) for m, v in more.items()}
        return _table(list(rows.values()), RUNS)

    def ask_again(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _table([], REFINE)
        ids, texts, _ = _load(left)
        s = _sample(texts, min_len, q)
        c = _classes(s)
        answers = right.to_pylist()
        seen = _answered(answers, "seg", s.seg[c.first], bits)
        several = _answered(answers, "gram", c.grams, bits)[c.gram]
        gone = seen[c.number] > 0
        leads = np.zeros(len(s.seg), dtype=bool)
        leads[c.first] = True
        gone |= ~leads
        batch = left.column("batch")[0].as_py()
        spans = _covered(s.lo[gone], s.hi[gone] + min_len)
        rows = [{"bucket": batch % (1 << bits), "batch": batch, "kind": SPANS, "at": spans["start"], "size": spans["length"]}] if spans else []
        joined = np.frombuffer(b"".join(texts), dtype=np.uint8)
        # Buckets of several runs, with their bytes.
        wanted = np.flatnonzero((several == 1) & (seen == 0))
        wanted = wanted[np.argsort(c.gram[wanted], kind="stable")]
        mine, keys = c.first[wanted], c.grams[c.gram[wanted]]
        buckets, cuts = A.bucket_cuts(keys, bits)
        for k, b in enumerate(buckets.tolist()):
            part = mine[cuts[k] : cuts[k + 1]]
            size = s.hi[part] + min_len - s.lo[part]
            data = zstandard.ZstdCompressor(level=1).compress(joined[_spread(s.lo[part], size)[0]].tobytes())
            rows.append({"bucket": b, "batch": batch, "kind": BYTES, "key": A.pack(keys[cuts[k] : cuts[k + 1]]), "bytes": data}
                        | {"doc": A.pack(ids[s.doc[part]]), "at": A.pack(s.lo[part]), "size": A.pack(size)})
        # Crowded buckets, by windows.
        crowded = np.sort(c.first[(several == 2) & (seen == 0)])
        parts = []
        for part in np.array_split(crowded, -(-len(crowded) // 2_000)) if len(crowded) else ():
            size = s.hi[part] + min_len - s.lo[part]
            own = np.cumsum(size) - size
            p, run = _spread(own, size - min_len + 1)
            high, low = _names(joined[_spread(s.lo[part], size)[0]], p, p + min_len)
            parts.append((high, low, ids[s.doc[part]][run], p - own[run] + s.lo[part][run]))
        if parts:
            high, low, doc, at = (np.concatenate([x[i] for x in parts]) for i in range(4))
            order, new = _named(high, low)  # starts ascend, so that the first of equals is the smallest
            again = np.ones(len(order), dtype=bool)
            again[order[new]] = False
            spans = _covered(at[again], at[again] + min_len)
            if spans:
                rows.append({"bucket": batch % (1 << bits), "batch": batch, "kind": SPANS, "at": spans["start"], "size": spans["length"]})
            first = order[new]
            buckets, cuts = A.bucket_cuts(high[first], bits)
            for k, b in enumerate(buckets.tolist()):
                part = first[cuts[k] : cuts[k + 1]]
                rows.append({"bucket": b, "batch": batch, "kind": WINDOWS, "key": A.pack(high[part]), "low": A.pack(low[part]), "doc": A.pack(doc[part]), "at": A.pack(at[part])})
        return _table(rows, REFINE)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return out_schema_arrow.empty_table()
        _, texts, order = _load(left)
        turn = np.zeros(sum(map(len, texts)) + 1, dtype=np.int32)
        for r in right.to_pylist():
            start = A.unpack(r["start"], ascending=True).astype(np.int64)
            np.add.at(turn, start, 1)
            np.add.at(turn, start + A.unpack(r["length"]).astype(np.int64), -1)
        covered = np.cumsum(turn[:-1], dtype=np.int32) > 0
        del turn
        out, at = [], 0
        for t in texts:
            mask = covered[at : at + len(t)]
            at += len(t)
            if mask.any():
                edge = np.diff(mask.astype(np.int8), prepend=0, append=0)
                spans = [{"start": a, "end": b} for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True)]
                kept = np.frombuffer(t, dtype=np.uint8)[~mask].tobytes()
            else:
                spans, kept = [], t
            row = {"n_bytes": len(t), "n_removed": len(t) - len(kept), "n_spans": len(spans), "kept_sha256": hashlib.sha256(kept).hexdigest(), "spans": spans}
            out.append(row | ({"kept": kept.decode(errors="ignore")} if with_text else {}))
        picked = left.take(pa.array(order))
        columns = [picked.column("doc_id"), *([picked.column("rest")] if carry else [])]
        columns += [pa.array([r[f.name] for r in out], f.type) for f in out_schema_arrow if f.name not in ("doc_id", "rest")]
        return pa.table(columns, names=[f.name for f in out_schema_arrow])

    fields = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, end: long>>" + ", kept string" * with_text
    out_schema = T.StructType([T.StructField("doc_id", T.LongType())])
    if carry:
        out_schema.add("rest", full.schema["rest"].dataType)
    out_schema = T.StructType(out_schema.fields + T.StructType.fromDDL(fields).fields)
    out_schema_arrow = to_arrow_schema(out_schema)
    deal = lambda df, key, k: df.repartition(k, key).groupBy(key)
    n_buckets = min(1 << bits, partitions)
    answers = deal(full.groupBy("batch").applyInArrow(ask, RUNS), "bucket", n_buckets).applyInArrow(_merge_runs(crowd), ANSWER)
    more = full.groupBy("batch").cogroup(deal(answers, "batch", partitions)).applyInArrow(ask_again, REFINE)
    covered = deal(more, "bucket", n_buckets).applyInArrow(_refine(min_len), COVERED)
    return full.groupBy("batch").cogroup(deal(covered, "batch", partitions)).applyInArrow(finish, out_schema)


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return find_repeats(docs).drop("spans")


OP1_SQL = """
with d as (select doc_id, row_number() over () as r, hex(encode(coalesce(text, ''))) as x from documents),
w as (select doc_id, r, p, md5(substr(x, p * 2 + 1, 200)) as h from (select doc_id, r, x, unnest(range(0, length(x) // 2 - 99)) as p from d)),
g as (select r, p from (select r, p, row_number() over (partition by h order by doc_id, r, p) as n from w) where n > 1),
m as (select r, p, sum(fresh) over (partition by r order by p) as run from (select r, p, case when p - lag(p, 1, -1000) over (partition by r order by p) > 100 then 1 else 0 end as fresh from g)),
s as (select r, run, min(p) as a, max(p) + 100 as b from m group by 1, 2),
k as (select r, a, b, lag(b, 1, 0) over (partition by r order by a) as before from s),
c as (select r, count(*) as n_spans, sum(b - a) as n_removed, max(b) as last, string_agg(substr(x, before * 2 + 1, (a - before) * 2), '' order by a) as parts from k join d using (r) group by r)
select doc_id, length(x) // 2 as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0) as n_spans,
  sha256(unhex(coalesce(parts || substr(x, last * 2 + 1), x))) as kept_sha256
from d left join c using (r)
"""
