"""Benchmark decontamination with suffix arrays of the training text.

Each shard of a few megabytes of documents gets a suffix array of its words, sorted as deep as a window is long. Every window that starts a suffix
of a benchmark item is looked up there by binary search; the range found has all its verbatim occurrences. Occurrences on one diagonal join to longest
matches. Documents stay where the scan put them: nothing is shuffled. The benchmark is cut into blocks of about ``block_bytes`` of text (repeated rows
are dropped and very long items cut, with an overlap, before they are dealt). Tasks write each block's windows to the shared folder; a shard builds its
suffix array once and searches block after block. A worker keeps the blocks it has read as long as they fit in ``HELD_BYTES``. The files go when the
session ends, as the result reads them only when it is used.

Windows that come from the same items are of one group. A document gathers groups, not items, and documents with the same groups list their items
once, so a passage that many items share costs one entry for each document. Longest matches are listed with every item, that is occurrences times
places, so they are made only when asked for.

Words are compared by 64-bit digests; the order within a suffix array uses 21 bits of each, and matches are then verified with all bits.

Defined results: null and empty texts have no words and no hits; items without words have no windows; an item shorter than the window is one window;
a null item_id counts its hits but is not listed; items with one id are listed once; documents with one id are judged each; an empty benchmark leaves
all documents clean.
"""

from __future__ import annotations

import hashlib
import io
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from framejobs.llm import _arrays as A
from framejobs.llm._batches import slices
from framejobs.llm._session import drop_at_end, new_folder

WINDOW = 13
#: A document is contaminated if at least one in this many of its words is hit.
SHARE = 20
BLOCK_BYTES = 8_000_000
SHARD_BYTES = 4_000_000
CHUNK_BYTES = 1_000_000
#: Bytes of blocks that a worker keeps.
HELD_BYTES = 200_000_000
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: An item of the benchmark is cut into pieces of about this size.
PIECE_BYTES = 500_000
MATCH = "array<struct<item_id: long, start: long, item_start: long, n_words: long>>"


def word_ids(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Digests of the words of all texts, a 0 after each text, and the number of words of each."""
    ids, counts = [], []
    part: list[bytes] = []
    size = 0

    def take() -> None:
        buf = np.frombuffer(b" ".join(part) + b" ", dtype=np.uint8)
        start, end = A.word_spans(buf, IS_WORD)
        doc = np.searchsorted(np.cumsum([len(t) + 1 for t in part]), start, side="right")
        out = np.zeros(len(start) + len(part), dtype=A.U64)
        out[np.arange(len(start)) + doc] = A.digests(A.prefixes(buf), start, end) | A.U64(1)
        ids.append(out)
        counts.append(np.bincount(doc, minlength=len(part)))

    for t in texts:
        part.append(t.translate(A.LOWER))
        size += len(t)
        if size > CHUNK_BYTES:
            take()
            part, size = [], 0
    if part:
        take()
    return (np.concatenate(ids), np.concatenate(counts)) if ids else (np.empty(0, A.U64), np.empty(0, np.int64))


def _keys(ids: np.ndarray) -> np.ndarray:
    """21 bits of each of three consecutive words."""
    short = np.concatenate((ids, np.zeros(2, dtype=A.U64))) >> A.U64(43)
    return (short[:-2] << A.U64(42)) | (short[1:-1] << A.U64(21)) | short[2:]


def suffix_array(keys: np.ndarray, depth: int) -> np.ndarray:
    """Offsets in the order of their first ``depth`` words; ties are refined by the keys three words on."""
    order = np.argsort(keys, kind="stable")
    at = A.runs(keys[order])
    size = np.diff(np.append(at, len(order)))
    tied = np.flatnonzero(np.repeat(size > 1, size))
    if len(tied):
        padded = np.concatenate((keys, np.zeros(depth + 3, dtype=A.U64)))
        run = np.repeat(np.arange(len(at)), size)[tied]
        rows = order[tied]
        order[tied] = rows[np.lexsort([padded[rows + s] for s in range(3 * ((depth - 1) // 3), 0, -3)] + [run])]
    return order


@dataclass
class Windows:
    """Distinct windows of one length in a block of items: where each begins in the block's words, its group, and the places it comes from."""

    length: int
    at: np.ndarray
    group: np.ndarray
    groups: np.ndarray  # of each group, the first of its entries in members; and the number of all
    members: np.ndarray  # item ids
    first: np.ndarray  # of each window, the first of its places; and the number of all
    item: np.ndarray  # of each place, the number of the item
    offset: np.ndarray


@dataclass
class Block:
    """The words of a block of items, its windows by length, and the ids that the numbers of items stand for (null: not known)."""

    ids: np.ndarray
    windows: list[Windows]
    item_ids: np.ndarray
    known: np.ndarray

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        each = {f"{k}_{name}": getattr(w, name) for k, w in enumerate(self.windows) for name in Windows.__dataclass_fields__}
        np.savez(out, ids=self.ids, item_ids=self.item_ids, known=self.known, count=len(self.windows), **each)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Block:
        with np.load(io.BytesIO(data), allow_pickle=False) as z:
            windows = [Windows(int(z[f"{k}_length"]), *(z[f"{k}_{n}"] for n in list(Windows.__dataclass_fields__)[1:])) for k in range(int(z["count"]))]
            return cls(z["ids"], windows, z["item_ids"], z["known"])


def _grouped(window: np.ndarray, item: np.ndarray, n_windows: int, item_ids: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The group of each window, where each group's entries begin, and their item ids. A group is a set of item ids, ascending; it may be empty."""
    keep = known[item]
    pairs = np.unique(np.stack((window[keep], item_ids[item[keep]]), axis=1), axis=0)
    size = np.bincount(pairs[:, 0], minlength=n_windows)
    at = np.cumsum(size) - size
    group, seen, sets = np.empty(n_windows, dtype=np.int32), {}, []
    for w, (a, n) in enumerate(zip(at.tolist(), size.tolist(), strict=True)):
        ids = pairs[a : a + n, 1]
        key = ids.tobytes()
        if key not in seen:
            seen[key] = len(sets)
            sets.append(ids)
        group[w] = seen[key]
    return group, np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int64), np.concatenate(sets or [np.empty(0, np.int64)])


def item_pieces(text: bytes, window: int, size: int = PIECE_BYTES) -> list[tuple[int, bytes]]:
    """(words before it, text): pieces of a long text with ``window`` - 1 words in common, so that every window lies in one of them."""
    if len(text) <= size:
        return [(0, text)]
    start, end = A.word_spans(np.frombuffer(text.translate(A.LOWER), dtype=np.uint8), IS_WORD)
    out, k = [], 0
    while True:
        e = max(int(np.searchsorted(end, (start[k] if len(start) else 0) + size, side="right")), k + window)
        if e >= len(start):
            return [*out, (k, text[start[k] :] if len(start) else b"")]
        out.append((k, text[start[k] : end[e - 1]]))
        k = e - (window - 1)


def block_windows(items: list[tuple[int | None, int, bytes]], window: int) -> Block:
    """The windows of a block of (item_id, words before it, text), by length."""
    ids, counts = word_ids([t for _, _, t in items])
    before = np.array([b for _, b, _ in items], dtype=np.int64)
    first = np.concatenate(([0], np.cumsum(counts + 1)))
    known = np.array([i is not None for i, _, _ in items], dtype=bool)
    item_ids = np.array([i or 0 for i, _, _ in items], dtype=np.int64)
    out = []
    sizes = np.minimum(counts, window)
    for m in sorted(set(sizes.tolist()) - {0}):
        item, offset = [], []
        for k in np.flatnonzero(sizes == m).tolist():
            n = int(counts[k]) - m + 1
            item.append(np.full(n, k, dtype=np.int32))
            offset.append(np.arange(n))
        item, offset = np.concatenate(item), np.concatenate(offset)
        at = first[item] + offset
        words = ids[at[:, None] + np.arange(m)]
        _, lead, number = np.unique(words.view(np.dtype((np.void, 8 * m))).ravel(), return_index=True, return_inverse=True)
        order = np.argsort(number, kind="stable")
        grouped = _grouped(number, item, len(lead), item_ids, known)
        out.append(Windows(m, at[lead], *grouped, np.append(A.runs(number[order]), len(order)), item[order], (before[item] + offset)[order]))
    return Block(ids, out, item_ids, known)


def _search(w: Windows, wanted: np.ndarray, wanted_keys: np.ndarray, ids: np.ndarray, keys: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Binary search of all windows of a block with the words ``wanted``; the windows and offsets of their occurrences."""
    m = w.length
    steps = [(s, A.U64(((1 << 63) - 1) >> (21 * (3 - min(3, m - s))) << (21 * (3 - min(3, m - s))))) for s in range(0, m, 3)]
    bounds = []
    for upper in (False, True):
        lo, hi = np.zeros(len(w.at), dtype=np.int64), np.full(len(w.at), len(order))
        while (lo < hi).any():
            mid = np.minimum((lo + hi) // 2, len(order) - 1)
            below, same = np.zeros(len(lo), dtype=bool), np.ones(len(lo), dtype=bool)
            for s, mask in steps:
                a, b = keys[np.minimum(order[mid] + s, len(keys) - 1)] & mask, wanted_keys[w.at + s] & mask
                below |= same & (a < b)
                same &= a == b
            right = (below | same if upper else below) & (lo < hi)
            hi = np.where(right | (lo >= hi), hi, mid)
            lo = np.where(right, mid + 1, lo)
        bounds.append(lo)
    size = bounds[1] - bounds[0]
    which = np.repeat(np.arange(len(size)), size)
    at = order[np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + bounds[0][which]]
    fit = at + m <= len(ids)
    which, at = which[fit], at[fit]
    ok = np.ones(len(at), dtype=bool)
    for j in range(m):
        ok &= ids[at + j] == wanted[w.at[which] + j]
    return which[ok], at[ok]


@dataclass
class Found:
    """What blocks have so far in a text: its number of words, the runs of hit words, the groups of items by number, and the matches by (item, diagonal)."""

    n_words: int
    spans: list[tuple[int, int]]
    groups: list[int]
    matches: dict[tuple[int | None, int], list[tuple[int, int]]]


def _shard(texts: list[bytes], blocks, window: int, with_matches: bool = True) -> tuple[list[Found], list[np.ndarray]]:
    """What is found in each text, and the item ids of the groups named there. ``blocks`` come one after the other."""
    ids, counts = word_ids(texts)
    keys = _keys(ids)
    order = suffix_array(keys, window)
    first = np.concatenate(([0], np.cumsum(counts + 1)))
    turn = np.zeros(len(ids) + 1, dtype=np.int64)
    found, sets = [Found(int(n), [], [], {}) for n in counts], []
    for block in blocks if len(order) else ():
        wanted_keys = _keys(block.ids)
        for w in block.windows:
            m = w.length
            which, at = _search(w, block.ids, wanted_keys, ids, keys, order)
            if not len(at):
                continue
            turn += np.bincount(at, minlength=len(turn)) - np.bincount(at + m, minlength=len(turn))
            doc = np.searchsorted(first, at, side="right") - 1
            pairs = np.unique(doc * len(w.groups) + w.group[which])
            group = pairs % len(w.groups)
            used, number = np.unique(group, return_inverse=True)
            for d, g in zip((pairs // len(w.groups)).tolist(), (number + len(sets)).tolist(), strict=True):
                found[d].groups.append(g)
            sets += [w.members[w.groups[g] : w.groups[g + 1]] for g in used.tolist()]
            if with_matches:
                _add_matches(found, w, block, which, at, first)
    edge = np.diff((np.cumsum(turn) > 0).astype(np.int8), prepend=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    doc = np.searchsorted(first, start, side="right") - 1
    for d, a, b in zip(doc.tolist(), (start - first[doc]).tolist(), (end - first[doc]).tolist(), strict=True):
        found[d].spans.append((a, b))
    return found, sets


def _add_matches(found: list[Found], w: Windows, block: Block, which: np.ndarray, at: np.ndarray, first: np.ndarray) -> None:
    """Runs of occurrences on one diagonal of a document and an item."""
    size = w.first[which + 1] - w.first[which]
    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(w.first[which], size)
    at, item = np.repeat(at, size), w.item[place]
    diagonal = at - w.offset[place]
    by = np.lexsort((at, diagonal, item))
    at, item, diagonal = at[by], item[by], diagonal[by]
    doc = np.searchsorted(first, at, side="right") - 1
    new = np.flatnonzero(np.concatenate(([True], (item[1:] != item[:-1]) | (diagonal[1:] != diagonal[:-1]) | (at[1:] != at[:-1] + 1))))
    for a, b in zip(new.tolist(), np.append(new[1:], len(at)).tolist(), strict=True):
        d, k = doc[a], item[a]
        start = int(at[a] - first[d])
        name = int(block.item_ids[k]) if block.known[k] else None
        found[d].matches.setdefault((name, int(diagonal[a] - first[d])), []).append((start, start + b - a + w.length - 1))


def _listed(found: list[Found], sets: list[np.ndarray]):
    """(number, digest) of the items of each text; texts with the same groups share them."""
    known: dict[tuple[int, ...], tuple[int, str]] = {}
    for f in found:
        key = tuple(sorted(f.groups))
        if key not in known:
            items = np.unique(np.concatenate([sets[g] for g in key])) if key else ()
            known[key] = (len(items), hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest())
        yield known[key]


def find_contaminated(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, share: int = SHARE, carry: tuple[str, ...] = (), with_text: bool = False, with_matches: bool = True,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans (first word and end of each longest run of hit words) and,
    if asked for, matches (item, first word here and in the item, and number of words of each longest match with each item). ``carry`` names columns
    that come along in a struct ``rest``."""
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text"))
    total = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    folder = new_folder(docs.sparkSession, "benchmark")

    def cut(batches):
        for b in batches:
            for i, t in zip(b.column("item_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
                parts = item_pieces(t or b"", window)
                yield pa.RecordBatch.from_pydict({"item_id": pa.array([i] * len(parts), pa.int64()), "before": pa.array([n for n, _ in parts], pa.int64()), "text": [x for _, x in parts]})

    def write(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("item_id", "before", "text")), strict=True), key=lambda r: (r[0] is None, r[0] or 0, r[2], r[1]))
        where, base = fs.FileSystem.from_uri(folder)
        where.create_dir(base, recursive=True)
        name = uuid.uuid4().hex
        with where.open_output_stream(f"{base}/{name}") as f:
            f.write(block_windows(rows, window).to_bytes())
        return pa.table({"path": [f"{folder}/{name}"]})

    blocks = max(1, -(-total // block_bytes))
    parts = items.dropDuplicates().mapInArrow(cut, "item_id long, before long, text binary")
    dealt = parts.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    paths = [r.path for r in dealt.groupBy("block").applyInArrow(write, "path string").collect()]  # one name for each block
    drop_at_end(docs.sparkSession, folder)
    df = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), *([F.struct(*carry).alias("rest")] if carry else []))
    head = [f for f in df.columns if f != "text" or with_text]
    schema = T.StructType(df.select(head).schema.fields + T.StructType.fromDDL("n_words long, spans array<struct<start: long, end: long>>, n_items long, items_sha256 string" + f", matches {MATCH}" * with_matches).fields)
    arrow = to_arrow_schema(schema)

    def run(batches):
        for shard in slices(batches, "text", SHARD_BYTES):
            texts = [t or b"" for t in shard.column("text").cast(pa.binary()).to_pylist()]
            found, sets = _shard(texts, map(_block, paths), window, with_matches)
            out = [
                {"n_words": f.n_words, "spans": [{"start": a, "end": b} for a, b in f.spans], "n_items": n, "items_sha256": digest}
                | ({"matches": [{"item_id": i, "start": a, "item_start": a - d, "n_words": b - a} for (i, d), spans in f.matches.items() for a, b in _merged(spans)]} if with_matches else {})
                for f, (n, digest) in zip(found, _listed(found, sets), strict=True)
            ]
            columns = [shard.column(n) for n in head] + [pa.array([o[f.name] for o in out], f.type) for f in arrow if f.name not in head]
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([pa.field(f.name, c.type) for f, c in zip(arrow, columns, strict=True)]))

    df = df.mapInArrow(run, schema)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    out = df.withColumn("n_hit", n_hit)
    return out.select(
        "doc_id", *(["text"] if with_text else []), *(["rest"] if carry else []), "n_words", "n_hit", "n_items", "items_sha256",
        ((F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))).alias("contaminated"), "spans", *(["matches"] if with_matches else []),
    )


_HELD: dict[str, tuple[int, Block]] = {}


def _block(path: str) -> Block:
    """A block's windows. A worker keeps the first blocks that it reads, up to HELD_BYTES, and reads the others again."""
    if path in _HELD:
        return _HELD[path][1]
    where, name = fs.FileSystem.from_uri(path)
    with where.open_input_file(name) as f:
        data = f.read()
    block = Block.from_bytes(data)
    own = path.rsplit("/", 1)[0]
    for other in [p for p in _HELD if p.rsplit("/", 1)[0] != own]:  # of benchmarks that this job does not ask
        del _HELD[other]
    if sum(n for n, _ in _HELD.values()) + len(data) <= HELD_BYTES:
        _HELD[path] = (len(data), block)
    return block


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return find_contaminated(docs, benchmark, with_matches=False).drop("spans")


OP10_SQL = r"""
with d as (select doc_id, row_number() over () as r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
win as (select distinct item_id, m, array_to_string(w[i:i + m - 1], ' ') as k from (select item_id, w, m, unnest(range(1, len(w) - m + 2)) as i from (select *, least(13, len(w)) as m from b where len(w) > 0))),
ms as (select distinct m from win),
words as (select r, unnest(range(1, len(w) + 1)) as p, unnest(w) as word from d),
l as (select r, p, list(word) over (partition by r order by p rows between current row and 12 following) as l from words),
keys as (select r, p, m, array_to_string(l[1:m], ' ') as k from l, ms where len(l) >= m),
occ as (select r, p, m, item_id from keys join win using (m, k)),
hits as (select r, count(distinct q) as n_hit from (select r, unnest(range(p, p + m)) as q from occ) group by r),
items as (select r, count(distinct item_id) as n_items, array_to_string(list_sort(list_distinct(list(item_id::varchar))), ',') as items from occ group by r)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join hits using (r) left join items using (r)
"""
