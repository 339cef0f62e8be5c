"""Best-fit packing by exact-complement hashing.

Texts become token ids; a document that is longer than a sequence is cut into full pieces, the first of which may be shorter. How pieces are packed
depends on their lengths alone, so the plan is made from a histogram with one number for each length, whatever the size of the corpus. From the
longest length down, the gap that it leaves is looked up in an index of the sums of one, two and three lengths, and the first combination that the
counts allow fills it exactly; where none does, the best-fitting length goes in and what is left of the gap is looked up again. A sequence so found
is repeated as often as the counts allow. A plan row says which ranks of a length go to which sequences and where. Pieces are ranked within
(length, salt), so that no length lands in one task, and find their row by binary search.

Defined results: a null text is empty; an empty document is one end token; documents with one id are packed each; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import os
import re
import sys
import zlib
from array import array
from bisect import bisect_right
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framejobs.llm._batches import slices
from framejobs.llm._session import with_checkpoints

CAPACITY = 1024
END_ID = 2
#: Pieces in a rank group at most, on average, and the least number of groups that a length is split into.
RANK_ROWS, SALTS = 200_000, 64
CACHE, SLICE_BYTES = 200_000, 2_000_000
assert array("I").itemsize == 4 and sys.byteorder == "little"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

# White space, then either plain letters up to a character that is no letter, or all up to the next white space. Byte-level BPE never joins
# characters across such a border. Texts with white space beyond ASCII, or with what could be a special token, go whole.
_UNITS = re.compile(r"[ \t-\r]*+(?:[A-Za-zÀ-ÖØ-öø-ÿ]++(?![^\W\d_])|[^ \t-\r]+)|[ \t-\r]+")
_WHOLE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f-\u2064\u3000\ufeff]|<\\|")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Known(dict):
    """What units of text become; a new unit is encoded when it is first asked for."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, unit: str) -> bytes:
        self[unit] = out = array("I", self.encode(unit)).tobytes()
        return out


class Encoder:
    """Texts to token ids as little-endian bytes, four for each id; what a unit of text becomes is kept for the next one.

    Where the vocabulary also lies beside the tokenizer as ranks (same name, .tiktoken), new units are merged with those, in half the time.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known = _Known(self._ranks(re.sub(r"\.json$", ".tiktoken", path)) or self._plain)

    def _plain(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _ranks(self, path: str):
        if not os.path.exists(path):
            return None
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        probe = "".join(chr(c) for c in range(32, 1500)) + " the probe, of both's words 123\n\n  end"
        return fast if fast(probe) == self._plain(probe) else None

    def encode(self, texts: list[str]) -> list[bytes]:
        get, out = self.known.__getitem__, []
        for t in texts:
            if len(self.known) > CACHE:
                self.known.clear()
            out.append(array("I", self._plain(t)).tobytes() if _WHOLE.search(t) else b"".join(map(get, _UNITS.findall(t))))
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str | None = None) -> DataFrame:
    """One row for each piece of each document, in token ids with the end id: doc_id, piece, start, length, ids_crc32."""
    path = tokenizer or tokenizer_path()
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        for part in slices(batches, "text", SLICE_BYTES):
            rows = []
            for i, data in zip(part.column("doc_id").to_pylist(), encoder(path).encode([t or "" for t in part.column("text").to_pylist()]), strict=True):
                data += end
                cuts = [0, *range(len(data) // 4 % capacity or capacity, len(data) // 4 + 1, capacity)]
                for n, (s, e) in enumerate(pairwise(cuts)):
                    rows.append((i, n, s, e - s, zlib.crc32(data[4 * s : 4 * e])))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ("doc_id", "piece", "start", "length", "ids_crc32")
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, PIECES)


class Sums:
    """The index of sums: for one, two or three lengths and each of their sums, the combinations that make it, that with the longest length first.

    The combinations of a sum are listed when it is first asked for, from the lengths that are left then. Counts only fall, so a combination that
    cannot be had once is passed for good: each is looked at once, however many sequences are planned.
    """

    def __init__(self, counts: np.ndarray):
        self.left = counts
        self.index: dict[tuple[int, int], list] = {}  # (number of lengths, sum): combinations and how many of them are passed

    def _combinations(self, k: int, total: int) -> np.ndarray:
        have = np.flatnonzero(self.left[: total + 1])[::-1]
        last = np.zeros(total + 1, dtype=bool)
        last[have] = True
        if k == 1:
            return np.full((int(last[total]), 1), total)
        if k == 2:
            high = have[(have * 2 >= total) & (have < total)]
            high = high[last[total - high]]
            return np.stack([high, total - high], axis=1)
        high = have[(have * 3 >= total) & (have < total)]
        low = total - high[:, None] - have[None, :]
        i, j = np.nonzero((low >= 1) & (have[None, :] <= high[:, None]) & (low <= have[None, :]) & last[np.maximum(low, 0)])
        return np.stack([high[i], have[j], low[i, j]], axis=1)

    def exact(self, gap: int) -> tuple[int, ...]:
        """The first single, else pair, else triple that fills the gap and is left often enough; () if there is none."""
        for k in (1, 2, 3):
            if (k, gap) not in self.index:
                self.index[k, gap] = [self._combinations(k, gap), 0]
            entry = self.index[k, gap]
            found, passed = entry
            while passed < len(found):
                part = found[passed : passed + 512]
                ok, need = np.ones(len(part), dtype=bool), np.ones(len(part), dtype=np.int64)
                for c in range(k):
                    need = need * (part[:, c] == part[:, c - 1]) + 1 if c else need
                    ok &= self.left[part[:, c]] >= need
                if ok.any():
                    entry[1] = passed + int(ok.argmax())
                    return tuple(found[entry[1]].tolist())
                passed += len(part)
            entry[1] = passed
        return ()


def plan(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Sequences for ``counts[length]`` pieces: (lengths in a sequence, number of such sequences). Every step uses up a length or half of it."""
    left = np.array(counts, dtype=np.int64)
    sums, capacity, out = Sums(left), len(left) - 1, []
    for top in range(capacity, 0, -1):
        while left[top]:
            inside, gap = [top], capacity - top
            left[top] -= 1
            while gap:
                fill = sums.exact(gap)
                if not fill:  # the best fit of what is left
                    fit = np.flatnonzero(left[: gap + 1])
                    fill = (int(fit[-1]),) if len(fit) else ()
                if not fill:
                    break
                for x in fill:
                    left[x] -= 1
                inside += fill
                gap -= sum(fill)
            used = np.bincount(inside, minlength=capacity + 1)
            kinds = np.flatnonzero(used)
            times = 1 + int((left[kinds] // used[kinds]).min())
            left[kinds] -= used[kinds] * (times - 1)
            out.append((tuple(inside), times))
    return out


def pack(rows: DataFrame, capacity: int = CAPACITY, rank_rows: int = RANK_ROWS) -> DataFrame:
    """Adds sequence_id and offset to pieces (a table that gives the same rows each time it is read)."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for r in rows.groupBy("length").count().collect():  # at most one row for each length
        counts[r["length"]] = r["count"]
    first, rank, sequence = [], np.zeros(capacity + 1, dtype=np.int64), 0
    for inside, times in plan(counts):
        offset = 0
        for length in inside:
            first.append((length, int(rank[length]), sequence, offset))
            rank[length] += times
            offset += length
        sequence += times
    first.sort()
    salts = max(SALTS, int(counts.sum()) // rank_rows)
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    sizes = salted.groupBy("length", "salt").count()
    before = F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count")
    ranked = salted.withColumn("place", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")) - 1)
    ranked = ranked.join(sizes.select("length", "salt", before.alias("before")), ["length", "salt"]).withColumn("rank", F.col("before") + F.col("place"))
    keys = [f[:2] for f in first]

    def place(batches):
        for b in batches:
            where = [bisect_right(keys, k) - 1 for k in zip(b.column("length").to_pylist(), b.column("rank").to_pylist(), strict=True)]
            ranks = b.column("rank").to_pylist()
            ids = pa.array([first[w][2] + r - first[w][1] for w, r in zip(where, ranks, strict=True)], pa.int64())
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([b.column(n) for n in names] + [ids, pa.array([first[w][3] for w in where], pa.int64())], names=[*names, "sequence_id", "offset"])

    return ranked.drop("salt", "place", "before").mapInArrow(place, f"{PIECES}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, **options) -> DataFrame:
    """Pieces of all documents with their places. The pieces are checkpointed: what they are and how they rank must not change between two reads."""
    with_checkpoints(docs.sparkSession)
    return pack(pieces(docs, **options).checkpoint(), options.get("capacity", CAPACITY))


def op7_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
