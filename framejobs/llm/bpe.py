"""BPE encoding and decoding with a pair occurrence index.

A batch of texts is split at blanks, and what the task has not met yet is cut into its units (words, digits, signs); new units are laid side by side in
one array of symbols, each once. An index maps every pair of neighbours that has a rank to all places where it occurs. The active ranks are taken in
ascending order from a heap: the pair of the lowest rank is merged at its places from left to right, and the lists of the pairs that this makes are
added to. Places whose symbols have been merged away meanwhile are passed over when their list comes up. A unit of any length costs n log n. What units and whole
pieces between blanks become is kept for the following batches, up to a bound; a piece that is a single unit is the same entry.

Texts are normalised and cut here where they have letters below U+0300 and common punctuation only, and by the tokenizer's own normaliser and rules
where they have others, so that its tables of Unicode decide there. Strings of special tokens in a text are those tokens, as in the library.

Defined results: a null text is empty; an empty text has no ids and decodes to an empty text; documents with one id are encoded each; an empty table
gives an empty result; of other columns none is read.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from functools import cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framejobs.llm._batches import slices

#: Units and pieces kept by a task, and their letters; bytes of text in a slice; new pieces that are merged at once; places from which
#: on a list is merged by NumPy.
KEPT, KEPT_LETTERS, SLICE_BYTES, AT_ONCE, MANY = 600_000, 8_000_000, 2_000_000, 100_000, 48
#: Texts of these characters alone are cut here: below U+0300, and dashes, quotes, bullets, dots and the euro sign.
_PLAIN = re.compile("[\x00-\x1b -\u02ff\u2010-\u2027\u20ac]*")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself where it prints, else the next unused one from U+0100."""
    printing = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printing else chr(next(spare)) for b in range(256)]


class Bpe:
    """A byte-level BPE vocabulary with word ends, from a tokenizers file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"] or ""
        vocab = model["vocab"]
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        self.rules = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        self.index_rules()
        letters = byte_letters()
        self.inner, self.last = (np.array([vocab.get(c + end, -1) for c in letters], dtype=np.int32) for end in ("", suffix))
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added = {t: array("I", [i]).tobytes() for t, i in added.items()}
        self.split_added = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        texts = dict(zip(vocab.values(), vocab, strict=True)) | {i: t for t, i in added.items()}
        self.texts = [texts.get(i, "") for i in range(max(texts) + 1)]
        self.rule = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.byte_of = {c: b for b, c in enumerate(letters)}
        self.library = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.held = 0

    def index_rules(self) -> None:
        """Ranks by pair, as a dictionary and as sorted arrays; whether what a merge makes is only merged by later rules."""
        self.ranks = {a << 32 | b: r for r, (a, b, _) in reversed(list(enumerate(self.rules)))}
        self.codes = np.array(sorted(self.ranks), dtype=np.int64)
        self.code_ranks = np.array([self.ranks[c] for c in self.codes.tolist()], dtype=np.int64)
        first = {}
        for r, (a, b, _) in enumerate(self.rules):
            first.setdefault(a, r)
            first.setdefault(b, r)
        self.ascending = all(first.get(made, r + 1) > r for r, (_, _, made) in enumerate(self.rules))

    def pieces(self, text: str) -> list[str]:
        """A text without special tokens, normalised and split at blanks, across which no unit reaches."""
        if _PLAIN.fullmatch(text):
            return text.lower().split()
        return [p for p in self.library.normalizer.normalize_str(text).split(" ") if p]

    def units(self, piece: str) -> list[str]:
        """The units of a piece."""
        if _PLAIN.fullmatch(piece):
            return self.rule.findall(piece)
        return [bytes(map(self.byte_of.__getitem__, u)).decode() for u, _ in self.library.pre_tokenizer.pre_tokenize_str(piece)]

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs of symbols; -1 where a pair has none."""
        codes = (left.astype(np.int64) << 32) | right
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, self.code_ranks[at], -1)

    def merge(self, units: list[str]) -> list[bytes]:
        """The ids of each of some distinct units that are not empty."""
        if not units:
            return []
        data = [u.encode() for u in units]
        ends = np.cumsum([len(d) for d in data])
        raw = np.frombuffer(b"".join(data), dtype=np.uint8)
        symbols = self.inner[raw]
        symbols[ends - 1] = self.last[raw[ends - 1]]
        known = symbols >= 0
        ends = np.cumsum(known)[ends - 1]
        symbols = symbols[known]
        n = len(symbols)
        # The same memory as arrays, for lists with few places, and as NumPy arrays, for lists with many.
        ids, after, before = array("i", symbols.tobytes()), array("i", range(1, n + 1)), array("i", range(-1, n - 1))
        ids_, after_, before_ = (np.frombuffer(x, dtype=np.int32) for x in (ids, after, before)) if n else ([],) * 3
        last = ends[np.diff(ends, prepend=0) > 0] - 1
        if n:
            after_[last] = -1
            before_[np.append(0, last[:-1] + 1)] = -1

        index: dict[int, list[int]] = {}
        active: list[int] = []

        def add(ranks: np.ndarray, places: np.ndarray) -> None:
            order = np.argsort(ranks, kind="stable")
            ranks, places = ranks[order], places[order]
            for s, e in pairwise(np.append(np.flatnonzero(np.diff(ranks, prepend=-1)), len(ranks)).tolist()):
                r = int(ranks[s])
                if r not in index:
                    index[r] = []
                    heapq.heappush(active, r)
                index[r] += places[s:e].tolist()

        def add_pairs(left: np.ndarray, right: np.ndarray) -> None:
            ranks = self.rank_of(ids_[left], ids_[right])
            add(ranks[ranks >= 0], left[ranks >= 0])

        if n:
            start = np.flatnonzero(after_ >= 0)
            add_pairs(start, start + 1)
        while active:
            r = heapq.heappop(active)
            a, b, joined = self.rules[r]
            places = index.pop(r)
            if a != b and len(places) >= MANY and self.ascending:
                i = np.unique(np.array(places, dtype=np.int32))
                j = after_[i]
                good = (ids_[i] == a) & (j >= 0) & (ids_[j] == b)  # the others have been merged away since
                i, j = i[good], j[good]
                ids_[i], ids_[j] = joined, -1
                k = after_[j]
                after_[i] = k
                before_[k[k >= 0]] = i[k >= 0]
                h = before_[i]
                add_pairs(np.concatenate([h[h >= 0], i[k >= 0]]), np.concatenate([i[h >= 0], k[k >= 0]]))
            else:
                self._merge_one_by_one(r, sorted(places), ids, after, before, index, active)
        kept = ids_ >= 0 if n else np.empty(0, dtype=bool)
        bounds = np.append(0, np.cumsum(kept))[np.append(0, ends)] * 4
        flat = ids_[kept].tobytes() if n else b""
        return [flat[s:e] for s, e in pairwise(bounds.tolist())]

    def _merge_one_by_one(self, r: int, places: list[int], ids, after, before, index: dict, active: list) -> None:
        ranks, (a, b, joined) = self.ranks, self.rules[r]
        for n, i in enumerate(places):
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], k, h = joined, -1, after[j], before[i]
            after[i] = k
            if k >= 0:
                before[k] = i
            lower = False
            for x, y in ((h, i), (i, k)):
                if x >= 0 and y >= 0 and (s := ranks.get(ids[x] << 32 | ids[y])) is not None:
                    if s not in index:
                        index[s] = []
                        heapq.heappush(active, s)
                    index[s].append(x)
                    lower |= s < r
            if lower:  # a pair of a lower rank goes first; the other places wait
                if r not in index:
                    index[r] = []
                    heapq.heappush(active, r)
                index[r] += places[n + 1 :]
                break

    def learn(self, pieces: set[str]) -> None:
        """Adds pieces, and their units, to what is known."""
        known = self.known
        new = [p for p in pieces if p not in known]
        self.held += sum(map(len, new))
        if len(known) + len(new) > KEPT or self.held > KEPT_LETTERS:
            known.clear()
            new = list(pieces)
            self.held = sum(map(len, new))
        for s in range(0, len(new), AT_ONCE):
            cut = {p: self.units(p) for p in new[s : s + AT_ONCE]}
            units = [u for u in {u for us in cut.values() for u in us} if u not in known]
            known.update(zip(units, self.merge(units), strict=True))
            known.update((p, b"".join([known[u] for u in us])) for p, us in cut.items())

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        parts = [[t] if self.split_added is None or self.split_added.search(t) is None else self.split_added.split(t) for t in texts]
        cut = [[None if p in self.added else self.pieces(p) for p in ps] for ps in parts]
        self.learn(set().union(*(c for cs in cut for c in cs if c is not None)))
        look = self.known.__getitem__
        return [b"".join([self.added[p] if c is None else b"".join(map(look, c)) for p, c in zip(ps, cs, strict=True)]) for ps, cs in zip(parts, cut, strict=True)]

    def decode(self, ids: bytes) -> str:
        """The tokens' strings, joined by blanks: the tokenizer has no decoder."""
        return " ".join(map(self.texts.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@cache
def load(path: str) -> Bpe:
    """One vocabulary for each Python worker."""
    return Bpe(path)


def encode_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids): the ids of each whole text, as little-endian unsigned 32-bit integers in a binary column."""
    path = path or tokenizer_path()

    def run(batches):
        bpe = load(path)
        for b in slices(batches, "text", SLICE_BYTES):
            ids = bpe.encode(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    cut = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return cut.mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids, text): encoded documents with the texts that their ids stand for."""
    path = path or tokenizer_path()

    def run(batches):
        bpe = load(path)
        for b in slices(batches, "ids", SLICE_BYTES):
            texts = pa.array([bpe.decode(x) for x in b.column("ids").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, texts], names=["doc_id", "n_tokens", "ids", "text"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids binary, text string")


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded texts of all documents, as digests."""
    done = decode_documents(encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"))
