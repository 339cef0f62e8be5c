"""Language-model scoring with a weighted backoff automaton.

The model is an n-gram model of words with smoothing by the lower order: p(w | h) = (c(hw) + k p(w | h')) / (c(h) + k), h' the context without
its first word, and (c + 1) / (N + V + 1) for single tokens, one share of it for unknown words; each text ends with one end token. As an automaton:
each context that training texts have is a state; a seen n-gram is an arc with the weight log10 p; the failure arc of a state has the weight
log10(k / (c(h) + k)) and leads to the state of the shorter context. A text is scored in one traversal from left to right: the state after a
token is the longest suffix of what was read that is a state, and an arc that is missing is replaced by failure arcs.

At scale the automaton fits nowhere whole. A batch of documents (see _batches.py) sends its distinct n-grams, with their local counts in training
texts, to buckets; a bucket adds up the counts and answers each batch with what the others add; the batch builds the part of the automaton that its
texts can reach, which is bounded by the batch, and traverses it. Counts cover all training documents; nothing is pruned. Single tokens are counted by
64-bit digests, longer n-grams by KEY_BITS of them at every size of the input: of n distinct ones a share of n / 2**KEY_BITS is counted with another.

Defined results: a null text is empty and scores its end token; a null doc_id trains; rows with one doc_id are scored each; an empty table gives
an empty result.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framejobs.llm import _arrays as A
from framejobs.llm import _batches as B

#: Weight of the lower order, for contexts of one and of two words.
SMOOTHING = (10.0, 3.0)
FOLDS, HELD_OUT = 7, 2
#: 64 bits would need 4.4 times the input on disk (README).
KEY_BITS = 52
SHORT = np.uint64((1 << 64) - (1 << (64 - KEY_BITS)))
CHUNK_BYTES = 1_000_000
END = np.uint64(0x5EED0E4D00000001)
IS_WORD = np.ones(256, dtype=bool)
IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
PACKED = "bucket int, batch int, word binary, word_n binary, gram binary, gram_n binary"
ANSWER = "batch int, bucket int, word_at binary, word_n binary, gram_at binary, gram_n binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, train_types long, base_score double, score double"


@dataclass
class Tokens:
    ids: np.ndarray  # of all documents, each ending with END
    first: np.ndarray  # where each document starts, and the number of all
    grams: np.ndarray  # n-grams of two and more: of all positions with one word before, then with two, ...
    ends: list[np.ndarray]  # the positions of the last tokens of those n-grams, by order


def tokens(texts: list[bytes], order: int) -> Tokens:
    ids, counts = [], []
    part: list[bytes] = []
    size = 0

    def take() -> None:
        buf = np.frombuffer(b"\n".join(part) + b"\n", dtype=np.uint8)
        start, end = A.word_spans(buf, IS_WORD)
        doc = np.searchsorted(np.cumsum([len(t) + 1 for t in part]), start, side="right")
        n = np.bincount(doc, minlength=len(part)) + 1
        out = np.full(len(start) + len(part), END, dtype=A.U64)
        out[np.arange(len(start)) + doc] = A.digests(A.prefixes(buf), start, end)
        ids.append(out)
        counts.append(n)

    for t in texts:
        part.append(t.translate(A.LOWER))
        size += len(t)
        if size > CHUNK_BYTES:
            take()
            part, size = [], 0
    if part:
        take()
    if not ids:
        return Tokens(np.empty(0, A.U64), np.zeros(1, np.int64), np.empty(0, A.U64), [])
    joined = np.concatenate(ids)
    first = np.concatenate(([0], np.cumsum(np.concatenate(counts))))
    place = np.arange(len(joined)) - np.repeat(first[:-1], np.diff(first))
    grams, ends, longer = [], [], joined
    for n in range(2, order + 1):
        longer = A.join_ids(longer[:-1], joined[n - 1 :])
        at = np.flatnonzero(place >= n - 1)
        grams.append(longer[at - (n - 1)])
        ends.append(at)
    return Tokens(joined, first, np.concatenate(grams) if grams else np.empty(0, A.U64), ends)


def held_out(ids: list, folds: int, fold: int) -> np.ndarray:
    """By the CRC of the id as text; a null id trains."""
    return np.array([i is not None and zlib.crc32(str(i).encode()) % folds == fold for i in ids], dtype=bool)


def _counted(keys: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the number of each in training texts, and which of them each key is."""
    unique, number = np.unique(keys, return_inverse=True)
    return unique, np.bincount(number, weights=train, minlength=len(unique)).astype(np.int64), number


def walk(root: list[float], seen: list[int], arcs: list[list[float]], lost: list[list[float]]) -> float:
    """One traversal of a text from left to right: the state, which is how many of the words before form a context that training texts have, is carried
    from token to token, and the weights of the arcs and failure arcs taken are added up.

    Of each token: the weight of the root's arc, whether it is a context (1 or 0), and for contexts of one, two, ... words the weight of their arc for
    it, not a number if there is none, and that of their failure arc."""
    state, total, top = 0, 0.0, len(arcs)
    for i in range(len(root)):
        while state:
            weight = arcs[state - 1][i]
            if weight == weight:
                total += weight
                state = min(state + 1, top)
                break
            total += lost[state - 1][i]
            state -= 1
        else:
            total += root[i]
            state = min(seen[i], top)
    return total


def score_texts(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", smoothing: tuple[float, ...] = SMOOTHING, folds: int = FOLDS, fold: int = HELD_OUT,
    batch_bytes: int = B.BATCH_BYTES, bucket_entries: int = B.BUCKET_ENTRIES,
) -> DataFrame:
    """One row per document: the model's log10 probability of its text (score), that of the add-one model of single tokens (base_score), and
    the counts behind them. The order of the model is one more than the number of smoothing weights."""
    order = len(smoothing) + 1
    total = B.text_bytes(docs, text)
    full, partitions = B.in_batches(docs, doc_id, text, total, batch_bytes, by_text=True)
    n_grams = max(1, total // 6 * len(smoothing))
    bits = B.bucket_bits(n_grams, bucket_entries)

    def read(table: pa.Table) -> tuple[Tokens, np.ndarray, tuple, tuple]:
        ids = table.column("doc_id").to_pylist()
        t = tokens(B.texts(table), order)
        out = held_out(ids, folds, fold)
        train = np.repeat(~out, np.diff(t.first))
        ends = np.concatenate(t.ends) if t.ends else np.empty(0, np.int64)
        return t, out, _counted(t.ids, train), _counted(t.grams & SHORT, train[ends])

    def ask(table: pa.Table) -> pa.Table:
        _, _, words, grams = read(table)
        batch = table.column("batch")[0].as_py()
        parts: dict[int, dict] = {}
        for name, (keys, counts, _), low in (("word", words, 0), ("gram", grams, 64 - KEY_BITS)):
            buckets, cuts = A.bucket_cuts(keys, bits)
            for k, b in enumerate(buckets.tolist()):
                row = parts.setdefault(b, {"bucket": b, "batch": batch})
                row[name] = A.pack(keys[cuts[k] : cuts[k + 1]] >> A.U64(low), ascending=True)
                row[f"{name}_n"] = A.pack(counts[cuts[k] : cuts[k + 1]])
        return _table(list(parts.values()), PACKED)

    def add_up(rows: pa.Table) -> pa.Table:
        got = rows.to_pylist()
        answers = [{"batch": r["batch"], "bucket": r["bucket"]} for r in got]
        for name in ("word", "gram"):
            keys = [A.unpack(r[name], ascending=True) for r in got]
            sizes = [len(k) for k in keys]
            if not sum(sizes):
                continue
            joined = np.concatenate(keys)
            counts = np.concatenate([A.unpack(r[f"{name}_n"]) for r in got]).astype(np.int64)
            place = np.argsort(joined, kind="stable")
            at = A.runs(joined[place])
            more = np.empty(len(place), dtype=np.int64)
            more[place] = np.repeat(np.add.reduceat(counts[place], at), np.diff(np.append(at, len(place)))) - counts[place]
            for answer, part in zip(answers, np.split(more, np.cumsum(sizes)[:-1]), strict=True):
                some = np.flatnonzero(part)
                answer[f"{name}_at"], answer[f"{name}_n"] = A.pack(some, ascending=True), A.pack(part[some])
        return _table(answers, ANSWER)

    def totals(rows: pa.Table) -> pa.Table:
        keys = [A.unpack(k, ascending=True) for k in rows.column("word").to_pylist()]
        counts = [A.unpack(k) for k in rows.column("word_n").to_pylist()]
        known = np.concatenate([k[n > 0] for k, n in zip(keys, counts, strict=True)])
        return pa.table({"train_tokens": [int(sum(int(n.sum()) for n in counts))], "train_types": [len(np.unique(known))]})

    def filled(counts: np.ndarray, keys: np.ndarray, rows: list[dict], name: str) -> np.ndarray:
        got = {r["bucket"]: r for r in rows}
        out = counts.copy()
        buckets, cuts = A.bucket_cuts(keys, bits)
        for k, b in enumerate(buckets.tolist()):
            out[cuts[k] + A.unpack(got[b][f"{name}_at"], ascending=True).astype(np.int64)] += A.unpack(got[b][f"{name}_n"]).astype(np.int64)
        return out

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _table([], SCORES)
        t, out, (words, word_n, word_of), (grams, gram_n, gram_of) = read(left)
        rows = right.to_pylist()
        n, v = rows[0]["train_tokens"], rows[0]["train_types"]
        word_n, gram_n = filled(word_n, words, rows, "word"), filled(gram_n, grams, rows, "gram")
        p = (word_n + 1) / (n + v + 1)
        # The part of the automaton that the batch can reach, laid along its tokens.
        root, seen = np.log10(p)[word_of], (word_n > 0).astype(np.int64)[word_of]
        arcs, lost, below, before, cut = [], [], p[word_of], word_n[word_of], 0
        for k, at in zip(smoothing, t.ends, strict=False):
            count, context = np.zeros(len(t.ids), dtype=np.int64), np.zeros(len(t.ids), dtype=np.int64)
            count[at], context[at] = gram_n[gram_of[cut : cut + len(at)]], before[at - 1]
            cut += len(at)
            below = (count + k * below) / (context + k)
            arcs.append(np.where(count > 0, np.log10(below), np.nan))
            lost.append(np.log10(k / (context + k)))
            before = count
        score = []
        for s, e in pairwise(t.first.tolist()):
            score.append(walk(root[s:e].tolist(), seen[s:e].tolist(), [x[s:e].tolist() for x in arcs], [x[s:e].tolist() for x in lost]))
        by_doc = lambda x: np.add.reduceat(x, t.first[:-1])
        return pa.table({
            "doc_id": left.column("doc_id"), "held_out": pa.array(out), "n_tokens": pa.array(np.diff(t.first)),
            "n_known": pa.array(by_doc(seen)), "train_tokens": pa.array(np.full(len(out), n)),
            "train_types": pa.array(np.full(len(out), v)), "base_score": pa.array(by_doc(root)), "score": pa.array(score, pa.float64()),
        })

    n_buckets = min(1 << bits, partitions)
    dealt = full.groupBy("batch").applyInArrow(ask, PACKED).repartition(n_buckets, "bucket").groupBy("bucket")
    sums = dealt.applyInArrow(totals, "train_tokens long, train_types long").agg(F.sum("train_tokens").alias("train_tokens"), F.sum("train_types").alias("train_types"))
    answers = dealt.applyInArrow(add_up, ANSWER).crossJoin(F.broadcast(sums))  # one row
    return full.groupBy("batch").cogroup(answers.repartition(partitions, "batch").groupBy("batch")).applyInArrow(finish, SCORES)


def _table(rows: list[dict], ddl: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64()}
    fields = [f.split() for f in ddl.split(", ")]
    return pa.table([pa.array([r.get(n) for r in rows], kinds[k]) for n, k in fields], names=[n for n, _ in fields])


def op2_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
