"""Toxicity by compression distance.

Two Zstandard dictionaries are trained, each by its own call: one on windows of ordinary text, and one on toxic text, on what tells it from ordinary
text in any language: words whose beginning clearly more toxic documents have than ordinary ones, and several times as often. Those words are left out of
the ordinary dictionary. (Trained on both classes as they stand, either would mostly hold ordinary language, and they would differ by chance; figures in
the README.) A text is cut into short windows at white space, in three phases. Each window is compressed with the ordinary dictionary alone and with the
toxic one laid over it; what the toxic one saves is the window's distance. How often a distance occurs in toxic and in ordinary documents gives its
evidence, and a logistic curve turns the evidence of all windows into a calibrated score. Both are fitted on distances under dictionaries that have not
seen the document: each half of the sample is measured, by tasks, with dictionaries of the other half. The dictionaries that score are trained on all.

Only fitting is bounded: about ``per_class`` labelled documents of each class, twice as many at most, none over ``longest`` bytes, chosen by a hash of
their ids. Of copies and near copies among them one is used, so that a large group of copies is no evidence by itself. Every document is scored over its whole text, in place: nothing is shuffled.

Defined results: null and empty texts have no windows and score like long text none of whose windows is toxic; labels that are null count for nothing, several for one document
count as the largest; a null doc_id trains nothing and is not held out; where one class has no labelled documents all scores are the share of ones.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framejobs.llm import _arrays as A
from framejobs.llm._batches import slices
from framejobs.llm._session import hash_sample, with_checkpoints

FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.3
PER_CLASS, LONGEST, SAMPLES = 3000, 20_000, 200_000
WINDOW, PHASES, LEVEL, GRAM = 80, 3, 3, 6
#: Bytes of the dictionaries, and the segments and strings that the toxic one is made of.
BASE_BYTES, TOXIC_BYTES, SEGMENT, STRING = 100_000, 4096, 16, 8
REACH, CLIP = 24, 12.0
#: Words are told by so many bytes of their beginning. It must be in DOCUMENTS toxic documents, its share of them over that of ordinary ones by Z standard
#: errors, and TIMES as frequent among their words.
BEGINNING, DOCUMENTS, Z, TIMES = 6, 3, 3.5, 4.0
_WORDS = re.compile(rb"[a-z\x80-\xff]{4,}")
_WINDOWS = re.compile(rb"[\s\S]{1,%d}(?:(?=[ \n\t])|\Z)|[\s\S]{1,%d}" % (WINDOW, WINDOW))
SCORES = "doc_id long, held_out boolean, score double, predicted int"


@dataclass
class Model:
    base: bytes
    toxic: bytes
    evidence: np.ndarray  # by distance, from -REACH to REACH
    weights: np.ndarray


def windows(text: bytes) -> list[bytes]:
    """The whole text in windows, once for each phase, so that what one phase cuts in two another has in one."""
    lower = text.translate(A.LOWER)
    out = _WINDOWS.findall(lower)
    for p in range(1, PHASES):
        at = lower.find(b" ", WINDOW * p // PHASES)
        if at > 0:
            out += _WINDOWS.findall(lower[at:])
    return out


_COMPRESSORS: dict[bytes, object] = {}


def _compressor(content: bytes):
    key = hashlib.sha1(content).digest()
    if key not in _COMPRESSORS:
        if len(_COMPRESSORS) > 8:
            _COMPRESSORS.clear()
        options = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, source_size=WINDOW, dict_size=len(content), write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS
        )
        d = zstandard.ZstdCompressionDict(content or b" " * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=options)
        _COMPRESSORS[key] = zstandard.ZstdCompressor(dict_data=d, compression_params=options).compress
    return _COMPRESSORS[key]


def distances(text: bytes, base: bytes, toxic: bytes) -> np.ndarray:
    """What the toxic dictionary saves in each window, in bytes."""
    a, b = _compressor(base), _compressor(base + toxic)
    return np.array([len(a(w)) - len(b(w)) for w in windows(text)], dtype=np.int64)


def distinct(texts: list[bytes], shingle: int = 5, digests: int = 6) -> list[bytes]:
    """The texts without those that share one of ``digests`` minima of word shingles with one before: copies and nearly all near copies."""
    seen, out = set(), []
    for t in texts:
        words = t.split()
        h = np.array([xxhash.xxh64_intdigest(b" ".join(words[k : k + shingle])) for k in range(max(1, len(words) - shingle + 1))], dtype=A.U64)
        minima = {(k, int((h * A.U64(2 * k + 1) ^ (h >> A.U64(7 + k))).min())) for k in range(digests)}
        if not minima & seen:
            out.append(t)
        seen |= minima
    return out


def telling(toxic: list[bytes], ordinary: list[bytes]) -> set[bytes]:
    """The beginnings of words that tell toxic texts from ordinary ones: in clearly more of them, and clearly more often."""

    def counted(texts):
        documents, times = Counter(), Counter()
        for t in texts:
            c = Counter(w[:BEGINNING] for w in _WORDS.findall(t))
            documents.update(c.keys())
            times.update(c)
        return documents, times, max(1, times.total())

    (d1, t1, n1), (d0, t0, n0) = counted(toxic), counted(ordinary)
    out = set()
    for w, k in d1.items():
        p = (k + d0[w]) / (len(toxic) + len(ordinary))
        error = (p * (1 - p) * (1 / len(toxic) + 1 / len(ordinary))) ** 0.5
        if k >= DOCUMENTS and k / len(toxic) - d0[w] / len(ordinary) >= Z * error and t1[w] / n1 >= TIMES * (t0[w] + 1) / n0:
            out.add(w)
    return out


def _features(d: np.ndarray, evidence: np.ndarray) -> list[float]:
    """The mean of the evidence for toxicity, and the sum of all evidence, at most CLIP either way. Neither grows with the length of ordinary text."""
    if not len(d):
        return [0.0, -CLIP]
    e = evidence[np.clip(d, -REACH, REACH) + REACH]
    return [float(np.maximum(e, 0).sum() / (len(e) + 1)), float(np.clip(e.sum(), -CLIP, CLIP))]


def _dictionary(size: int, samples: list[bytes], k: int, d: int) -> bytes:
    """Empty if the samples are too few or too short for one."""
    try:
        return samples and zstandard.train_dictionary(size, samples, k=k, d=d).as_bytes() or b""
    except zstandard.ZstdError:
        return b""


def _dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> tuple[bytes, bytes]:
    """The ordinary and the toxic dictionary."""
    told = telling(toxic, ordinary)
    plain = (_WORDS.sub(lambda m: b"" if m[0][:BEGINNING] in told else m[0], t) for t in ordinary)
    samples = list(islice((w for t in plain for w in windows(t)), SAMPLES))
    base = _dictionary(BASE_BYTES + 4096, samples, WINDOW, GRAM)[-BASE_BYTES:] or b"".join(samples)[-BASE_BYTES:]
    words = [b" " + w + b" " for t in toxic for w in _WORDS.findall(t) if w[:BEGINNING] in told]
    return base, _dictionary(TOXIC_BYTES, words, SEGMENT, STRING)


def _calibrated(d_toxic: list[np.ndarray], d_ordinary: list[np.ndarray], share: float) -> tuple[np.ndarray, np.ndarray]:
    """Evidence by distance, and the weights of a logistic curve. The first window of an ordinary document counts as a document too, so that a short text
    is not in doubt for being short."""
    evidence = np.zeros(2 * REACH + 1)
    histogram = lambda ds: np.bincount(np.clip(np.concatenate(ds), 0, REACH), minlength=REACH + 1) + 0.5
    h1, h0 = histogram(d_toxic), histogram(d_ordinary)
    ratio = np.log((h1 / h1.sum()) / (h0 / h0.sum()))
    # A window that the toxic dictionary does not help speaks for ordinary text, if for anything; one that it helps more is no weaker evidence.
    evidence[: REACH + 1] = min(ratio[0], 0.0)
    evidence[REACH + 1 :] = np.maximum.accumulate(np.maximum(ratio[1:], 0))
    short = [d[:1] for d in d_ordinary]
    x = np.array([_features(d, evidence) + [1.0] for d in d_toxic + d_ordinary + short])
    y = np.repeat([1.0, 0.0], [len(d_toxic), 2 * len(d_ordinary)])
    w = np.where(y == 1, share / len(d_toxic), (1 - share) / (2 * len(d_ordinary))) * len(y)
    weights = np.zeros(3)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        gradient = x.T @ (w * (y - p)) - 1e-2 * weights
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(3), gradient)
        weights += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return evidence, weights


Pair = tuple[bytes, bytes]
Half = tuple[list[bytes], list[bytes]]


def prepared(toxic: list[bytes], ordinary: list[bytes]) -> tuple[list[Half], list[Pair]]:
    """The halves of the sample, each its toxic and its ordinary texts, and three pairs of dictionaries: of each half, and of all."""
    toxic, ordinary = (distinct([t.translate(A.LOWER) for t in texts]) for texts in (toxic, ordinary))
    halves = [(toxic[k::2] or toxic, ordinary[k::2] or ordinary) for k in (0, 1)]
    return halves, [_dictionaries(*half) for half in (*halves, (toxic, ordinary))]


def _model(found: list[tuple[list[np.ndarray], list[np.ndarray]]], pair: Pair, share: float) -> Model:
    """From the distances of the texts of each half under the dictionaries of the other."""
    (toxic, ordinary), (more_toxic, more_ordinary) = found
    return Model(*pair, *_calibrated(toxic + more_toxic, ordinary + more_ordinary, share))


def fit(toxic: list[bytes], ordinary: list[bytes], share: float) -> Model:
    """``share``: of ones among all labels, which the sample of each class need not have. In one process; train() has tasks do the same."""
    halves, pairs = prepared(toxic, ordinary)
    found = [tuple([distances(t, *pairs[1 - k]) for t in texts] for texts in half) for k, half in enumerate(halves)]
    return _model(found, pairs[2], share)


def _prepared(sample: DataFrame) -> DataFrame:
    """prepared() of a sample (label, id, text), which is bounded, by a task: (half, label, at, text) for the texts of each half in order, and three rows
    with dictionaries, (half, at, base, toxic), half 2 for all and ``at`` the number of texts. Nothing if a class has no texts."""
    schema = "half int, label int, at int, text binary, base binary, toxic binary"

    def run(table):
        rows = list(zip(*(table.column(c).to_pylist() for c in ("label", "id", "text")), strict=True))
        rows.sort(key=lambda r: (zlib.crc32(str(r[1]).encode()), r[1], r[2]))
        classes = [[t for y, _, t in rows if y == value] for value in (1, 0)]
        out = []
        if all(classes):
            halves, pairs = prepared(*classes)
            out = [(k, 1 - j, at, t, None, None) for k, half in enumerate(halves) for j, texts in enumerate(half) for at, t in enumerate(texts)]
            out += [(k, None, len(out), None, *pair) for k, pair in enumerate(pairs)]
        names, kinds = zip(*(c.split() for c in schema.split(", ")), strict=True)
        columns = zip(*out, strict=True) if out else [[]] * len(names)
        return pa.table([pa.array(c, pa.int32() if kind == "int" else pa.binary()) for c, kind in zip(columns, kinds, strict=True)], names=names)

    return sample.select("label", "id", F.col("text").cast("binary").alias("text")).groupBy().applyInArrow(run, schema)


def _measured(texts: DataFrame, pairs: list[Pair], n: int) -> list[tuple[list[np.ndarray], list[np.ndarray]]]:
    """The distances of the texts of each half, in order, under the dictionaries of the other, measured by tasks."""

    def run(batches):
        for b in batches:
            rows = zip(b.column("half").to_pylist(), b.column("text").to_pylist(), strict=True)
            found = [distances(t, *pairs[1 - k]).astype(np.int16).tobytes() for k, t in rows]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(found, pa.binary())], names=["half", "label", "at", "found"])

    tasks = max(1, min(n // 20, 4 * texts.sparkSession.sparkContext.defaultParallelism))
    rows = texts.repartition(tasks).mapInArrow(run, "half int, label int, at int, found binary").collect()
    found = [tuple([] for _ in (1, 0)) for _ in (0, 1)]
    for r in sorted(rows, key=lambda r: r["at"]):
        found[r.half][1 - r.label].append(np.frombuffer(r.found, dtype=np.int16).astype(np.int64))
    return found


def score(text: bytes, model: Model) -> float:
    x = np.array(_features(distances(text, model.base, model.toxic), model.evidence) + [1.0])
    return float(1 / (1 + np.exp(-np.clip(x @ model.weights, -30, 30))))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", per_class: int = PER_CLASS, longest: int = LONGEST) -> Model | float:
    """A model from the labelled documents that are not held out; the share of ones if a class is missing."""
    with_checkpoints(docs.sparkSession)
    known = labels.select(F.col(doc_id).cast("long").alias("id"), F.col(label).cast("int").alias("label")).dropna().groupBy("id").agg(F.max("label").alias("label"))
    known = known.filter(F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(FOLDS)) != HELD_OUT)
    share = known.agg(F.avg(F.col("label").cast("double"))).first()[0]
    parts = []
    for value in (0, 1):
        picked = hash_sample(known.filter(F.col("label") == value), per_class, "id")
        sample = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).filter(F.octet_length("text") <= longest)
        parts.append(sample.join(F.broadcast(picked), "id").select(F.lit(value).alias("label"), "id", "text").limit(3 * per_class))  # bounded by per_class and longest
    # The driver gets dictionaries and distances, no texts.
    fitted = _prepared(parts[0].unionByName(parts[1])).checkpoint()
    trained = sorted(fitted.filter("text is null").select("half", "at", "base", "toxic").collect())
    if not trained:
        return float(share or 0.0)
    pairs = [(bytes(r.base), bytes(r.toxic)) for r in trained]
    found = _measured(fitted.filter("text is not null").select("half", "label", "at", "text"), pairs, trained[0].at)
    return _model(found, pairs[2], min(0.99, max(0.01, share)))


def score_toxicity(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", threshold: float = THRESHOLD, carry: tuple[str, ...] = (),
    with_text: bool = False, per_class: int = PER_CLASS, longest: int = LONGEST,
) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1) and predicted. ``carry`` names columns that come along in a struct ``rest``."""
    model = train(docs, labels, doc_id, text, label, per_class, longest)
    cut = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), *([F.struct(*carry).alias("rest")] if carry else []))
    kept = [n for n in cut.columns if n != "text" or with_text]

    def run(batches):
        for part in slices(batches, "text", 2_000_000):
            texts = part.column("text").cast(pa.binary()).to_pylist()
            scores = [model if isinstance(model, float) else score(t or b"", model) for t in texts]
            out = [i is not None and zlib.crc32(str(i).encode()) % FOLDS == HELD_OUT for i in part.column("doc_id").to_pylist()]
            columns = [part.column(n) for n in kept] + [pa.array(out), pa.array(scores), pa.array([int(x >= threshold) for x in scores], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "held_out", "score", "predicted"])

    schema = cut.select(kept).schema
    for name, kind in (("held_out", "boolean"), ("score", "double"), ("predicted", "integer")):
        schema = schema.add(name, kind)
    return cut.mapInArrow(run, schema)


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score_toxicity(docs, labels)
