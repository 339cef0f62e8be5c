import hashlib
import random

import numpy as np
import pytest

from framejobs.llm import suffix_dedup as S
from framejobs.llm.suffix_dedup import find_repeats

SCHEMA = "doc_id long, text string, batch string, rest int"


def brute(rows, n):
    """Straight from the definition: every window whose string starts earlier is removed."""
    order = sorted(((-(2**63) if i is None else i), (t or "").encode(), k) for k, (i, t) in enumerate(rows))
    seen, out = set(), []
    for _, b, k in order:
        gone = bytearray(len(b))
        for p in range(len(b) - n + 1):
            w = b[p : p + n]
            if w in seen:
                gone[p : p + n] = b"\1" * n
            seen.add(w)
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1]))
        out.append((rows[k][0], len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def texts(seed, n_docs, alphabet):
    r = random.Random(seed)
    pool = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 90))) for _ in range(6)]
    for k in range(n_docs):
        parts = [r.choice(pool) if r.random() < 0.5 else "".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(r.randint(0, 6))]
        yield (k, "".join(parts))


@pytest.mark.parametrize(("n", "alphabet", "crowd"), [(12, "ab", 10_000), (12, "ab", 1), (20, "abcdé", 3), (20, "a", 10_000), (100, "abcdefg ", 10_000), (100, "abcdefg ", 2), (3, "abc", 50)])
def test_matches_the_definition(spark, n, alphabet, crowd):
    rows = list(texts(n, 60, alphabet))
    rows += [(200, None), (201, ""), (None, rows[3][1] * 3), (7, rows[7][1]), (7, "abab" * 30), (300, rows[9][1])]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA).repartition(3)
    got = find_repeats(df, min_len=n, batch_bytes=1500, bucket_entries=50, crowd=crowd, with_text=True, carry=("batch", "rest")).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == brute(rows, n)
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in got)
    assert all(r.rest.batch == "x" for r in got)


def test_empty_table(spark):
    assert find_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_texts_in_pieces(monkeypatch):
    """Cut into overlapping pieces, a text still has each window in exactly one run, and equal windows sample equal q-grams."""
    monkeypatch.setattr(S, "CHUNK_BYTES", 70)
    r = random.Random(6)
    texts = [bytes(r.choice(b"abc") for _ in range(n)) for n in (0, 11, 12, 300, 81, 82, 500)] + [b"a" * 200]
    n, q = 12, 4
    s = S._sample(texts, n, q)
    starts = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    joined, at, by, names = b"".join(texts), [], {}, {}
    for g, seg, low, lo, hi, d in zip(s.gram.tolist(), s.seg.tolist(), s.low.tolist(), s.lo.tolist(), s.hi.tolist(), s.doc.tolist(), strict=True):
        assert starts[d] <= lo <= hi and hi + n <= starts[d + 1]
        names.setdefault(joined[lo : hi + n], set()).add((seg, low))
        for p in range(lo, hi + 1):
            at.append(p)
            by.setdefault(joined[p : p + n], set()).add(g)
    assert sorted(at) == sorted(int(starts[k]) + p for k, t in enumerate(texts) for p in range(len(t) - n + 1))
    assert all(len(v) == 1 for v in by.values())
    assert all(len(v) == 1 for v in names.values()) and len({min(v) for v in names.values()}) == len(names)


@pytest.mark.parametrize("n", [1, 5, 8, 9, 31, 100, 130])
def test_refinement_puts_equal_strings_in_one_bucket(n):
    r = random.Random(n)
    for alphabet in (b"ab", b"a", bytes(range(97, 120))):
        part = bytes(r.choice(alphabet) for _ in range(400))
        data = part + bytes(r.choice(alphabet) for _ in range(500)) + part[50:350] + part
        pointer = S.refined(np.frombuffer(data, dtype=np.uint8), n)[: len(data) - n + 1].tolist()
        strings = [data[p : p + n] for p in range(len(data) - n + 1)]
        assert len(set(zip(pointer, strings, strict=True))) == len(set(pointer)) == len(set(strings))


def test_one_q_gram_in_a_crowd_of_runs(spark):
    """A third of all rows share a passage that is shorter than a window, in contexts of their own, some of which repeat."""
    r = random.Random(8)
    say = lambda k: "".join(r.choice("abcdefghij") for _ in range(k))
    passage, contexts = say(15), [say(40) for _ in range(30)]
    rows = [(k, say(10) + (r.choice(contexts)[-r.randint(5, 40) :] + passage + r.choice(contexts)[: r.randint(5, 40)] if k % 3 == 0 else say(40))) for k in range(300)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA).repartition(3)
    want = brute(rows, 20)
    for crowd in (5, 10_000):
        got = find_repeats(df, min_len=20, batch_bytes=1500, bucket_entries=50, crowd=crowd).collect()
        assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == want


def test_memory_of_a_batch_of_near_identical_text():
    """Sampling and refining a 6 MB batch, twice the size used, of texts that differ in a few places takes less than 200 MB."""
    import tracemalloc

    r = random.Random(3)
    base = "".join(r.choice("abcdefghij ") for _ in range(3000)).encode()
    texts = []
    for _ in range(2000):
        t = bytearray(base)
        for _ in range(6):
            t[r.randrange(3000)] = r.randrange(97, 120)
        texts.append(bytes(t))
    tracemalloc.start()
    s = S._sample(texts, 100, 32)
    c = S._classes(s)
    assert tracemalloc.get_traced_memory()[1] < 200e6
    joined = np.frombuffer(b"".join(texts), dtype=np.uint8)
    part = c.first
    size = s.hi[part] + 100 - s.lo[part]
    pack = S.A.pack
    row = {"bucket": 0, "batch": 0, "kind": S.BYTES, "key": pack(c.grams[c.gram]), "doc": pack(s.doc[part]), "at": pack(s.lo[part]), "size": pack(size)}
    data = S.zstandard.ZstdCompressor().compress(joined[S._spread(s.lo[part], size)[0]].tobytes())
    tracemalloc.reset_peak()
    before = tracemalloc.get_traced_memory()[0]
    assert S._refine(100)(S._table([row | {"bytes": data}], S.REFINE)).num_rows == 1
    assert tracemalloc.get_traced_memory()[1] - before < 200e6
