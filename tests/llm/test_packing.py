import random
import zlib
from collections import defaultdict
from itertools import combinations_with_replacement

import numpy as np
import pytest

from framejobs.llm.packing import Sums, encoder, pack_documents, plan, tokenizer_path

ODD = ["don't we'll 'S 're x's", "a\xa0b  c", "a b", "tab\tand  two\n\n\nlines \n x", "x²y 5² ½a Ⅷ5 5Ⅷ", "<|endoftext|> a<|endoftext|>", "日本語 текст, Ж1", "éá naïve,coöp", "$$$ ###a a### 12ab ab12", "᠎a ​b﻿", " ", "", "\x1ca\x1d b", "aЖ bñ_c _d", "\r\n\r\n a", "it's-a 'tis ''s", "🙂🙂 a🙂"]


def test_units_give_the_ids_of_whole_texts():
    e = encoder(tokenizer_path())
    r = random.Random(1)
    texts = ODD + ["".join(r.choice(["a", "é", " ", "\n", "'", "s", "t", ",", "7", "Ж", "_", "²", "́", "ll", "  "]) for _ in range(r.randint(1, 30))) for _ in range(3000)]
    assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)] == [t.ids for t in e.tokenizer.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_every_length_once(seed):
    r = np.random.default_rng(seed)
    counts = np.zeros(101, dtype=np.int64)
    counts[1:] = r.integers(0, [1, 3, 50, 1000][seed] + 1, 100)
    got = plan(counts)
    used = np.zeros_like(counts)
    for inside, times in got:
        assert sum(inside) <= 100 and times > 0
        used += np.bincount(inside, minlength=101) * times
    assert (used == counts).all()
    bound = max(-(-int((counts * np.arange(101)).sum()) // 100), int(counts[51:].sum()))
    assert sum(t for _, t in got) <= bound * 1.04 + 1
    assert plan(np.zeros(11)) == []


@pytest.mark.parametrize("seed", range(5))
def test_index_of_sums_against_all_combinations(seed):
    """A gap is filled by a single, else a pair, else a triple, that with the longest length first, if and only if the counts have one."""
    r = np.random.default_rng(seed)
    left = r.integers(0, [2, 2, 3, 4, 2][seed], 41) * (r.random(41) < [0.2, 0.5, 0.5, 0.8, 1][seed])
    left[0] = 0
    sums = Sums(left)
    for _ in range(300):
        gap = int(r.integers(1, 41))
        want = ()
        for k in (1, 2, 3):
            every = (c[::-1] for c in combinations_with_replacement(range(1, 41), k) if sum(c) == gap)
            fits = [c for c in every if all(left[x] >= c.count(x) for x in c)]
            if fits:
                want = max(fits)
                break
        assert sums.exact(gap) == want
        for x in want if r.random() < 0.4 else ():
            left[x] -= 1


def test_short_piece_comes_first(spark):
    long = "alpha beta " * 3000
    got = sorted((p.piece, p.start, p.length) for p in pack_documents(spark.createDataFrame([(1, long)], "doc_id long, text string")).collect())
    n = len(encoder(tokenizer_path()).tokenizer.encode(long, add_special_tokens=False).ids) + 1
    assert n % 1024 and got == [(0, 0, n % 1024)] + [(k + 1, n % 1024 + 1024 * k, 1024) for k in range(n // 1024)]


def test_pieces_and_places(spark):
    r = random.Random(2)
    rows = [(k, " ".join(r.choice(["alpha", "beta,", "γ", "x1"]) for _ in range(r.randint(0, 90)))) for k in range(150)]
    rows += [(200, None), (201, ""), (None, "a b"), (7, rows[7][1])] + [(k, "the same text") for k in range(300, 360)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, length int").repartition(4)
    got = pack_documents(df, capacity=64).collect()
    tok = encoder(tokenizer_path()).tokenizer
    want = defaultdict(list)
    for i, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        ends = list(range(len(ids), 0, -64))[::-1]  # full pieces, counted from the end
        for p, e in enumerate(ends):
            s = ends[p - 1] if p else 0
            want[i].append((p, s, e - s, zlib.crc32(np.array(ids[s:e], "<u4").tobytes())))
    have = defaultdict(list)
    for g in got:
        have[g.doc_id].append((g.piece, g.start, g.length, g.ids_crc32))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    sequences = defaultdict(list)
    for g in got:
        sequences[g.sequence_id].append((g.offset, g.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 64
    assert len(sequences) <= -(-sum(g.length for g in got) // 64) * 1.05 + 1
    assert pack_documents(df.limit(0)).count() == 0
