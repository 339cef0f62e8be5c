import math
import random
import re
import zlib
from collections import Counter

import pytest

from framejobs.llm.lm_scoring import score_texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, smoothing):
    """The automaton spelt out with dictionaries: states, arcs, failure arcs, one pass over each text."""
    order = len(smoothing) + 1
    told = [WORD.findall((t or "").translate(LOW)) + [None] for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    grams = Counter()
    for ws, h in zip(told, held, strict=True):
        if not h:
            for n in range(1, order + 1):
                grams.update(tuple(ws[k : k + n]) for k in range(len(ws) - n + 1))
    n = sum(c for g, c in grams.items() if len(g) == 1)
    v = sum(1 for g in grams if len(g) == 1)

    def p(gram):
        if len(gram) == 1:
            return (grams[gram] + 1) / (n + v + 1)
        k = smoothing[len(gram) - 2]
        return (grams[gram] + k * p(gram[1:])) / (grams[gram[:-1]] + k)

    out = []
    for (i, _), ws, h in zip(rows, told, held, strict=True):
        score, state = 0.0, ()
        for w in ws:
            at = state
            while at and not grams[(*at, w)]:
                k = smoothing[len(at) - 1]
                score += math.log10(k / (grams[at] + k))
                at = at[1:]
            score += math.log10(p((*at, w)))
            state = (*state, w)[-(order - 1) :]
            while state and not grams[state]:
                state = state[1:]
        base = sum(math.log10((grams[(w,)] + 1) / (n + v + 1)) for w in ws)
        out.append((i, h, len(ws), sum(grams[(w,)] > 0 for w in ws), n, base, score))
    return out


@pytest.mark.parametrize("smoothing", [(10.0, 3.0), (0.7,), (2.0, 1.0, 0.5)])
def test_matches_dictionaries(spark, smoothing):
    r = random.Random(3)
    vocabulary = ["a", "B", "b", "cé", "É", "the", "of-the", "x.", "\xa0y"]
    rows = [(k, "".join(r.choice(vocabulary) + r.choice([" ", "\n ", "\t"]) for _ in range(r.randint(0, 60)))) for k in range(120)]
    rows += [(130, None), (131, ""), (None, "a b a"), (7, rows[7][1]), (132, " \n"), (133, "unseen words only")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, batch int").repartition(3)
    got = score_texts(df, smoothing=smoothing, batch_bytes=1500, bucket_entries=60).collect()
    key = lambda r: (str(r[0]), r[2], round(r[6], 6))
    want = sorted(brute(rows, smoothing), key=key)
    got = sorted(((g.doc_id, g.held_out, g.n_tokens, g.n_known, g.train_tokens, g.base_score, g.score) for g in got), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want, strict=True):
        assert math.isclose(g[5], w[5], rel_tol=1e-9) and math.isclose(g[6], w[6], rel_tol=1e-9)


def test_empty_table(spark):
    assert score_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rows_without_ids_are_spread(spark):
    """All ids null: no batch has more than twice the mean, and the scores are those of the definition."""
    from framejobs.llm import _batches as B

    rows = [(None, f"word{k % 7} text{k} end") for k in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    dealt, _ = B.in_batches(df, "doc_id", "text", B.text_bytes(df, "text"), 5_000, by_text=True)
    sizes = [r["count"] for r in dealt.groupBy("batch").count().collect()]
    assert len(sizes) > 5 and max(sizes) <= 2 * 2000 / len(sizes)
    got = sorted(g.score for g in score_texts(df, smoothing=(2.0,), batch_bytes=5_000).collect())
    want = sorted(b[-1] for b in brute(rows, (2.0,)))
    assert all(math.isclose(g, w, rel_tol=1e-9) for g, w in zip(got, want, strict=True))
