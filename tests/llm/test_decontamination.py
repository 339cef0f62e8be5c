import hashlib
import random
import re

import pytest

from framejobs.llm.decontamination import find_contaminated

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(t):
    return WORD.findall((t or "").translate(LOW))


def brute(docs, items, n):
    out = []
    for i, t in docs:
        ws = words(t)
        hit, found = set(), set()
        for j, it in items:
            iw = words(it)
            m = min(n, len(iw))
            wins = {tuple(iw[k : k + m]) for k in range(len(iw) - m + 1)} if m else set()
            for p in range(len(ws) - m + 1 if m else 0):
                if tuple(ws[p : p + m]) in wins:
                    hit.update(range(p, p + m))
                    found.add(j)
        found = {j for j in found if j is not None}
        listed = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((i, len(ws), len(hit), len(found), listed, bool(hit) and 20 * len(hit) >= len(ws)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_bytes", [10**6, 200])
def test_matches_the_definition(spark, block_bytes):
    r = random.Random(5)
    vocabulary = [w for a in "abcé" for w in (a, a.upper(), a + "x", a + "9")]
    say = lambda k: r.choice([" ", "-", "\n"]).join(r.choice(vocabulary) for _ in range(k))
    items = [(k, say(r.choice([0, 2, 5, 12, 13, 20, 40]))) for k in range(30)] + [(3, "again B"), (None, say(14)), (90, None), (91, ""), (92, "zz"), (93, "zz")]
    docs = []
    for k in range(80):
        parts = [say(r.randint(0, 120))]
        if r.random() < 0.7:
            parts += [r.choice(items)[1] or "", say(r.randint(0, 30))]
        docs.append((k, " ".join(parts)))
    docs += [(100, None), (101, ""), (102, "..."), (5, docs[5][1]), (None, "ZZ"), (103, " ".join(i[1] or "" for i in items) * 2)]
    a = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, items string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = find_contaminated(a, b, block_bytes=block_bytes, carry=("items",), with_text=True).collect()
    assert sorted(((g.doc_id, g.n_words, g.n_hit, g.n_items, g.items_sha256, g.contaminated) for g in got), key=str) == brute(docs, items, 13)
    for g in got:
        ws = words(g.text)
        for m in g.matches:
            part = ws[m.start : m.start + m.n_words]
            assert len(part) == m.n_words and any(f" {' '.join(part)} " in f" {' '.join(words(t))} " for j, t in items if j == m.item_id)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in find_contaminated(docs, none).collect()] == [False]
    assert find_contaminated(docs.limit(0), none).count() == 0


@pytest.mark.parametrize("piece_bytes", [500_000, 60])
def test_longest_matches_with_every_item(monkeypatch, piece_bytes):
    """All maximal runs of equal words on one diagonal, of a window or more, with each item; long items are cut into pieces."""
    from framejobs.llm import decontamination as D

    r = random.Random(piece_bytes)
    say = lambda k: " ".join(r.choice("abc") for _ in range(k))
    common = say(20)
    items = [(k, f"{say(r.randint(0, 6))} {common} {say(r.randint(0, 60))}") for k in range(6)] + [(9, "a b c")]
    docs = [f"{say(30)} {common} {say(20)}", say(200), "", items[0][1], "x a b c x", common]
    n = 5
    want = []
    for t in docs:
        ws, found = words(t), set()
        for j, it in items:
            iw = words(it)
            m = min(n, len(iw))
            for d in range(-len(iw), len(ws)):
                run = 0
                for p in range(max(d, 0), min(len(ws), len(iw) + d) + 1):
                    if p < min(len(ws), len(iw) + d) and ws[p] == iw[p - d]:
                        run += 1
                        continue
                    if run >= m:
                        found.add((j, p - run, p - run - d, run))
                    run = 0
        want.append(found)
    monkeypatch.setattr(D, "PIECE_BYTES", piece_bytes)
    rows = [(j, b, x) for j, t in items for b, x in D.item_pieces(t.encode(), n, piece_bytes)]
    assert (len(rows) > len(items)) == (piece_bytes == 60)
    blocks = [D.Block.from_bytes(D.block_windows(part, n).to_bytes()) for part in (rows[::2], rows[1::2])]
    got = D._shard([t.encode() for t in docs], blocks, n)
    assert [{(i, a, a - d, b - a) for (i, d), spans in f.matches.items() for a, b in D._merged(spans)} for f in got[0]] == want


def test_repeated_and_long_items(spark):
    r = random.Random(2)
    long = " ".join(r.choice(["alpha", "Beta", "c", "dé"]) for _ in range(300_000))
    ws = long.split()
    docs = [(k, " ".join(ws[k * 29_000 : k * 29_000 + 40])) for k in range(10)] + [(20, " ".join(reversed(ws[:60]))), (21, "x " * 200_000)]
    items = [(1, long)] * 3 + [(2, "unrelated words here")] * 20
    a = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    got = {g.doc_id: g for g in find_contaminated(a, spark.createDataFrame(items, "item_id long, text string"), block_bytes=400_000).collect()}
    assert all(got[k].n_hit == got[k].n_words == 40 and got[k].matches[0].n_words == 40 for k in range(10))
    assert not got[21].contaminated and got[21].n_words == 200_000


def test_a_passage_that_very_many_items_share(spark, monkeypatch):
    """Documents gather groups of items, so the work grows with documents plus items, not with their product; blocks beyond what is held are read again."""
    from framejobs.llm import decontamination as D

    passage = " ".join(f"w{k}" for k in range(40))
    items = [(k, f"own{k} {passage} tail{k}") for k in range(10_000)] + [(None, passage)]
    docs = [(k, f"before {passage} after{k}") for k in range(3_000)] + [(5_000, f"own7 {passage}"), (5_001, "w0 w1 w2")]
    blocks = [D.block_windows([(i, 0, t.encode()) for i, t in part], 13) for part in (items[:6_000], items[6_000:])]
    found, sets = D._shard([t.encode() for _, t in docs], blocks, 13, with_matches=False)
    assert len(sets) <= 6 and all(len(f.groups) == 2 for f in found[:3_000]) and not found[-1].groups
    monkeypatch.setattr(D, "HELD_BYTES", 0)
    a, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(2), spark.createDataFrame(items, "item_id long, text string")
    got = {g.doc_id: g for g in find_contaminated(a, b, with_matches=False, block_bytes=1_000_000).collect()}
    every = hashlib.sha256(",".join(sorted(map(str, range(10_000)))).encode()).hexdigest()
    assert all((got[k].n_items, got[k].items_sha256, got[k].n_hit) == (10_000, every, 40) for k in range(3_000))
    assert (got[5_000].n_hit, got[5_000].n_items, got[5_001].n_items, got[5_001].contaminated) == (41, 10_000, 0, False)
    assert "matches" not in got[0].asDict() and [tuple(s) for s in got[0].spans] == [(1, 41)]
