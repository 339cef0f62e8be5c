import random
import re

import pytest
import xxhash

from framejobs.llm.components import components
from framejobs.llm.simhash import fingerprint, links, near_duplicates

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain_fingerprint(t):
    ws = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
    sh = [" ".join(ws[k : k + 4]) for k in range(len(ws) - 3)] or ([" ".join(ws)] if ws else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, fps, radius):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    least = {}
    for i, k in enumerate(ids):
        r = find(i)
        least[r] = min(least.get(r, k), k) if k is not None and least.get(r) is not None else (k if k is not None else least.get(r))
    return [least[find(i)] for i in range(len(fps))]


def test_fingerprint():
    r = random.Random(1)
    for t in ["", " \n", "one", "One TWO three", "É é  a\x0bb c d e"] + [" ".join(r.choice("abcdé") for _ in range(r.randint(1, 60))) for _ in range(60)]:
        assert fingerprint(t.encode()) & (1 << 64) - 1 == plain_fingerprint(t)


@pytest.mark.parametrize("dense", [256, 3])
def test_matches_all_pairs(spark, dense):
    r = random.Random(4)
    base = [" ".join(r.choice(["alpha", "Beta", "c", "d,", "é"]) + str(r.randint(0, 40)) for _ in range(r.randint(1, 150))) for _ in range(40)]
    rows = []
    for k, t in enumerate(base):
        for v in range(r.randint(1, 6)):
            ws = t.split(" ")
            for _ in range(r.choice([0, 1, 1, 2])):
                ws[r.randrange(len(ws))] = f"new{v}"
            rows.append((1000 - len(rows), " ".join(ws)))
    rows += [(2000, None), (2001, ""), (2002, " "), (None, "zz"), (None, base[0]), (rows[5][0], rows[5][1])]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, fp int").repartition(3)
    got = near_duplicates(df, dense=dense).collect()
    fps = [plain_fingerprint(t) for _, t in rows]
    want = sorted(zip([i for i, _ in rows], [f"{f:016x}" for f in fps], plain_components([i for i, _ in rows], fps, 4), strict=True), key=str)
    assert sorted(((g.doc_id, g.fingerprint, g.component_id) for g in got), key=str) == want


@pytest.mark.parametrize("dense", [256, 8, 2])
def test_links_of_crowded_fingerprints(spark, dense):
    r = random.Random(dense)
    fps = {0, (1 << 64) - 1}
    for _ in range(12):
        c = r.getrandbits(64)
        for _ in range(30):
            x = c
            for b in r.sample(range(64), r.randint(0, 7)):
                x ^= 1 << b
            fps.add(x)
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    got = components(links(spark.createDataFrame([(f,) for f in signed], "fp long"), dense=dense)).collect()
    root = {g.node: g.root for g in got}
    assert [root.get(f, f) for f in signed] == plain_components(signed, [f & (1 << 64) - 1 for f in signed], 4)


def test_long_chain_and_empty(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 501), (501, 500), (7, 7)], "a long, b long")
    assert {(r.node, r.root) for r in components(e).collect()} == {(k, 0) for k in range(201)} | {(500, 500), (501, 500)}
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_frequent_keys_join_as_others_do(spark):
    from framejobs.llm._joins import join_frequent

    rows = spark.createDataFrame([(k % 7 if k % 3 else 1, k) for k in range(300)] + [(None, 1), (50, 2)], "k long, v long").repartition(4)
    one = rows.filter("k <> 50").groupBy("k").count().selectExpr("k", "count", "k * 10 as ten")
    want = sorted((r.k, r.v, r.ten) for r in rows.join(one, "k").collect())
    for hot_keys in (1, 3, 5, 10_000):
        assert sorted((r.k, r.v, r.ten) for r in join_frequent(rows, one, "k", "count", 302, hot_keys).collect()) == want
