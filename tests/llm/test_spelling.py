"""Spelling variants against all pairs."""

import random
import re
import zlib
from collections import Counter
from itertools import pairwise, product

import pytest
from pyspark.sql import functions as F

from framejobs.llm.spelling import Acceptor, near_words, op11_spelling, spelling_variants, vocabulary


def near(x, y):
    if x == y or abs(len(x) - len(y)) > 1:
        return False
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y, strict=True)) == 1
    x, y = sorted((x, y), key=len)
    return any(y[:i] + y[i + 1 :] == x for i in range(len(y)))


def all_near(words):
    """Near words of each, by the words that one edit makes."""
    letters = sorted({c for w in words for c in w})
    out = {}
    for w in words:
        made = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
        out[w] = {m for m in made if m in words and m != w}
    return out


def plain(counts, ratio=5):
    close = all_near(counts)
    form = {}
    for w, n in counts.items():
        best = min(close[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * n else None
    rows = []
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, n, len(close[w]), counts[form[w]] if form[w] else None))
    return sorted(rows)


def test_the_plain_rule_itself():
    words = {"".join(p) for k in (2, 3) for p in product("ab", repeat=k)}
    assert all_near(words) == {w: {v for v in words if near(w, v)} for w in words}


@pytest.fixture(scope="module")
def counts():
    r = random.Random(4)
    words = {"".join(r.choice("abé") for _ in range(r.randrange(6, 9))) for _ in range(700)}
    words |= {"prefix" * 2 + "".join(r.choice("abcd") for _ in range(r.randrange(2, 5))) for _ in range(200)}
    words |= {"a" * k for k in range(6, 15)} | {"z" * 2000 + "q", "z" * 2001 + "q", "z" * 1000 + "y" + "z" * 1000 + "q"}
    return {w: r.choice([5, 6, 24, 25, 30, 125, 626, 4000]) for w in words}


@pytest.mark.parametrize("crowd", [3, 4000])
def test_pairs_and_forms(spark, counts, crowd):
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    pairs = [(r["x"], r["y"]) for r in near_words(df, crowd).collect()]
    assert len(pairs) == len({frozenset(p) for p in pairs})
    assert {frozenset(p) for p in pairs} == {frozenset((w, v)) for w, near_ones in all_near(counts).items() for v in near_ones}
    assert sorted(map(tuple, spelling_variants(df, crowd=crowd).collect())) == plain(counts)


def test_pairs_when_spark_changes_joins_as_it_runs(spark, counts):
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(7)
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        pairs = {frozenset((r["x"], r["y"])) for r in near_words(df, 100).collect()}
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert pairs == {frozenset((w, v)) for w, near_ones in all_near(counts).items() for v in near_ones}


def test_chains_lead_to_the_last_form(spark):
    chain = {"abcdefghij"[:k] + "x" * (10 - k) : 6**k for k in range(1, 10)}
    df = spark.createDataFrame(list(chain.items()), "word string, n long")
    got = {r["word"]: r["root"] for r in spelling_variants(df).collect()}
    assert got == {w: root for w, _, root, *_ in plain(chain)} and len(set(got.values())) == 1
    assert all(near(a, b) for a, b in pairwise(chain))


def test_the_acceptor_is_minimal():
    machine, r = Acceptor(), random.Random(1)
    words = sorted({"".join(r.choice("ab") for _ in range(r.randrange(1, 7))) for _ in range(60)})
    start = machine.add(words)
    found, stack = [], [(start, "")]
    while stack:
        p, s = stack.pop()
        found += [s] * machine.final[p]
        stack += [(i, s + c) for c, i in machine.arcs[p]]
    assert sorted(found) == words
    rest = lambda s: frozenset(w[len(s) :] for w in words if w.startswith(s))
    assert len(machine.arcs) == len({rest(w[:k]) for w in words for k in range(len(w) + 1)})
    again = machine.add(words)
    assert again == start and len(machine.arcs) == len(set(zip(machine.final, machine.arcs, strict=True)))


def plain_vocabulary(rows, one_in, least_length=6, least_count=5):
    found = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % one_in == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if n >= least_count and len(w) >= least_length}


@pytest.mark.parametrize("one_in", [199, 2])
def test_vocabulary(spark, one_in):
    r = random.Random(6)
    words = ["Größe", "ÀÉÎÖÜß", "Letters", "straßen", "aaaaaaa", "Élèves×÷", "kurz", "ſtraße", "letters"]
    rows = [(i if i % 9 else None, " ".join(r.choice(words) + r.choice(["", ".", "1", "́"]) for _ in range(50))) for i in range(60)]
    rows += [(5, None), (6, ""), (7, rows[1][1]), (7, rows[1][1]), (8, "abcdefg " * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("word", "n", "run", "id", "h")})
    assert {r["word"]: r["n"] for r in vocabulary(df, one_in=one_in).collect()} == plain_vocabulary(rows, one_in)
    assert spelling_variants(vocabulary(df.limit(0))).collect() == []


def test_query_equals_all_pairs(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, op11_spelling(spark, sf).collect())) == plain(plain_vocabulary(rows, 199))
