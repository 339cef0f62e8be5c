"""The trie against a plain one, with bands of several heights."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from framejobs.llm.queries import queries
from framejobs.llm.trie import ordered_turns, prefix_trie, with_shared_heads

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def conversations(rows):
    found = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            md5 = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            found.setdefault(c, []).append(((turn is not None, turn or 0), md5, role, text))
    return {c: [x[2:] for x in sorted(t, key=lambda x: x[:2])] for c, t in found.items()}


def rebuilt(found):
    out = {}
    for c, own in found.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        out[c] = found.get(base, [])[:h] + own[h:]
    return out


def plain(found):
    nodes = {}
    for c, path in found.items():
        for d in range(len(path) + 1):
            nodes.setdefault(tuple(path[:d]), []).append(c)
    children = {k: 0 for k in nodes}
    leaves, saved = dict(children), dict(children)
    for k in nodes:
        if k:
            children[k[:-1]] += 1
    for k, members in nodes.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += children[k] == 0
            saved[k[:d]] += (len(members) - 1) * len(k[-1][1]) if k else 0
    return sorted(
        (
            min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k],
            hashlib.sha256(",".join(str(c) for c in sorted(m) if len(found[c]) == len(k)).encode()).hexdigest(),
        )
        for k, m in nodes.items()
    )


def trie(df, band, heads=True):
    turns = ordered_turns(df)
    parts = with_shared_heads(turns) if heads else (turns, turns.groupBy("conv_id").agg(F.max("n_turns").alias("n_turns")))
    return sorted(map(tuple, prefix_trie(*parts, band=band).select(*COLUMNS).collect()), key=lambda r: (r[0], r[1]))


def rows_of(seed, n=140, most=9):
    r = random.Random(seed)
    out = []
    for c in range(-30, n):
        if c % 17 == 3:
            continue  # no such conversation, so some have no base
        for t in range(r.randrange(1, most)):
            out.append((c, r.choice([None, t, t, t]), r.choice(["user", "bot", None]), r.choice(["a", "bé", "\U0001f600c", None, "long " * 9])))
    return out


@pytest.mark.parametrize("band", [2, 16])
def test_equals_a_plain_trie(spark, band):
    rows = rows_of(3)
    rows += rows[:40] + [(None, 1, "user", "x")] * 3  # repeated rows, and rows of no conversation
    assert trie(spark.createDataFrame(rows, SCHEMA).repartition(3), band) == plain(rebuilt(conversations(rows)))


def test_a_deep_conversation_and_a_hot_end(spark):
    rows = [(7, t, "user", str(t % 5)) for t in range(1300)] + [(8, t, "user", str(t % 5)) for t in range(1100)]
    rows += [(c, 0, "user", "hi") for c in range(20_000, 20_400)]
    assert trie(spark.createDataFrame(rows, SCHEMA), 4, heads=False) == plain(conversations(rows))


def test_empty_tables_and_other_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert trie(empty, 16) == []
    rows = [(1, 0, "user", "a"), (2, 0, "user", "a")]
    clash = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("depth", "digest", "k1", "chunk", "band", "leaves", "n_turns", "h", "_range")})
    assert trie(clash, 16) == plain(rebuilt(conversations(rows)))


def test_query_equals_a_plain_trie(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted(map(tuple, queries()["op13_prefix_trie"](spark, sf).select(*COLUMNS).collect()), key=lambda r: (r[0], r[1]))
    assert got == plain(rebuilt(conversations(rows)))
