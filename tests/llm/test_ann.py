import numpy as np

from framejobs.llm.ann import decoded, encode, fit, nearest

SCHEMA = "vec_id long, embedding array<float>, rank int"


def exact(rows, queries, k):
    ok = [(i, np.array(v, dtype=np.float32)) for i, v in rows if i is not None and v is not None and len(v) == 16 and all(x is not None for x in v)]
    ok = [(i, v) for i, v in ok if np.isfinite(v).all() and v.any()]
    ids, x = np.array([i for i, _ in ok]), np.stack([v for _, v in ok]).astype(np.float64)
    out = {}
    for q in queries:
        v = x[np.flatnonzero(ids == q)[0]]
        d = np.sqrt(((x - v) ** 2).sum(1))
        d[ids == q] = np.inf
        out[q] = [(int(ids[j]), float(d[j])) for j in np.lexsort((ids, d))[:k] if np.isfinite(d[j])]
    return out


def test_recall_order_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[500:900] = x[0]  # a crowd of copies
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    nan, inf = float("nan"), float("inf")
    rows += [(3100, None), (3200, [0.0] * 16), (3300, [nan] * 16), (3400, [inf] + [1.0] * 15), (3500, [None] + [1.0] * 15), (3600, [1.0] * 5), (None, rows[1][1]), (3700, [])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA).repartition(4)
    got = nearest(df, df.filter("vec_id % 100 = 0"), shard=700, block=9, rerank=100, books=6, codes=32).collect()
    queries = [q for q in range(0, 3000, 100)]
    want = exact(rows, queries, 10)
    assert {g.query_id for g in got} == set(queries)
    hits = 0
    for q in queries:
        mine = sorted((g.rank, g.vec_id, g.score) for g in got if g.query_id == q)
        assert [m[0] for m in mine] == list(range(1, 11)) and [m[2] for m in mine] == sorted(m[2] for m in mine)
        hits += len({m[1] for m in mine} & {w[0] for w in want[q]})
        if q in (0, 500):
            assert [(m[1], m[2]) for m in mine] == want[q]
    assert hits >= 0.9 * 10 * len(queries)


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], 1), (1, [1.0, 3.0], 1), (1, [1.0, 3.0], 1)], SCHEMA)
    assert [(g.query_id, g.rank, g.vec_id, g.score) for g in nearest(df, df.filter("vec_id = 0")).collect()] == [(0, 1, 1, 1.0), (0, 2, 1, 1.0)]
    assert nearest(df.limit(0), df.limit(0)).count() == 0


def test_beam_search_is_no_worse_than_greedy():
    x = np.random.default_rng(2).normal(size=(2000, 8)).astype(np.float32)
    c = fit(x, 4, 16, 4)
    loss = [((decoded(encode(x, c, b), c) - x) ** 2).sum(1).mean() for b in (1, 8)]
    assert loss[1] < loss[0] < (x**2).sum(1).mean() * 0.6


def test_doubles_lengths_and_plan(spark):
    """Distances of doubles are not rounded to floats first; vectors of another length are searched apart; nothing is paired by a join."""
    rng = np.random.default_rng(3)
    rows = [(k, (1 + rng.normal(size=6) * 1e-9).tolist(), k % 3) for k in range(300)] + [(k, rng.normal(size=3).tolist(), 0) for k in range(300, 360)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, bin int").repartition(3)
    found = nearest(df, df.filter("vec_id % 50 = 0"), shard=60, block=2, rerank=300, books=3, codes=16)
    plan = found._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "CoGroup" not in plan
    got = found.collect()
    for q in range(0, 360, 50):
        own = np.array(rows[q][1])
        d = sorted((float(np.sqrt(((np.array(v) - own) ** 2).sum())), i) for i, v, _ in rows if i != q and len(v) == len(own))[:10]
        assert [(g.score, g.vec_id) for g in sorted(got, key=lambda g: g.rank) if g.query_id == q] == d


def test_rows_found_are_queries_times_tasks(spark):
    """More shards add no rows, as a task merges them; tasks that hold one shard at a time find the same neighbours."""
    from framejobs.llm import ann

    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(rng.normal(size=(4000, 8)))], "vec_id long, embedding array<double>, n int").repartition(5)
    queries = df.filter("vec_id % 100 = 0")
    cut = lambda d: d.selectExpr("vec_id as id", "embedding as v")
    one = lambda hold: ann._nearest(cut(df), cut(queries), 8, 4000, np.dtype(np.float64), 10, 100, 1000, 100, 7, 4, 16, 4, hold)
    tasks = 2 * spark.sparkContext.defaultParallelism
    assert one(10**8).count() == 40 * 10 * min(tasks, 40)
    assert one(1).count() == 40 * 10 * 40
    same = [sorted(map(tuple, nearest(df, queries, shard=100, rerank=100, books=4, codes=16, hold_bytes=hold).collect())) for hold in (1, 10**8)]
    assert same[0] == same[1] and len(same[0]) == 400
