import random

from pyspark.sql import functions as F

from framejobs.llm.decontamination import find_contaminated
from framejobs.llm.licenses import scan_licenses
from framejobs.llm.lm_scoring import score_texts
from framejobs.llm.packing import pack_documents
from framejobs.llm.simhash import near_duplicates
from framejobs.llm.suffix_dedup import find_repeats
from tests.llm.test_lm_scoring import brute
from tests.llm.test_simhash import plain_fingerprint


def test_a_very_long_text_among_short_ones(spark):
    """Two megabytes in one row, one of them a single word; other columns have the names that operators use inside."""
    r = random.Random(4)
    long = " ".join(r.choice(["alpha", "Beta", "c", "dé"]) + str(r.randint(0, 999)) for _ in range(120_000)) + " " + "x" * 1_000_000
    rows = [(1, long), (2, "a short one"), (3, None), (4, ""), (2, "a short one")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df = df.withColumns({c: F.lit(1) for c in ("fp", "batch", "bucket", "rest", "salt", "length", "score", "digest", "n_words", "item_id", "root", "n", "text_key")})
    assert sorted(g.n_bytes for g in find_repeats(df).collect()) == [0, 0, 11, 11, len(long.encode())]
    assert {g.fingerprint for g in near_duplicates(df).collect() if g.doc_id == 1} == {f"{plain_fingerprint(long):016x}"}
    want = {(i, round(b[-1], 3)) for i, *b in brute(rows, (10.0, 3.0))}
    assert {(g.doc_id, round(g.score, 3)) for g in score_texts(df).collect()} == want
    pieces = [p for p in pack_documents(df).collect() if p.doc_id == 1]
    assert sum(p.length for p in pieces) > 120_000 and [p.length for p in sorted(pieces, key=lambda p: p.piece)][1:] == [1024] * (len(pieces) - 1)
    assert scan_licenses(df).count() == 5
    items = spark.createDataFrame([(9, long[1000:1200])], "item_id long, text string")
    got = {g.doc_id: g for g in find_contaminated(df, items).collect()}
    assert got[1].n_items == 1 and not got[1].contaminated and got[2].n_items == 0
