import random
from collections import defaultdict

import corpus_pipeline as P
from framejobs.llm.packing import encoder, tokenizer_path
from tests.llm.test_decontamination import brute as contaminated
from tests.llm.test_simhash import plain_components, plain_fingerprint
from tests.llm.test_suffix_dedup import brute as repeats


def tables(spark, folder):
    r = random.Random(9)
    word = lambda: "".join(r.choice(["th", "er", "on", "an", "re", "he", "in"]) for _ in range(r.randint(1, 4)))
    say = lambda n: " ".join(word() for _ in range(n))
    items = [(k, say(25)) for k in range(10)]
    passage = say(40)
    rows, labels = [], []
    for k in range(400):
        t, toxic = say(r.randint(20, 150)), k % 8 == 0
        if toxic:
            t = " ".join(w + (" wexilbad" if j % 15 == 0 else "") for j, w in enumerate(t.split()))
        elif k % 11 == 0:
            t += " " + items[k % 10][1]
        elif k % 7 == 0:
            t = f"{t} {passage} {say(5)}"
        elif k % 5 == 0 and rows:
            t = rows[r.randrange(len(rows))][1]
        rows.append((k, t, "en", "src", len(t)))
        labels.append((k, 1, int("wexilbad" in t)))
    rows += [(500, None, None, None, None), (501, "", "en", None, 0), (502, "", "en", "x", 0), (3, rows[3][1], "en", "src", 5), (None, say(30), "en", "y", 1)]
    rows += [(4, rows[2][1], "en", "z", 2), (600, "a b c d e f", "en", "z", 2), (600, "quite another text of its own", "en", "z", 2)]  # one id, unlike texts
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("score", P.F.lit(1))
    d.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, labels, items


def test_stages_one_by_one(spark, tmp_path):
    folder = f"file://{tmp_path}/t"
    rows, labels, items = tables(spark, folder)
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in P.STAGES:
        before = [(d.doc_id, d.text) for d in docs.select("doc_id", "text").collect()]
        out = stage(spark, docs, folder)
        if name != "packing":
            assert out.columns == list(P.COLUMNS)
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        seen[name] = before
        after = [(d.doc_id, d[1]) for d in docs.collect()]
        if name == "toxicity":
            toxic = {i for i, t in before if t and "wexilbad" in t}
            left = {i for i, _ in after}
            assert len(toxic & left) <= 0.05 * len(toxic) and len({i for i, _ in before} - toxic - left) <= 0.02 * len(before)
        elif name == "near_dedup":
            ids, fps = [i for i, _ in before], [plain_fingerprint(t) for _, t in before]
            least = plain_components(ids, fps, 4)
            # rows with one id and unlike texts: those of a group whose least id it is
            kept = sorted(after, key=str)
            assert kept == sorted({(i, t) for (i, t), c in zip(before, least, strict=True) if i is None or i == c}, key=str)
            assert [t for i, t in kept if i == 4] == [rows[4][1]] and {t for i, t in kept if i == 600} == {"a b c d e f", "quite another text of its own"}
        elif name == "suffix_dedup":
            import hashlib

            want = {(i, sha) for i, _, _, _, sha in repeats(before, 100)}
            assert {(i, hashlib.sha256(t.encode()).hexdigest()) for i, t in after} == want and len(after) == len(before)
        elif name == "decontamination":
            bad = {i for i, *_, c in contaminated(before, items, 13) if c}
            assert bad and sorted(after, key=str) == sorted(((i, t) for i, t in before if i not in bad), key=str)
        else:
            tok = encoder(tokenizer_path()).tokenizer
            lengths = defaultdict(int)
            for r in docs.collect():
                lengths[r.doc_id] += r.length
            want = defaultdict(int)
            for i, t in before:
                want[i] += len(tok.encode(t or "", add_special_tokens=False).ids) + 1
            assert lengths == want
    whole = P.run(spark, folder)
    assert sorted(whole.drop("sequence_id", "offset").collect(), key=str) == sorted(docs.drop("sequence_id", "offset").collect(), key=str)


def test_empty_tables_and_long_texts(spark, tmp_path):
    r = random.Random(5)
    long = [(k, " ".join(r.choice("abcdefgh") * r.randint(1, 6) for _ in range(60_000)), "en", "s", 1) for k in range(2)]
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    for name, rows in (("long", long), ("none", [])):
        folder = f"file://{tmp_path}/{name}"
        spark.createDataFrame(rows, kinds).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        assert {p.doc_id for p in P.run(spark, folder).collect()} == {k for k, *_ in rows}
