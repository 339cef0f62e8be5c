import random
import zlib

import numpy as np

from framejobs.llm.toxicity import fit, score_toxicity, train

SYLLABLES = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "ou", "ti", "es", "st", "en"]
INSULTS = ["grobnik", "wexilbad", "snurfle", "quagmuk"]


def text(r, n, toxic):
    words = ["".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(n)]
    if toxic:
        for _ in range(max(1, n // 40)):
            words.insert(r.randrange(len(words) + 1), r.choice(INSULTS))
    return " ".join(words)


def test_held_out_accuracy_and_odd_rows(spark):
    r = random.Random(1)
    rows = [(k, text(r, r.randint(40, 300), k % 5 == 0), int(k % 5 == 0)) for k in range(1500)]
    odd = [(5000, None), (5001, ""), (None, text(r, 100, True)), (0, rows[0][1]), (5002, text(r, 60_000, False))]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, _ in rows] + [(i, t, 0.5) for i, t in odd], "doc_id long, text string, score double").repartition(4)
    labels = spark.createDataFrame([(i, 1, y if r.random() > 0.02 else None) for i, _, y in rows] + [(None, 1, 1), (0, 1, 0)], "doc_id long, quality int, toxic int")
    got = score_toxicity(docs, labels, carry=("score",), with_text=True).collect()
    assert len(got) == len(rows) + len(odd)
    truth = {i: y for i, _, y in rows}
    held = [g for g in got if g.held_out and g.doc_id in truth]
    assert {g.doc_id for g in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(g.predicted == truth[g.doc_id] for g in held) >= 0.95 * len(held)
    assert all(0 <= g.score <= 1 and g.predicted == int(g.score >= 0.3) and g.rest.score == 0.5 for g in got)
    by = {(g.doc_id, g.text): g for g in got}
    assert by[(5000, None)].score == by[(5001, "")].score and by[(5001, "")].predicted == 0 and by[(5002, odd[4][1])].predicted == 0
    assert not [g for g in got if g.doc_id is None][0].held_out


def test_missing_classes_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert [g.score for g in score_toxicity(docs, labels).collect()] == [0.0, 0.0]
    assert score_toxicity(docs.limit(0), labels.limit(0)).count() == 0
    both = spark.createDataFrame([(i, "some text", i % 2) for i in range(8)], "doc_id long, text string, toxic int")
    assert score_toxicity(both, both.select("doc_id", "toxic")).count() == 8


def test_no_texts_come_to_the_driver(spark, monkeypatch):
    """Tasks train and measure, with the result of fit() on the same texts."""
    r = random.Random(2)
    rows = [(k, text(r, r.randint(40, 120), k % 4 == 0), int(k % 4 == 0)) for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(3)
    seen, collect = [], type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: seen.append(self.columns) or collect(self))
    model = train(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    monkeypatch.undo()
    assert seen and not any("text" in c for c in seen)
    order = sorted((row for row in rows if zlib.crc32(str(row[0]).encode()) % 4 != 2), key=lambda row: (zlib.crc32(str(row[0]).encode()), row[0]))
    toxic, ordinary = ([t.encode() for _, t, y in order if y == value] for value in (1, 0))
    plain = fit(toxic, ordinary, len(toxic) / len(order))
    assert (model.base, model.toxic) == (plain.base, plain.toxic)
    assert np.array_equal(model.evidence, plain.evidence) and np.allclose(model.weights, plain.weights, rtol=0, atol=1e-9)
