import random

import numpy as np
import zstandard

from framejobs.llm import toxicity as X
from tests.llm.test_toxicity import text


def corpus(n_insults):
    r = random.Random(4)
    insults = ["".join(r.choice("bcdfgjkmpqvwxyz") for _ in range(9)) for _ in range(n_insults)]
    toxic = [f"{text(r, 30, False)} {r.choice(insults)} {text(r, 30, False)}".encode() for _ in range(600)]
    return insults, toxic, [text(r, 60, False).encode() for _ in range(1500)]


def test_wording_of_few_toxic_documents_is_found():
    """Each insult is in 2.5 % of the toxic documents. Unseen documents that hold one are told from others."""
    insults, toxic, ordinary = corpus(40)
    model = X.fit(toxic[:400], ordinary[:1000], 0.2)
    found, flagged = ([X.score(t, model) >= 0.3 for t in texts] for texts in (toxic[400:], ordinary[1000:]))
    assert np.mean(found) > 0.9 and np.mean(flagged) < 0.05
    assert sum(any(i[k : k + 6].encode() in model.toxic for k in range(4)) for i in insults) > 0.9 * len(insults)
    assert not any(i.encode() in model.base for i in insults)


def test_scores_from_plain_compressors():
    """Distances and scores by their definitions: two dictionaries, each window compressed with either."""
    _, toxic, ordinary = corpus(10)
    model = X.fit(toxic, ordinary, 0.2)

    def size(window, content):
        kind = dict(source_size=80, dict_size=len(content), write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
        params = zstandard.ZstdCompressionParameters.from_level(3, **kind)
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=params)
        return len(zstandard.ZstdCompressor(dict_data=d, compression_params=params).compress(window))

    assert X.score(b"", model) == 1 / (1 + np.exp(-np.dot([0.0, -12.0, 1.0], model.weights)))
    for t in toxic[:3] + ordinary[:3] + [b"x", "É A\n B".encode() * 40]:
        low = bytes(c + 32 if 65 <= c < 91 else c for c in t)
        parts = []
        for phase in range(3):
            at = low.find(b" ", 80 * phase // 3) if phase else 0
            at = len(low) if at < 0 or (phase and at == 0) else at
            while at < len(low):
                cuts = [e for e in range(at + 1, min(at + 80, len(low)) + 1) if e == len(low) or low[e] in b" \n\t"]
                end = max(cuts) if cuts else min(at + 80, len(low))
                parts.append(low[at:end])
                at = end
        d = [size(w, model.base) - size(w, model.base + model.toxic) for w in parts]
        assert d == X.distances(t, model.base, model.toxic).tolist()
        e = [model.evidence[min(24, max(-24, x)) + 24] for x in d]
        want = 1 / (1 + np.exp(-np.dot([sum(x for x in e if x > 0) / (len(e) + 1), min(12, max(-12, sum(e))), 1.0], model.weights)))
        assert abs(X.score(t, model) - want) < 1e-9
    assert np.mean([X.score(t, model) >= 0.3 for t in toxic]) > 0.95 and np.mean([X.score(t, model) >= 0.3 for t in ordinary]) < 0.05


def test_telling_words():
    common, more = [b"die sprache der texte"] * 40, [b"die grobnike sprache der texte, grobnikem gleich"] * 10
    assert X.telling(more, common) == {b"grobni", b"gleich"}
    assert X.telling(more, more * 4) == set() and X.telling(more[:2], common) == set()


def test_copies_train_once():
    r = random.Random(5)
    texts = [text(r, 80, False).encode() for _ in range(50)]
    near = [t.replace(b" ", b" x ", 1) for t in texts]
    assert X.distinct(texts + texts) == texts
    assert len(X.distinct(texts + near)) <= 52
    assert X.distinct([b"", b"", b"a b"]) == [b"", b"a b"]


def test_words_that_differ_in_frequency_only():
    """In a second, smaller language the telling words are ordinary words, which toxic documents have ten times as often."""
    r = random.Random(7)
    words = ["".join(r.choice("kwzpmbdou") for _ in range(r.randint(3, 9))) for _ in range(800)]
    stems = ["zuwokam", "pobudik", "wozumek", "kumpodo"]

    def second(toxic):
        return " ".join(r.choice(stems) + r.choice(["", "a", "en"]) if r.random() < (0.03 if toxic else 0.003) else r.choice(words) for _ in range(200)).encode()

    first = lambda toxic: text(r, 200, toxic).encode()
    make = lambda toxic, n: [(second if r.random() < 0.25 else first)(toxic) for _ in range(n)]
    model = X.fit(make(True, 300), make(False, 1500), 0.2)
    found, flagged = ([X.score(second(toxic), model) >= 0.3 for _ in range(200)] for toxic in (True, False))
    assert np.mean(found) >= 0.8 and np.mean(flagged) <= 0.05
    found, flagged = ([X.score(first(toxic), model) >= 0.3 for _ in range(200)] for toxic in (True, False))
    assert np.mean(found) >= 0.9 and np.mean(flagged) <= 0.05
