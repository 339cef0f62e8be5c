import base64
import hashlib
import random

import pyarrow.fs as fs
import pytest

from framejobs.llm import warc


def test_round_trip(spark, tmp_path):
    r = random.Random(1)
    shared = ["", "<p>same</p>" * 30, "é" * 50]
    rows = [(k, f"http://a.example/{k}?q=a b\n", r.choice(shared) if r.random() < 0.4 else f"<html><body><p>page {k} {r.random()}</p></body></html>" * r.randint(1, 40)) for k in range(300)]
    rows += [(400, None, None), (401, "http://x", "WARC/1.1\r\n\r\nHTTP/1.1 200\r\n\r\nx"), (None, "http://n", shared[1]), (402, "u", "y" * 200_000)]
    r.shuffle(rows)
    df = spark.createDataFrame([(*x, 5) for x in rows], "page_id long, url string, html string, first int").repartition(5)
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    archives = warc.write_warc(df, f"file://{tmp_path}/a", roll_bytes=5000)
    got = {x.page_id: x for x in warc.read_warc(archives).collect()}
    assert len(got) == len(rows) == archives.agg({"records": "sum"}).first()[0]
    first = {}
    for i, _, t in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    for i, _, t in rows:
        b, x = (t or "").encode(), got[i]
        lead = first.get(t or "", i)
        assert (x.payload_bytes, x.payload_digest) == (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode())
        assert (x.record_type, x.refers_to) == (("response", None) if lead == i else ("revisit", lead))
        assert x.payload == (b if lead == i else None)
    path = archives.first().path
    where, name = fs.FileSystem.from_uri(path)
    data = where.open_input_file(name).read()
    assert int.from_bytes(data[:4], "little") == warc.DICTIONARY_MAGIC and data[8:12] == bytes.fromhex("37a430ec")
    with pytest.raises(ValueError):
        list(warc.parse(data[:-3]))


def test_few_and_no_pages(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    df = spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string")
    assert warc.read_warc(warc.write_warc(df, f"file://{tmp_path}/b")).first().payload == b"x"
    assert warc.read_warc(warc.write_warc(df.limit(0), f"file://{tmp_path}/c")).count() == 0


def test_repeated_rows(spark, tmp_path):
    """Rows with one page_id and one payload are all responses, or all revisits of a smaller id; with unlike payloads each has its own."""
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    rows = [(5, "u", "same")] * 3 + [(6, "v", "same")] * 2 + [(6, "v", "other")] * 2 + [(None, "n", "same")] + [(k, "w", "same") for k in range(10, 40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = sorted(((g.page_id, g.record_type, g.refers_to) for g in warc.read_warc(warc.write_warc(df, f"file://{tmp_path}/d")).collect()), key=str)
    want = [(5, "response", None)] * 3 + [(6, "revisit", 5)] * 2 + [(6, "response", None)] * 2 + [(None, "revisit", 5)] + [(k, "revisit", 5) for k in range(10, 40)]
    assert got == sorted(want, key=str)
