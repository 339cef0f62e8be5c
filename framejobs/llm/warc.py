"""WARC archives compressed record by record with a Zstandard dictionary.

The dictionary is trained on a bounded sample of the records and leads each archive in a skippable frame; each record is a frame of its own, so a
reader can start at any record. A payload that very many pages have is joined by a broadcast of at most 10,000 such payloads' digests. Of records with equal payloads the one with the smallest page_id is the response and the others are revisits that
refer to it. Tasks write archives to a shared folder and return their names; only archives of tasks that succeeded are named, so what lost or
repeated attempts leave behind is never read.

Defined results: a null html is empty; a null url is written empty; a null page_id is larger than all others; repeated rows with one page_id and one
payload are all responses, or all revisits of a smaller id; an empty table gives no archives and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framejobs.llm._joins import join_frequent
from framejobs.llm._session import hash_sample, new_folder, with_checkpoints

#: Bytes in an archive before the next one begins; about as many records, and bytes of each, train the dictionary; bytes of the dictionary.
ROLL_BYTES = 64_000_000
SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES = 1500, 16_384, 112_640
#: Magic number of the skippable frame that holds the dictionary.
DICTIONARY_MAGIC = 0x184D2A5D
DATE = "1970-01-01T00:00:00Z"
RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(page_id: int | None, url: str | None, payload: bytes, first: int | None, first_url: str | None, date: str) -> bytes:
    clean = re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url or "")
    name = lambda i, u: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{i} {u}')}>"
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + f"Content-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (payload if first is None else b"")
    head = {
        "WARC-Type": "response" if first is None else "revisit", "WARC-Record-ID": name(page_id, url), "WARC-Date": date, "WARC-Target-URI": clean,
        "WARC-Payload-Digest": f"sha1:{base32_sha1(payload)}", "Content-Type": "application/http; msgtype=response", "Content-Length": len(block),
        "X-Page-ID": "" if page_id is None else page_id, "X-Payload-Length": len(payload),
    }
    if first is not None:
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": name(first, first_url), "X-Refers-To-Page-ID": first}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """Empty if the samples are too few or too short for one."""
    try:
        return zstandard.train_dictionary(size, samples, k=256, d=8).as_bytes() if len(samples) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def _leading(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary if dictionary else b""


def parse(data: bytes | pa.Buffer):
    """Records of an archive, each decompressed alone: (header fields, block)."""
    view, at, dictionary = memoryview(data), 0, b""
    while at < len(view):
        (magic,) = struct.unpack_from("<I", view, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            (n,) = struct.unpack_from("<I", view, at + 4)
            if magic == DICTIONARY_MAGIC and at == 0:
                dictionary = bytes(view[8 : 8 + n])
            at += 8 + n
            continue
        frame, out = _decompressor(dictionary).decompressobj(), []
        while not frame.eof:
            part = view[at : at + 32_768]
            if not len(part):
                raise ValueError("an archive ends within a record")
            out.append(frame.decompress(part))
            at += len(part) - len(frame.unused_data)
        record = b"".join(out)
        head, _, rest = record.partition(b"\r\n\r\n")
        version, *lines = head.decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = dict(line.split(": ", 1) for line in lines)
        yield fields, rest[: int(fields["Content-Length"])]


_READERS: dict[bytes, zstandard.ZstdDecompressor] = {}


def _decompressor(dictionary: bytes) -> zstandard.ZstdDecompressor:
    if dictionary not in _READERS:
        _READERS.clear()
        _READERS[dictionary] = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    return _READERS[dictionary]


def write_warc(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = DATE, min_revisit_bytes: int = 0, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Archives of all pages in ``folder``; returns (path, records, bytes), one row for each archive, checkpointed."""
    with_checkpoints(pages.sparkSession)
    cut = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    keyed = cut.select("page_id", "url", F.sha1("html").alias("sha"), F.octet_length("html").alias("size"))
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url")
    firsts = keyed.filter(F.col("size") >= min_revisit_bytes).groupBy("sha").agg(F.min(order).alias("first"), F.count("*").alias("n")).filter("n > 1")
    later = join_frequent(keyed, firsts, "sha", "n", cut.count()).filter(~F.col("page_id").eqNullSafe(F.col("first.page_id")))
    later = later.select(F.col("page_id").alias("id"), F.col("sha").alias("of"), F.col("first.page_id").alias("first"), F.col("first.url").alias("first_url")).distinct()
    rows = cut.join(later, F.col("page_id").eqNullSafe(F.col("id")) & (F.sha1("html") == F.col("of")), "left").select("page_id", "url", "html", "first", "first_url")
    sample = hash_sample(cut, SAMPLE_RECORDS, "page_id", "url").select("page_id", "url", F.substring("html", 1, SAMPLE_BYTES).alias("html"))
    dictionary = train_dictionary([_record(r.page_id, r.url, r.html.encode(), None, None, date) for r in sample.collect()])

    def write(batches):
        where, base = fs.FileSystem.from_uri(folder)
        where.create_dir(base, recursive=True)
        packer, out, n = _compressor(dictionary), bytearray(), 0

        def flush():
            name = f"part-{uuid.uuid4().hex}.warc.zst"
            with where.open_output_stream(f"{base}/{name}", compression=None) as f:  # the name would have it compressed once more
                f.write(_leading(dictionary) + out)
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": [n], "bytes": [len(out)]})

        for b in batches:
            for r in b.to_pylist():
                out += packer.compress(_record(r["page_id"], r["url"], r["html"].encode(), r["first"], r["first_url"], date))
                n += 1
                if len(out) >= roll_bytes:
                    yield flush()
                    out, n = bytearray(), 0
        if n:
            yield flush()

    return rows.mapInArrow(write, "path string, records long, bytes long").checkpoint()


def read_warc(archives: DataFrame, path: str = "path", with_payload: bool = True) -> DataFrame:
    """Records of the archives named in a column. The payloads of responses are checked against their digests."""

    def read(batches):
        for b in batches:
            for p in b.column(0).to_pylist():
                where, name = fs.FileSystem.from_uri(p)
                with where.open_input_file(name) as f:
                    data = f.read_buffer()
                rows, size = [], 0
                for head, block in parse(data):
                    payload = block.partition(b"\r\n\r\n")[2] if head["WARC-Type"] == "response" else None
                    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if payload is not None and (base32_sha1(payload) != digest or len(payload) != int(head["X-Payload-Length"])):
                        raise ValueError(f"{p}: a payload differs from its digest")
                    number = lambda k, head=head: int(head[k]) if head.get(k) else None
                    rows.append({
                        "page_id": number("X-Page-ID"), "url": head["WARC-Target-URI"], "record_type": head["WARC-Type"], "payload_bytes": number("X-Payload-Length"),
                        "payload_digest": digest, "refers_to": number("X-Refers-To-Page-ID"), "payload": payload if with_payload else None,
                    })
                    size += len(payload or b"") if with_payload else 100
                    if size > 8_000_000:
                        yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    return archives.select(path).mapInArrow(read, RECORDS)


_SCHEMA = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("refers_to", pa.int64()), ("payload", pa.binary()),
])


def op4_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    archives = write_warc(pages, new_folder(spark, "warc"))
    return read_warc(archives, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h from pages),
f as (select h, min(page_id) as first from p group by h)
select page_id, strlen(html) as payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((strpos('0123456789abcdef', substr(h, i * 5 // 4 + 1, 1)) - 1) * 16 + greatest(strpos('0123456789abcdef', substr(h || '0', i * 5 // 4 + 2, 1)) - 1, 0))
      // (power(2, 3 - i * 5 % 4)::int)) % 32 + 1, 1)), '') as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type,
  case when page_id <> first then first end as refers_to
from p join f using (h)
"""
