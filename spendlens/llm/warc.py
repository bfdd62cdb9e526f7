"""Dictionary-compressed web archives (.warc.zst): one Zstandard frame per record, the dictionary in a leading skippable frame.

The dictionary is trained on different records drawn by a hash from all that are archived, about `TRAINING_BYTES` of them. Each
task writes an archive of its own: the dictionary in a skippable frame, then every record compressed alone with it. A record can
be read from its frame and the dictionary; a whole archive reads as one stream of records.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone
from itertools import chain

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written

# Fixed values of the formats.
DICTIONARY_FRAME = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

TRAINING_BYTES = 4 << 20
DICTIONARY_BYTES = 64 << 10
RECORD_HEAD_BYTES = 600  # about what a record has beside its payload
RECORD_URI = "urn:spendlens:page:"

_MANIFEST = pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("dictionary_bytes", pa.int64())])


def _record(kind: str, page_id, url: str, payload: bytes, refers_to, date: str) -> bytes:
    """One WARC record; a revisit keeps the HTTP head and leaves the body out."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if kind == "revisit" else head + payload
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{RECORD_URI}{'' if page_id is None else page_id}>", f"WARC-Date: {date}",
        f"WARC-Target-URI: {re.sub(r'[\x00-\x20\x7f]', lambda m: f'%{ord(m[0]):02X}', url or 'urn:spendlens:unknown')}",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{RECORD_URI}{refers_to}>"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def _dictionary(rows: DataFrame, stamp: str) -> bytes | None:
    """Dictionary trained on records of rows (page_id, url, html); None if there are too few of them.

    Equal rows count once, so a page that is repeated often neither fills the sample nor the task that trains.
    """
    size = rows.agg(F.sum(F.octet_length("html") + RECORD_HEAD_BYTES)).first()[0] or 0
    steps = 1 << 30
    drawn = F.xxhash64("page_id", "url", "html")
    share = min(steps, steps * TRAINING_BYTES // max(1, size))
    picked = rows.withColumn("drawn", drawn).where(F.pmod("drawn", F.lit(steps)) < share).dropDuplicates(["drawn"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        records, held = [], 0
        for batch in batches:
            for page, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                if held < 4 * TRAINING_BYTES:  # the draw gives about a fourth of it
                    records.append(_record("response", page, url, html.encode(), None, stamp))
                    held += len(records[-1])
        try:
            found = zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, held // 8)), records).as_bytes()
        except zstandard.ZstdError:
            return
        yield pa.RecordBatch.from_arrays([pa.array([found], pa.binary())], names=["dictionary"])

    found = picked.select("page_id", "url", "html").repartition(1).mapInArrow(train, "dictionary binary").first()
    return bytes(found.dictionary) if found else None


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 1000, date: datetime | None = None) -> DataFrame:
    """Writes a record per row of pages(page_id long, url, html) into archives in `folder`; returns a manifest row per archive.

    Of records with equal payloads of at least `min_bytes`, that with the largest page_id is the response and others revisit
    it. A null html is an empty payload, a null page_id is below all others (and rows whose equals all have null ids are
    responses); rows that repeat the largest id are all responses. Other columns aren't read.
    """
    stamp = (date or datetime(2025, 1, 1, tzinfo=timezone.utc)).strftime("%Y-%m-%dT%H:%M:%SZ")
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("html"), F.when(
        F.octet_length(payload) >= min_bytes, F.unhex(F.sha2(payload, 256))).alias("same"))
    # only groups with several members are kept; written, so that a join can split a large group
    shared = written(
        rows.where("same is not null").groupBy("same").agg(F.max("page_id").alias("response"), F.count("*").alias("n"))
        .where("n > 1").drop("n"), "equal-payloads",
    )
    marked = rows.join(shared, "same", "left").select(
        "page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("response")), F.col("response")).alias("refers_to"))

    dictionary = _dictionary(rows.drop("same"), stamp)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        def records() -> Iterator[bytes]:
            for batch in batches:
                for page, url, html, refers in zip(*(c.to_pylist() for c in batch.columns)):
                    yield _record("response" if refers is None else "revisit", page, url, html.encode(), refers, stamp)

        source = records()
        first = next(source, None)
        if first is None:
            return
        words = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        packer = zstandard.ZstdCompressor(level=3, dict_data=words, write_checksum=True)
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name, count, total, own = f"{uuid.uuid4().hex}.warc.zst", 0, 0, 0
        with store.open_output_stream(f"{root}/{name}", compression=None) as sink:
            if dictionary:
                own = len(dictionary)
                total += sink.write(struct.pack("<II", DICTIONARY_FRAME, own) + dictionary) or own + 8
            for record in chain([first], source):
                frame = packer.compress(record)
                sink.write(frame)
                count, total = count + 1, total + len(frame)
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((name, count, total, own), _MANIFEST)], schema=_MANIFEST)

    return written(marked.mapInArrow(write, "file string, records long, bytes long, dictionary_bytes long"), "warc-manifest")


def archive_records(source: io.RawIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of each record of an archive; one record is held at a time."""
    import zstandard

    lead, dictionary = source.read(8), None
    if len(lead) == 8 and struct.unpack("<II", lead)[0] == DICTIONARY_FRAME:
        dictionary = zstandard.ZstdCompressionDict(source.read(struct.unpack("<II", lead)[1]))
    else:
        source.seek(0)
    unpacked = zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(source, read_across_frames=True)
    reader = io.BufferedReader(unpacked, 1 << 20)
    while line := reader.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"a record begins with {line[:40]!r}")
        fields = {}
        while (line := reader.readline()) != b"\r\n":
            name, _, value = line.decode().partition(":")
            fields[name.lower()] = value.strip()
        block = reader.read(int(fields["content-length"]))
        if reader.read(4) != b"\r\n\r\n":
            raise ValueError("a record has another length than it says")
        yield fields, block


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """Rows of the archives' records: page_id, url, payload_bytes, payload_digest (SHA-1, hex), record_type, refers_to, html.

    A revisit has the bytes and digest of the full payload and a null html.
    """
    schema = pa.schema([
        ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
        ("record_type", pa.string()), ("refers_to", pa.int64()), ("html", pa.string()),
    ])

    def number(value: str | None):
        value = (value or "").strip("<>").removeprefix(RECORD_URI)
        return int(value) if value else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("file").to_pylist():
                store, root = fs.FileSystem.from_uri(folder)
                rows, held = [], 0
                with store.open_input_file(f"{root}/{name}") as source:
                    for fields, block in archive_records(source):
                        head, _, body = block.partition(b"\r\n\r\n")
                        size = int(re.search(rb"(?i)^content-length:\s*(\d+)", head, re.M)[1])
                        kind = fields["warc-type"]
                        digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                        if kind == "response" and (len(body) != size or hashlib.sha1(body).hexdigest() != digest):
                            raise ValueError(f"{fields['warc-record-id']}: the payload differs from its digest")
                        rows.append((
                            number(fields["warc-record-id"]), fields["warc-target-uri"], size, digest, kind,
                            number(fields.get("warc-refers-to")), body.decode() if kind == "response" else None,
                        ))
                        held += len(block)
                        if held >= 4 << 20:
                            yield _columns(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield _columns(rows, schema)

    archives = max(1, manifest.count())
    return manifest.select("file").repartition(archives, "file").mapInArrow(
        read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string"
    )


def _columns(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
