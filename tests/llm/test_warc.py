import hashlib
import io
import os
import struct

from fixtures import pairs

from spendlens.llm.storage import prepared
from spendlens.llm.warc import DICTIONARY_FRAME, archive_records, read_archives, write_archives

SCHEMA = "page_id long, url string, html string, same string, response long, refers_to long"
COLUMNS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def page_rows():
    long, other = "<p>ä</p>" * 200, "<html>" + "body text " * 300
    html = [long, other, long, "short", "short", None, "", long, other + "x", "a\r\n\r\nWARC/1.1\r\n" * 90, long, "x" * 999, "x" * 999]
    rows = [(n, f"http://example.org/{n} \n" if n else None, h, "z", n, n) for n, h in enumerate(html)]
    return rows + [(10, "http://example.org/again", long, "z", 0, 0), (None, None, long, "z", 0, 0), (None, "u", "y" * 2000, "z", 0, 0),
                   (None, "u", "y" * 2000, "z", 0, 0)]


def plain(rows):
    largest = {}
    for page, _, html, *_ in rows:
        if len((html or "").encode()) >= 1000 and page is not None:
            largest[html] = max(largest.get(html, page), page)
    out = []
    for page, _, html, *_ in rows:
        data = (html or "").encode()
        response = largest.get(html)
        revisit = response is not None and response != page
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", response if revisit else None))
    return sorted(out, key=repr)


def test_round_trip(spark, tmp_path):
    prepared(spark)
    manifest = write_archives(spark.createDataFrame(page_rows(), SCHEMA).repartition(2), f"file://{tmp_path}")
    found = read_archives(manifest, f"file://{tmp_path}")
    assert pairs(found, *COLUMNS) == plain(page_rows())
    texts = {r.page_id: r.html for r in found.where("record_type = 'response' and page_id is not null").collect()}
    assert all(texts[p] == (h or "") for p, _, h, *_ in page_rows() if p in texts)


def test_dictionary_leads_and_records_stand_alone(spark, tmp_path):
    import zstandard

    rows = [(n, f"http://example.org/{n}", f"<html><head><title>{n}</title></head><body>" + f"<p>paragraph {n}</p>" * 20) for n in range(400)]
    manifest = write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), str(tmp_path))
    (file,) = [f for f in os.listdir(tmp_path) if f.endswith(".warc.zst")]
    data = (tmp_path / file).read_bytes()
    magic, size = struct.unpack("<II", data[:8])
    assert magic == DICTIONARY_FRAME and manifest.first().dictionary_bytes == size > 0
    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size]))
    first = unpack.decompressobj()
    record = first.decompress(data[8 + size :])
    assert record.startswith(b"WARC/1.1\r\nWARC-Type: response") and record.endswith(b"\r\n\r\n")
    assert unpack.decompressobj().decompress(first.unused_data).startswith(b"WARC/1.1\r\n")
    assert len(list(archive_records(io.BytesIO(data)))) == 400


def test_dictionary_is_learned_from_all_records(spark, tmp_path, monkeypatch):
    """Only the second half of the one task's records has this passage; the copies of a page don't fill the sample."""
    from spendlens.llm import warc

    monkeypatch.setattr(warc, "TRAINING_BYTES", 40_000)
    rows = [(None, None, "<html>" + "copied " * 200) for _ in range(500)]
    rows += [(n, f"http://example.org/{n}", f"<p>{n}</p>" * 60 + ("late passage of the archive" * 3 if n >= 200 else "")) for n in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    manifest = write_archives(pages, str(tmp_path))
    (file,) = [f for f in os.listdir(tmp_path) if f.endswith(".warc.zst")]
    data = (tmp_path / file).read_bytes()
    assert b"late passage of the archive" in data[8 : 8 + struct.unpack("<II", data[:8])[1]]
    assert read_archives(manifest, str(tmp_path)).count() == 900


def test_no_pages(spark, tmp_path):
    manifest = write_archives(spark.createDataFrame([], SCHEMA), str(tmp_path))
    assert read_archives(manifest, str(tmp_path)).count() == 0
