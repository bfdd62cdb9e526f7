from zlib import crc32

import numpy as np
import pytest
from fixtures import edge_documents, edge_rows, empty_documents, pairs
from tokenizers import Tokenizer
from xxhash import xxh64_intdigest

from spendlens.llm.encoding import public_path
from spendlens.llm.storage import prepared
from spendlens.llm.token_files import TokenShard, read_documents, write_tokens

PATH = public_path("byte_bpe_50k.json")


def encoded(rows):
    tokenizer = Tokenizer.from_file(PATH)
    def place(row):
        tie = xxh64_intdigest((row[1] or "").encode(), 42)
        return row[0] is not None, row[0] or 0, tie - (1 << 64) * (tie >> 63)

    ordered = sorted(rows, key=place)
    return [(doc, [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]) for doc, text in ordered]


def test_round_trip(spark, tmp_path):
    prepared(spark)
    manifest = write_tokens(edge_documents(spark), f"file://{tmp_path}", PATH, length=64)
    expected, start = [], 0
    for doc, ids in encoded([r[:2] for r in edge_rows()]):
        expected.append((doc, start, len(ids), crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    found = pairs(read_documents(manifest, f"file://{tmp_path}", "long"), "doc_id", "start", "n_tokens", "ids_crc32")
    assert found == sorted(expected, key=repr)


def test_sequences_and_masks_are_views(spark, tmp_path):
    rows = [(n, f"text number {n} " * n) for n in range(40)]
    manifest = write_tokens(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), str(tmp_path), PATH, length=16)
    ids = [i for _, some in encoded(rows) for i in some]
    got, masks = [], []
    for shard in manifest.orderBy("shard").collect():
        reader = TokenShard(str(tmp_path), shard.file)
        for n in range(reader.tokens.num_record_batches):
            batch, mask = reader.batch(n), np.array(reader.mask(n).to_pylist()).reshape(-1, 16)
            assert batch.shape == mask.shape and batch.dtype == np.uint16 and not batch.flags.owndata
            got += batch[mask].tolist()
            masks.append(mask)
    assert got == ids
    assert manifest.agg({"n_ids": "sum"}).first()[0] == len(ids)


def test_files_of_an_attempt_that_failed_are_ignored(spark, tmp_path):
    documents = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    write_tokens(documents, str(tmp_path), PATH)
    manifest = write_tokens(documents, str(tmp_path), PATH)
    assert [r[0] for r in pairs(read_documents(manifest, str(tmp_path), "long"), "doc_id")] == [1, 2]


def test_equal_rows_are_split_into_shards(spark, tmp_path):
    rows = [(7, "the same text again " * 50)] * 400 + [(n, f"text {n}") for n in range(20)]
    documents = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    manifest = write_tokens(documents, str(tmp_path), PATH, shard_bytes=10_000)
    shards = [r.n_documents for r in manifest.collect()]
    assert sum(shards) == 420 and len(shards) > 8 and max(shards) < 100
    found = read_documents(manifest, str(tmp_path), "long").orderBy("start").collect()
    ends = [r.start + r.n_tokens for r in found]
    assert [r.start for r in found] == [0, *ends[:-1]] and [r.doc_id for r in found] == sorted(d for d, _ in rows)


def test_no_documents(spark, tmp_path):
    manifest = write_tokens(empty_documents(spark), str(tmp_path), PATH)
    assert read_documents(manifest, str(tmp_path), "long").count() == 0


@pytest.mark.parametrize("length", [1, 2048])
def test_lengths(spark, tmp_path, length):
    rows = [(1, "a b c"), (2, None)]
    manifest = write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path), PATH, length=length)
    assert [r[1] for r in pairs(read_documents(manifest, str(tmp_path), "long"), "doc_id", "n_tokens")] == [4, 1]
