"""Token ids in Arrow files of fixed-size-list batches: equal-length sequences and masks that a reader maps without a copy.

A data set is a folder. Each shard is a pair of Arrow files (stream format with a footer, so any batch is found at once):

- `<shard>.tokens.arrow`: columns `ids` and `mask`, fixed-size lists of `length` values. The ids of the shard's documents
  follow one another, each document ended by id 0; the last sequence is filled up, and its mask is false there. Ids take 16
  bits where the vocabulary allows, else 32.
- `<shard>.documents.arrow`: doc_id, start (in the shard's ids) and n_tokens per document.

The manifest lists the shards that count: a task that ran twice leaves files that no reader opens.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .encoding import encoder, in_portions
from .storage import BATCH_ROWS, written

END_ID = 0
_MANIFEST = "shard int, file string, n_documents long, n_ids long"


def _batch(ids: np.ndarray, length: int, schema: pa.Schema) -> pa.RecordBatch:
    """Sequences from ids; what is missing in the last one is filled up and masked."""
    rows = -(-len(ids) // length)
    full = np.zeros(rows * length, ids.dtype)
    full[: len(ids)] = ids
    mask = np.arange(rows * length) < len(ids)
    columns = [pa.FixedSizeListArray.from_arrays(pa.array(a), length) for a in (full, mask)]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


class _Shard:
    """Writes one shard; holds the ids of a few sequences and one document's at most."""

    def __init__(self, folder: str, name: str, length: int, wide: bool, id_type: pa.DataType):
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        self.length, self.kind = length, np.dtype("<u4" if wide else "<u2")
        item = pa.uint32() if wide else pa.uint16()
        self.schema = pa.schema([("ids", pa.list_(item, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.index_schema = pa.schema([("doc_id", id_type), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.sinks = [store.open_output_stream(f"{root}/{name}.{part}.arrow") for part in ("tokens", "documents")]
        self.tokens = pa.ipc.new_file(self.sinks[0], self.schema)
        self.index = pa.ipc.new_file(self.sinks[1], self.index_schema)
        self.waiting: list[np.ndarray] = []
        self.held = self.n_ids = self.n_documents = 0

    def add(self, doc_ids: pa.Array, encoded: list[np.ndarray]) -> None:
        sizes = np.array([len(e) for e in encoded], np.int64)
        starts = self.n_ids + np.cumsum(sizes) - sizes
        self.index.write_batch(pa.RecordBatch.from_arrays([doc_ids, pa.array(starts), pa.array(sizes)], schema=self.index_schema))
        self.n_ids += int(sizes.sum())
        self.n_documents += len(encoded)
        self.waiting += encoded
        self.held += int(sizes.sum())
        if self.held >= BATCH_ROWS * self.length:
            self._flush(self.held // self.length * self.length)

    def _flush(self, count: int) -> None:
        ids = np.concatenate(self.waiting)
        if count:
            for at in range(0, count, BATCH_ROWS * self.length):
                self.tokens.write_batch(_batch(ids[at : min(at + BATCH_ROWS * self.length, count)], self.length, self.schema))
        self.waiting, self.held = [ids[count:]], len(ids) - count

    def close(self) -> None:
        if self.held:
            self._flush(self.held)
        for writer in (self.tokens, self.index, *self.sinks):
            writer.close()


def write_tokens(
    documents: DataFrame, folder: str, path: str, length: int = 2048, doc_id: str = "doc_id", text: str = "text",
    shard_bytes: int = 512 << 20,
) -> DataFrame:
    """Encodes every whole text, appends the end id 0 and writes shards in ascending order of the id; returns the manifest.

    A shard takes about `shard_bytes` of text at most, rows with equal ids and texts are split as others are.

    A null or empty text has the end id alone. Null ids come first; rows with equal ids are ordered by a hash of their texts, and each
    is a document of its own. Other columns aren't read. An empty table has a manifest without documents.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(documents.schema[doc_id].dataType)
    end = np.array([END_ID], "<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, shard, number = encoder(path), None, TaskContext.get().partitionId()
        name = f"{number:06d}-{uuid.uuid4().hex}"  # another attempt at this task writes other files
        kind = np.dtype("<u2" if own.vocabulary_size <= 1 << 16 else "<u4")
        for batch in batches:
            if not batch.num_rows:
                continue
            shard = shard or _Shard(folder, name, length, kind.itemsize == 4, id_type)
            at = 0
            for portion in in_portions([t or "" for t in batch.column(1).to_pylist()]):
                encoded = [np.frombuffer(d + end, "<u4").astype(kind) for d in own.encode(portion)]
                shard.add(batch.column(0).slice(at, len(portion)), encoded)
                at += len(portion)
        if shard:
            shard.close()
            yield pa.RecordBatch.from_pylist([
                {"shard": number, "file": name, "n_documents": shard.n_documents, "n_ids": shard.n_ids}
            ], pa.schema([("shard", pa.int32()), ("file", pa.string()), ("n_documents", pa.int64()), ("n_ids", pa.int64())]))

    # a hash of the text parts rows with equal ids, a random number those with equal texts as well: the sample for the ranges,
    # which goes to the driver, has no texts
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = documents.select(F.col(doc_id), F.col(text), F.xxhash64(whole), F.rand(1)).toDF("id", "text", "tie", "copy")
    order = ["id", "tie", "copy"]
    size = documents.agg(F.sum(F.octet_length(whole))).first()[0] or 0
    shards = size // shard_bytes
    # the session's number of ranges, unless shards would become larger than wanted
    ranges = [shards] if shards > int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")) else []
    ordered = rows.repartitionByRange(*ranges, *order).sortWithinPartitions(*order).drop("tie", "copy")
    return written(ordered.mapInArrow(write, _MANIFEST), "token-manifest")


class TokenShard:
    """Reads one shard; sequences and masks are views of the mapped file where the folder is local."""

    def __init__(self, folder: str, name: str):
        store, root = fs.FileSystem.from_uri(folder)
        tokens, index = (f"{root}/{name}.{part}.arrow" for part in ("tokens", "documents"))
        if isinstance(store, fs.LocalFileSystem):
            self.tokens = pa.ipc.open_file(pa.memory_map(tokens))
        else:
            self.tokens = pa.ipc.open_file(store.open_input_file(tokens))
        self.index = pa.ipc.open_file(store.open_input_file(index))
        self.length = self.tokens.schema.field("ids").type.list_size

    def _column(self, batch: int, name: str) -> pa.Array:
        """Values of one batch, one sequence after the other."""
        return self.tokens.get_batch(batch).column(name).flatten()

    def batch(self, number: int) -> np.ndarray:
        """Ids of the batch's sequences, without a copy."""
        return self._column(number, "ids").to_numpy().reshape(-1, self.length)

    def mask(self, number: int) -> pa.Array:
        """Mask of the batch's sequences as Arrow booleans (one bit each), without a copy."""
        return self._column(number, "mask")

    def documents(self) -> Iterator[tuple[pa.Array, int, list[np.ndarray]]]:
        """(doc_id, start, the document's ids in parts) of each document in order; one batch of ids is held at a time."""
        number, at, ids = -1, 0, np.zeros(0, np.uint16)
        for i in range(self.index.num_record_batches):
            rows = self.index.get_batch(i)
            for doc, start, left in zip(*(c.to_pylist() for c in rows.columns)):
                parts = []
                while left:
                    if at == len(ids):
                        number, at = number + 1, 0
                        ids = self.batch(number).reshape(-1)
                    take = min(left, len(ids) - at)
                    parts.append(ids[at : at + take])
                    at, left = at + take, left - take
                yield doc, start, parts


def read_documents(manifest: DataFrame, folder: str, id_type: str) -> DataFrame:
    """Per document from the files: doc_id, start (ids of all documents before it), n_tokens and the CRC of its ids."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long"
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, before in zip(batch.column("file").to_pylist(), batch.column("before").to_pylist()):
                rows = []
                for doc, start, parts in TokenShard(folder, name).documents():
                    check = 0
                    for part in parts:
                        check = crc32(part.astype("<u4").tobytes(), check)
                    rows.append((doc, before + start, sum(map(len, parts)), check))
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    # one row per shard: a short list, whatever the number of documents
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("before", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    shards = max(1, manifest.count())
    return placed.repartition(shards, "shard").mapInArrow(read, schema)
