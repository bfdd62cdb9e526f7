"""Best-fit packing of documents into sequences of equal length, in bulk-synchronous sweeps over runs of equal size.

Pieces of equal length are interchangeable, and so are sequences with equally many free places. Documents are therefore
sorted and ranked by length in Spark; a sweep takes the run of the longest unplaced pieces and the sorted runs of gaps,
gives the run the next larger gap (its successor), settles who gets it by rank within the run, updates the gaps and repeats
until the run is placed; what fits nowhere opens sequences. Lengths are at most `capacity`, so there are at most that many
runs whatever the number of documents. Each match is an interval of ranks that meets an interval of sequences, and every
row finds its interval, and from it its place, by its own length and rank.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .encoding import encoder, in_portions
from .storage import written

END_ID = 0
_RANKS = 1 << 44  # ranks of one length stay below this


def _spans(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; what doesn't fill a sequence comes first."""
    first = total % capacity or min(total, capacity)
    return [(0, first), *((start, capacity) for start in range(first, total, capacity))]


def pieces(documents: DataFrame, path: str, capacity: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32), with the task that made them and their place `nth` among its
    pieces of that length."""
    schema = pa.schema([
        ("doc_id", _arrow_type(documents, doc_id)), ("piece", pa.int32()), ("start", pa.int64()),
        ("length", pa.int64()), ("ids_crc32", pa.int64()), ("nth", pa.int64()), ("task", pa.int32()),
    ])
    end = np.array([END_ID], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seen = TaskContext.get().partitionId(), {}
        own = encoder(path)
        for batch in batches:
            ids = iter(batch.column(0).to_pylist())
            rows = []
            for portion in in_portions([t or "" for t in batch.column(1).to_pylist()]):
                for data in own.encode(portion):
                    data, doc = data + end, next(ids)
                    for n, (start, length) in enumerate(_spans(len(data) // 4, capacity)):
                        nth = seen.get(length, 0)
                        seen[length] = nth + 1
                        rows.append((doc, n, start, length, crc32(data[4 * start : 4 * (start + length)]), nth, task))
            columns = list(zip(*rows)) or [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    kind = documents.schema[doc_id].dataType.simpleString()
    return documents.select(doc_id, text).mapInArrow(
        cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, nth long, task int"
    )


def _arrow_type(documents: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(documents.schema[name].dataType)


def sweep(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Best-fit plan for so many pieces of each length.

    Returns intervals (length, first rank, first sequence, offset) and the number of sequences. An interval ends where the
    next one of its length begins; ranks and sequences run in step.
    """
    plan: list[tuple[int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # free places: intervals of sequences
    sizes: list[int] = []  # the gaps, sorted
    opened = 0

    def free(size: int, first: int, count: int) -> None:
        if size and count:
            if size not in gaps:
                gaps[size] = []
                insort(sizes, size)
            gaps[size].append((first, count))

    for length in sorted(counts, reverse=True):
        rank, total = 0, counts[length]
        while rank < total and (at := bisect_left(sizes, length)) < len(sizes):  # the successor among the gaps
            size = sizes[at]
            first, count = gaps[size].pop()
            taken = min(count, total - rank)
            plan.append((length, rank, first, capacity - size))
            if taken < count:
                gaps[size].append((first + taken, count - taken))
            if not gaps[size]:
                del gaps[size], sizes[at]
            free(size - length, first, taken)
            rank += taken
        if rank < total:  # no gap is large enough: open sequences, as many pieces in each as fit
            each = capacity // length
            full, rest = divmod(total - rank, each)
            for n in range(each if full else 0):
                plan.append((length, rank, opened, n * length))
                rank += full
            for n in range(rest):
                plan.append((length, rank, opened + full, n * length))
                rank += 1
            free(capacity - each * length, opened, full)
            free(capacity - rest * length, opened + full, 1 if rest else 0)
            opened += full + bool(rest)
    return plan, opened


def pack(
    documents: DataFrame, path: str, capacity: int = 2048, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Packs all documents into sequences of at most `capacity` tokens, best fit first.

    A document's tokens are the tokenizer's ids of the whole text and an end id 0; a null or empty text has the end id
    alone. Documents longer than a sequence are cut into pieces of `capacity` tokens, the first may be shorter. Returns
    doc_id, piece, start, length, ids_crc32, sequence_id and offset per piece. Every row is a document of its own, also
    with a null or repeated id. Columns other than the two named aren't read. An empty table gives an empty result.

    The driver gets one count per length (at most `capacity` numbers) and sends back the intervals of the plan.
    """
    session = documents.sparkSession
    found = written(pieces(documents, path, capacity, doc_id, text), "pieces")
    per_task = found.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    per_task = written(per_task.withColumn("earlier", F.coalesce(F.sum("n").over(before), F.lit(0))), "piece-ranks")
    counts = {r.length: r.n for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan, _ = sweep(counts, capacity)
    plan.sort()
    firsts = np.array([length * _RANKS + rank for length, rank, _, _ in plan], np.int64)
    table = session.sparkContext.broadcast((
        firsts, np.array([p[2] for p in plan], np.int64), np.array([p[3] for p in plan], np.int64),
    ))

    @F.arrow_udf("struct<sequence_id: long, offset: long>")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        starts, sequences, offsets = table.value
        key = length.to_numpy(zero_copy_only=False) * _RANKS + rank.to_numpy(zero_copy_only=False)
        at = np.searchsorted(starts, key, "right") - 1
        return pa.StructArray.from_arrays(
            [pa.array(sequences[at] + key - starts[at]), pa.array(offsets[at])], names=["sequence_id", "offset"]
        )

    ranked = found.join(per_task.drop("n"), ["length", "task"]).withColumn("rank", F.col("earlier") + F.col("nth"))
    return ranked.withColumn("place", place("length", "rank")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "place.sequence_id", "place.offset"
    )
