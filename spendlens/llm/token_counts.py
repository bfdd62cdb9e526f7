"""Token counts: a broadcast table of frequent pieces first, worker caches and the tokenizer library behind it."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoding import Encoder, in_portions

_WORKER: dict[str, Encoder] = {}


LONGEST = 32  # characters of a piece that the table may hold


def _reduced(found: Counter, size: int) -> Counter:
    """At most `size` of the counts, each less by the largest one that goes: of n counted pieces, none loses more than
    n / (size + 1), however often this is done."""
    least = sorted(found.values(), reverse=True)[size]
    return Counter({p: n - least for p, n in found.items() if n > least})


def frequent_pieces(texts: DataFrame, path: str, size: int = 20_000) -> dict[str, int]:
    """Token counts of the pieces most frequent in all texts: `size` entries at most.

    Every task sums up its texts in a bounded table and passes on its `size` most frequent pieces. The table only saves work: a
    piece that it lacks is encoded by a worker.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found.update([p for p in (text or "").split(" ")[1:] if len(p) <= LONGEST])
                if len(found) > 20 * size:
                    found = _reduced(found, 10 * size)
        found.pop("", None)
        top = [(p, n) for p, n in found.most_common(size) if n > 1 and p.isascii() and p.isprintable()]
        yield pa.RecordBatch.from_pylist([{"piece": p, "n": n} for p, n in top], pa.schema({"piece": pa.string(), "n": pa.int64()}))

    rows = (
        texts.mapInArrow(counted, "piece string, n long")
        .groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(size).collect()
    )
    own = Encoder(path, counting=True)
    pieces = [r.piece for r in rows]
    whole = zip(pieces, own.encode([" " + p for p in pieces]))  # a piece never joins the space before it with more
    return {p: n for p, n in whole if not any(s in p for s in own.special)}


def token_counts(
    documents: DataFrame, path: str, limit: int = 1024, text: str = "text", n_bytes: str = "n_bytes",
    n_tokens: str = "n_tokens", over_limit: str = "over_limit", size: int = 20_000,
) -> DataFrame:
    """Adds UTF-8 bytes, tokens of the whole text and whether they exceed `limit`.

    No pre-token of a text is shuffled for the counts: the frequent table (20,000 entries at most) is broadcast, each Python worker
    keeps it for good and beside it a bounded cache of what it lacks. Null and empty texts have 0 bytes and 0 tokens. Every row gives a row,
    repeated ones too; other columns, null ids included, pass through; a column named as one of the three new ones is
    replaced. An empty table gives an empty result.
    """
    session = documents.sparkSession
    table = session.sparkContext.broadcast(frequent_pieces(documents.select(text), path, size))
    key = uuid.uuid4().hex

    @F.arrow_udf("long")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if key not in _WORKER:
            _WORKER.clear()
            _WORKER[key] = Encoder(path, counting=True, known=table.value)
        for batch in batches:
            found: list[int] = []
            for portion in in_portions(batch.to_pylist()):
                found += _WORKER[key].encode(portion)
            yield pa.array(found, pa.int64())

    whole = F.coalesce(F.col(text), F.lit(""))
    return documents.withColumns({n_bytes: F.octet_length(whole).cast("long"), n_tokens: counted(whole)}).withColumn(
        over_limit, F.col(n_tokens) > limit
    )
