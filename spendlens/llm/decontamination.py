"""Benchmark decontamination: one Aho-Corasick automaton over the item windows, one scan of every text.

Texts and items are compared as words: runs of ASCII letters (A-Z as a-z), digits and characters beyond ASCII. In UTF-8 all
bytes of the latter are above 127, so a table of 256 bytes normalises a text, and byte offsets lead back to the original.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import fresh

_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)
#: bytes of item text in one automaton; a larger benchmark is scanned for in several
BLOCK_BYTES = 8 << 20

_HITS = "n_words long, n_hit long, items array<string>, spans array<struct<start: long, end: long>>"
_AUTOMATA: dict = {}


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_WORD_BYTES).split()


def _joined(words: list[bytes]) -> str:
    """One character for a byte, a space around every word."""
    return (b" " + b" ".join(words) + b" ").decode("latin-1")


def _automaton(items: list[tuple[str, str]], window: int):
    """Automaton of the items' windows; a window's value is its length in words and the places of its items."""
    import ahocorasick

    found: dict[str, tuple[int, set[int]]] = {}
    for place, (_, text) in enumerate(items):
        words = _words(text)
        for at in range(max(1, len(words) - window + 1) if words else 0):
            some = words[at : at + window]
            found.setdefault(_joined(some), (len(some), set()))[1].add(place)
    out = ahocorasick.Automaton()
    for pattern, value in found.items():
        out.add_word(pattern, value)
    if found:
        out.make_automaton()
    return out if found else None


def _scan(text: str | None, automaton) -> tuple[int, int, set[int], list[tuple[int, int]]]:
    """Words, words hit, places of the items, and hit spans in code points of the original."""
    data = (text or "").encode()
    clean = data.translate(_WORD_BYTES)
    words = clean.split()
    hits = list(automaton.iter(_joined(words))) if words and automaton is not None else []
    if not hits:
        return len(words), 0, set(), []
    ends = np.cumsum([len(w) + 1 for w in words])  # place of the space after each word in the joined text
    last = np.searchsorted(ends, np.array([end for end, _ in hits]))
    first = last + 1 - np.array([n for _, (n, _) in hits])
    places = set().union(*(p for _, (_, p) in hits))
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, first, 1)
    np.add.at(step, last + 1, -1)
    hit = np.cumsum(step[:-1]) > 0
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    raw, flat = np.frombuffer(data, np.uint8), np.frombuffer(clean, np.uint8) != 0x20
    border = np.flatnonzero(np.diff(np.concatenate(([0], flat.astype(np.int8), [0]))))
    begin, end = border[::2], border[1::2]  # bytes of each word in the original
    points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))  # code points before each byte
    spans = [(int(points[begin[a]]), int(points[end[b - 1]])) for a, b in zip(edge[::2], edge[1::2])]
    return len(words), int(hit.sum()), places, spans


def _marked(text, items: list[tuple[str, str]], window: int):
    """Column of hits of one block of items."""
    import uuid

    from pyspark.sql import SparkSession

    table, key = SparkSession.active().sparkContext.broadcast(items), uuid.uuid4().hex
    kind = pa.struct([
        ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ])

    @F.arrow_udf(f"struct<{_HITS}>")
    def marked(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if key not in _AUTOMATA:
            while len(_AUTOMATA) > 1:
                _AUTOMATA.pop(next(iter(_AUTOMATA)))
            _AUTOMATA[key] = _automaton(table.value, window)
        for batch in batches:
            rows = []
            for value in batch:
                words, hit, places, spans = _scan(value.as_py(), _AUTOMATA[key])
                names = sorted({table.value[p][0] for p in places})
                rows.append({"n_words": words, "n_hit": hit, "items": names, "spans": [{"start": a, "end": b} for a, b in spans]})
            yield pa.array(rows, kind)

    return marked(text)


def decontaminate(
    documents: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text", item_id: str = "item_id",
    item_text: str = "text", block_bytes: int = BLOCK_BYTES, out: str = "contamination",
) -> DataFrame:
    """Adds a struct `out`: n_words, n_hit, items (ids as strings, sorted) and spans (code points of the original).

    A window is `window` consecutive words of an item, or a shorter item's words; a word inside any occurrence of a window is
    hit. Null and empty texts have no words and no hits; items without words have no window; rows of the benchmark with equal
    ids are one item. An empty table or benchmark gives no hits. Other columns pass through; one named as `out` is
    replaced. Null item ids are named `null`.

    Items are broadcast in blocks of about `block_bytes` (each holds one item at least, repeated rows once); a benchmark of one block is scanned
    for once, a larger one by one automaton after the other, and the hits are merged.
    """
    whole = benchmark.select(
        F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"), F.coalesce(F.col(item_text), F.lit("")).alias("text")
    ).distinct()
    size = whole.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = max(1, ceil(size / block_bytes))
    part = F.pmod(F.xxhash64("item", "text"), F.lit(blocks))
    columns = []
    for n in range(blocks):
        items = [(r.item, r.text) for r in whole.where(part == n).collect()]
        columns.append(_marked(F.col(text), items, window))
    if blocks == 1:
        return documents.withColumn(out, columns[0])
    return _merged(documents.withColumn(out, F.array(*columns)), text, out)


def _merged(documents: DataFrame, text: str, out: str) -> DataFrame:
    """One struct from those of several blocks. Words are counted again inside the merged spans."""
    (name,) = fresh(documents, "spans")
    spans = F.array_sort(F.flatten(F.col(out).spans))
    empty = F.lit([]).cast("array<struct<start: long, end: long>>")
    merged = F.aggregate(spans, empty, lambda acc, s: F.when(
        (F.size(acc) > 0) & (s.start <= F.element_at(acc, -1).end),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(
            F.element_at(acc, -1).start.alias("start"), F.greatest(F.element_at(acc, -1).end, s.end).alias("end")))),
    ).otherwise(F.concat(acc, F.array(s))))
    inside = F.transform(name, lambda s: F.size(F.regexp_extract_all(
        F.substring(F.col(text), (s.start + 1).cast("int"), (s.end - s.start).cast("int")),
        F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))).cast("long"))
    return documents.withColumn(name, F.when(F.size(F.flatten(F.col(out).spans)) > 0, merged).otherwise(empty)).withColumn(
        out, F.struct(
            F.element_at(out, 1).n_words.alias("n_words"),
            F.aggregate(inside, F.lit(0).cast("long"), lambda a, b: a + b).alias("n_hit"),
            F.array_sort(F.array_distinct(F.flatten(F.col(out).items))).alias("items"),
            F.col(name).alias("spans"),
        )).drop(name)
