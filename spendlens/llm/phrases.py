"""Phrases: frequent word sequences whose parts seldom stand apart, per language.

Counting every sequence of words is out of proportion to the few that are frequent. So sequences are first cut into partitions
by their hash, and every partition is summarised by a Misra-Gries summary: counters for at most `capacity` sequences; where
there are more, all counters go down by as much as leaves room. Summaries of parts of the corpus merge into one of the whole. A
counter is below the true count by no more than what all counters went down, and that is less than mass / capacity. With a
capacity above mass / `min_count`, whatever occurs `min_count` times has a counter left. A second pass counts only what has.

Sequences with a word that is too rare on its own are left out of both passes. Both passes learn what to count from bit maps of
a fixed size; a bit that two sequences share makes a pass count more than it needs and changes no result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import batched

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import written

UNKNOWN = "und"
WORD_BITS, PHRASE_BITS = 24, 27  # log2 of the sizes of the bit maps
_LOCAL = 32  # bits of a hash inside its partition
_CUT = b"\xff"  # in no UTF-8 text
_BLOCK = 400_000  # words looked at together
_HELD = 3_000_000  # distinct sequences that a task holds before it gives them away
_SLICE = 32_768


def _folding() -> bytes:
    """A-Z to lower case, ends of pieces to a byte that no text has, tabs to spaces."""
    table = bytearray(range(256))
    table[65:91] = bytes(range(97, 123))
    for c in b".,;:!?\x0a\x0b\x0c\x0d":
        table[c] = _CUT[0]
    table[9] = 32
    return bytes(table)


_FOLD = _folding()


def words_of(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text, and a mark at every end of a piece."""
    return text.translate(_FOLD).replace(_CUT, b" \xff ").split()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """(language, words) of whole texts of one language, in portions of about a block."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            words = held.setdefault(lang, [])
            before = len(words)
            words += words_of(text)
            words.append(_CUT)
            size += len(words) - before
            if size >= _BLOCK:
                yield from held.items()
                held, size = {}, 0
    yield from held.items()


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(language, word, occurrences); all words of a language are counted under null."""
    schema = pa.schema([("lang", pa.string()), ("word", pa.binary()), ("n", pa.int64())])
    found: dict[str, Counter] = {}

    def emitted() -> Iterator[pa.RecordBatch]:
        for lang, counts in found.items():
            counts.pop(_CUT, None)
            names: list[bytes | None] = [None, *counts]
            numbers = [counts.total(), *counts.values()]
            for at in range(0, len(names), _SLICE):
                some = slice(at, at + _SLICE)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(names[some])), pa.array(names[some], pa.binary()), pa.array(numbers[some])], schema=schema)
        found.clear()

    for lang, words in _blocks(batches):
        found.setdefault(lang, Counter()).update(words)
        if sum(map(len, found.values())) > 1_000_000:
            yield from emitted()
    yield from emitted()


class _Words(dict):
    """Number of each frequent word of a language, 0 for others and for marks; `hashes` and `names` have what is behind it."""

    def __init__(self, lang: str, bits: bytes):
        self.seed, self.bits = xxhash.xxh3_64_intdigest(lang.encode()), bits
        self.hashes, self.names = [0], [b""]

    def __missing__(self, word: bytes) -> int:
        number = 0
        if word != _CUT:
            digest = xxhash.xxh3_64_intdigest(word, self.seed)
            place = digest >> (64 - WORD_BITS)
            if self.bits[place >> 3] >> (place & 7) & 1:
                number = len(self.names)
                self.hashes.append(digest)
                self.names.append(word)
        self[word] = number
        return number


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + np.uint64(0x632BE59BD9B4E019))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class _Sequences:
    """Sequences of frequent words in a block."""

    def __init__(self, words: list[bytes], known: _Words, most: int):
        self.known = known
        self.ids = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        digests = np.array(known.hashes, np.uint64)[self.ids]
        whole, ok = digests, self.ids > 0
        self.found: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # length -> (places, hashes)
        for n in range(2, most + 1):
            ok = ok[:-1] & (self.ids[n - 1 :] > 0)
            whole = _mixed(whole[:-1], digests[n - 1 :])
            at = np.flatnonzero(ok)
            self.found[n] = at, whole[at]

    def counted(self, part_bits: int) -> Iterator[tuple[int, bytes, int]]:
        """(partition, sequence, occurrences) of what is found. Keys are word numbers, so nothing is mixed up."""
        key = self.ids.astype(np.uint64)
        for n, (at, hashes) in sorted(self.found.items()):
            # numbers of the sequences that are one word shorter, dense enough for half a key
            _, short = np.unique(key[: len(key) - 1], return_inverse=True)
            key = (short.astype(np.uint64) << np.uint64(32)) | self.ids[n - 1 :].astype(np.uint64)
            _, first, count = np.unique(key[at], return_index=True, return_counts=True)
            names, parts = self.known.names, (hashes[first] >> np.uint64(64 - part_bits)).tolist()
            for part, place, c in zip(parts, at[first].tolist(), count.tolist()):
                yield part, b" ".join([names[i] for i in self.ids[place : place + n].tolist()]), c


def _sequences(batches: Iterator[pa.RecordBatch], bits: bytes, most: int) -> Iterator[tuple[str, _Sequences]]:
    known: dict[str, _Words] = {}
    for lang, words in _blocks(batches):
        if sum(map(len, known.values())) > 2_000_000:
            known.clear()
        if lang not in known:
            known[lang] = _Words(lang, bits)
        yield lang, _Sequences(words, known[lang], most)


def combined(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in order, and the sums of their counts."""
    order = np.argsort(hashes, kind="stable")
    hashes, counts = hashes[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1]))) if len(hashes) else np.zeros(0, np.int64)
    return hashes[first], np.add.reduceat(counts, first) if len(first) else counts


class Summary:
    """A Misra-Gries summary of at most `capacity` counters; `lost` is what a counter may lack of the true count."""

    def __init__(self, capacity: int):
        self.capacity, self.lost = capacity, 0
        self.hashes, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def merge(self, hashes: np.ndarray, counts: np.ndarray) -> None:
        self.hashes, self.counts = combined(np.concatenate((self.hashes, hashes)), np.concatenate((self.counts, counts)))
        if len(self.hashes) > self.capacity:
            place = len(self.counts) - self.capacity - 1
            less = int(np.partition(self.counts, place)[place])  # the largest count that finds no room
            keep = self.counts > less
            self.hashes, self.counts, self.lost = self.hashes[keep], self.counts[keep] - less, self.lost + less

    def possible(self, least: int) -> np.ndarray:
        """Hashes that may have occurred so often."""
        return self.hashes[self.counts + self.lost >= least]


_SLICES = pa.schema([("part", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary())])


def _sliced(hashes: np.ndarray, counts: np.ndarray, part_bits: int) -> Iterator[pa.RecordBatch]:
    """Rows of a partition's hashes; those that occurred once have no counts and stand last."""
    parts = (hashes >> np.uint64(64 - part_bits)).astype(np.int64)
    local = ((hashes << np.uint64(part_bits)) >> np.uint64(64 - _LOCAL)).astype("<u4")
    cuts = np.searchsorted(parts, np.arange((1 << part_bits) + 1))
    rows, size = [], 0
    for part in np.flatnonzero(cuts[1:] > cuts[:-1]):
        for start in range(cuts[part], cuts[part + 1], _SLICE):
            some = slice(start, min(start + _SLICE, cuts[part + 1]))
            often = counts[some] > 1
            own = local[some]
            row = np.concatenate((own[often], own[~often])).tobytes(), counts[some][often].astype("<i8").tobytes()
            rows.append({"part": int(part), "hashes": row[0], "counts": row[1]})
            size += len(row[0]) + len(row[1])
            if size > 4_000_000:
                yield pa.RecordBatch.from_pylist(rows, _SLICES)
                rows, size = [], 0
    yield pa.RecordBatch.from_pylist(rows, _SLICES)


def _summarise(min_count: int, part_bits: int, filter_bits: int):
    def summary(slices: pa.Table) -> pa.Table:
        """Bit map of one partition's share of the possible sequences."""
        read, mass = [], 0
        for h, c in zip(slices["hashes"].to_pylist(), slices["counts"].to_pylist()):
            hashes, often = np.frombuffer(h, "<u4"), np.frombuffer(c, "<i8")
            counts = np.concatenate((often, np.ones(len(hashes) - len(often), np.int64)))
            read.append((hashes, counts))
            mass += int(counts.sum())
        whole = Summary(mass // min_count + 1)
        for hashes, counts in read:
            whole.merge(hashes, counts)
        bits = np.zeros(1 << (filter_bits - part_bits), np.uint8)
        bits[whole.possible(min_count) >> np.uint32(_LOCAL - (filter_bits - part_bits))] = 1
        return pa.table({
            "part": slices["part"][:1], "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary()),
            "mass": pa.array([mass], pa.int64()), "lost": pa.array([whole.lost], pa.int64()),
        })

    return summary


def _bit_map(rows: list, size: int) -> bytes:
    """One bit map from the parts' shares, whose number is a power of two."""
    out = bytearray((1 << size) // 8)
    for r in rows:
        out[r.part * len(r.bits) : (r.part + 1) * len(r.bits)] = r.bits
    return bytes(out)


def _word_bits(frequent: DataFrame) -> bytes:
    """Bit map of the frequent words: 2 MB, whatever the vocabulary."""
    share = WORD_BITS - 10

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, bytearray] = {}
        for batch in batches:
            for lang, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                place = xxhash.xxh3_64_intdigest(word, xxhash.xxh3_64_intdigest(lang.encode())) >> (64 - WORD_BITS)
                own = held.setdefault(place >> share, bytearray(1 << (share - 3)))
                own[(place & ((1 << share) - 1)) >> 3] |= 1 << (place & 7)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.int64()), pa.array([bytes(b) for b in held.values()], pa.binary())], names=["part", "bits"])

    def united(parts: pa.Table) -> pa.Table:
        bits = reduce(np.bitwise_or, [np.frombuffer(b, np.uint8) for b in parts["bits"].to_pylist()])
        return pa.table({"part": parts["part"][:1], "bits": pa.array([bits.tobytes()], pa.binary())})

    shares = frequent.select("lang", "word").mapInArrow(places, "part long, bits binary")
    return _bit_map(shares.groupBy("part").applyInArrow(united, "part long, bits binary").collect(), WORD_BITS)


def frequent_phrases(
    documents: DataFrame, min_count: int = 30, most_words: int = 4, text: str = "text", lang: str = "lang", filter_bits: int = PHRASE_BITS,
) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, count) of all phrases of 1 to `most_words` words with `min_count` occurrences, and (lang, n) of all words.

    Phrases are UTF-8 bytes, joined by spaces; counts are exact. See mined_phrases() for what counts as a word.
    """
    spark = documents.sparkSession
    rows = documents.select(
        F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    counts = written(
        rows.mapInArrow(_count_words, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
        .where((F.col("n") >= min_count) | F.col("word").isNull()), "word-counts")
    totals, frequent = counts.where("word is null").select("lang", "n"), counts.where("word is not null")
    bits = spark.sparkContext.broadcast(_word_bits(frequent))

    # partitions that hold about as many counters each, whatever the corpus
    mass = (most_words - 1) * (totals.agg(F.sum("n")).first()[0] or 0)
    part_bits = min(filter_bits - 3, max(6, (mass // min_count >> 16).bit_length()))

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, raw, size = (np.zeros(0, np.uint64), np.zeros(0, np.int64)), [], 0
        for _, found in _sequences(batches, bits.value, most_words):
            for _, hashes in found.found.values():
                raw.append(hashes)
                size += len(hashes)
            if size > _HELD:
                held, raw, size = _added(held, raw), [], 0
                if len(held[0]) > _HELD:
                    yield from _sliced(*held, part_bits)
                    held = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        yield from _sliced(*_added(held, raw), part_bits)

    shares = (
        rows.mapInArrow(summaries, "part long, hashes binary, counts binary").groupBy("part")
        .applyInArrow(_summarise(min_count, part_bits, filter_bits), "part long, bits binary, mass long, lost long").collect()
    )
    if any(r.lost >= min_count for r in shares):
        raise AssertionError("a summary lost more than its capacity allows")
    wanted = spark.sparkContext.broadcast(_bit_map(shares, filter_bits))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = np.frombuffer(wanted.value, np.uint8)
        held: dict[tuple[int, str], Counter] = {}
        size = 0
        for name, found in _sequences(batches, bits.value, most_words):
            for n, (at, hashes) in found.found.items():
                place = (hashes >> np.uint64(64 - filter_bits)).astype(np.int64)
                hit = ((chosen[place >> 3] >> (place & 7).astype(np.uint8)) & 1) > 0
                found.found[n] = at[hit], hashes[hit]
            for part, phrase, c in found.counted(part_bits):
                own = held.setdefault((part, name), Counter())
                size += phrase not in own
                own[phrase] += c
            if size > 500_000:
                yield from _gathered(held)
                held, size = {}, 0
        yield from _gathered(held)

    def summed(gathered: pa.Table) -> pa.Table:
        """Exact counts of a partition's phrases in a language."""
        whole = pa.table({
            "phrase": pa.concat_arrays([c.flatten() for c in gathered["phrases"].chunks]),
            "count": pa.concat_arrays([c.flatten() for c in gathered["counts"].chunks]),
        }).group_by("phrase").aggregate([("count", "sum")])
        whole = whole.filter(pc.greater_equal(whole["count_sum"], min_count))
        return pa.table({
            "lang": pa.array([gathered["lang"][0].as_py()] * whole.num_rows, pa.string()), "phrase": whole["phrase"],
            "words": pc.cast(pc.add(pc.count_substring(whole["phrase"], b" "), 1), pa.int32()), "count": whole["count_sum"],
        })

    # each task gives a row for each partition and language; those of one partition are few enough for one task
    phrases = (
        rows.mapInArrow(exact, "part long, lang string, phrases array<binary>, counts array<long>").groupBy("part", "lang")
        .applyInArrow(summed, "lang string, phrase binary, words int, count long")
    )
    single = frequent.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("words"), F.col("n").alias("count"))
    return written(phrases.unionByName(single), "frequent-phrases"), totals


def _gathered(held: dict[tuple[int, str], Counter]) -> Iterator[pa.RecordBatch]:
    """A row for each partition and language, with its phrases and their counts."""
    for keys in batched(held, 64):
        yield pa.RecordBatch.from_arrays([
            pa.array([part for part, _ in keys], pa.int64()), pa.array([lang for _, lang in keys], pa.string()),
            pa.array([list(held[k]) for k in keys], pa.list_(pa.binary())), pa.array([list(held[k].values()) for k in keys], pa.list_(pa.int64())),
        ], names=["part", "lang", "phrases", "counts"])


def _added(held: tuple[np.ndarray, np.ndarray], raw: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    hashes, counts = np.unique(np.concatenate(raw) if raw else np.zeros(0, np.uint64), return_counts=True)
    return combined(np.concatenate((held[0], hashes)), np.concatenate((held[1], counts.astype(np.int64))))


def _joined(words: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def mined_phrases(
    documents: DataFrame, min_count: int = 30, most_words: int = 4, covered: int = 80, first: int = 2000, text: str = "text",
    lang: str = "lang", filter_bits: int = PHRASE_BITS,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `first` phrases of 2 to `most_words` words.

    A-Z count as a-z; texts are cut at . , ; : ! ? and line ends, and what is left into words at spaces and tabs. A phrase
    lies inside one such piece; all its occurrences count, overlapping ones too. Candidates occur `min_count` times. Of the
    ways to cut a candidate in two, that with the smallest floor(2,000,000 a / (l + r)) gives its score (the first of equal
    ones), where a, l and r count the phrase and its two parts. A candidate whose words lie in a longer one with at least
    `covered` % of its occurrences goes. Order is score, then a, both from the top, then the phrase by its bytes. n counts
    the language's words. All numbers are exact.

    A null text is empty, a null language is `und`. Every row counts, also when it repeats another; ids and other columns
    aren't read. An empty table, or one without frequent phrases, gives an empty result. Of a very long text, its words
    are held at once, by one task.
    """
    counted, totals = frequent_phrases(documents, min_count, most_words, text, lang, filter_bits)
    counted = counted.select("lang", F.col("phrase").cast("string").alias("phrase"), "words", "count")
    words = F.split("phrase", " ")
    candidates = counted.where("words > 1")

    cuts = candidates.select(
        "lang", "phrase", F.col("count").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"), "words",
    ).select(
        "lang", "phrase", "a", "k", _joined(words, F.lit(1), F.col("k")).alias("left"),
        _joined(words, F.col("k") + 1, F.col("words") - F.col("k")).alias("right"),
    )
    part = counted.select(F.col("lang").alias("_lang"), F.col("phrase").alias("_phrase"), F.col("count").alias("_count"))

    def with_count(table: DataFrame, name: str, out: str) -> DataFrame:
        return table.join(part, (F.col("lang") == F.col("_lang")) & (F.col(name) == F.col("_phrase"))).withColumn(
            out, F.col("_count")).drop("_lang", "_phrase", "_count", name)

    # products and sums of counts may pass 64 bits
    scored = with_count(with_count(cuts, "left", "l"), "right", "r").withColumn(
        "score", F.expr("(CAST(2000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(19,0))) div (CAST(l AS DECIMAL(19,0)) + CAST(r AS DECIMAL(19,0)))")
    )
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("best")).select(
        "lang", "phrase", "best.a", "best.l", "best.r", "best.score")

    # every part of a longer candidate, with the most that such a one occurs
    starts = F.explode(F.expr(
        "flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), s -> struct(s AS s, m AS m))))")).alias("cut")
    inner = (
        candidates.where("words > 2").select("lang", "phrase", "count", starts)
        .select("lang", _joined(words, F.col("cut.s"), F.col("cut.m")).alias("phrase"), "count")
        .groupBy("lang", "phrase").agg(F.max("count").alias("longer"))
    )
    kept = best.join(inner, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (F.col("longer").cast("decimal(19,0)") * 100 < F.col("a").cast("decimal(19,0)") * covered))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (
        kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first).join(totals, "lang")
        .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    )
