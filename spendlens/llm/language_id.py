"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram is its letters' vectors, each rotated by the letter's place, bound
by multiplication; a text is the sum (bundle) of its n-grams' vectors. A language's prototype is the bundle of its learning
texts. A text gets the language whose prototype has the largest cosine to it, after the mean of all prototypes, which says
nothing about the language, has been taken off both.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import fresh

DIMENSIONS = 1024
N = 3
UNKNOWN = "und"
_BLOCK = 4096  # n-grams whose vectors are held at once


class _Letters:
    """Vectors of letters and n-grams. They depend on the code points only, so that all workers agree."""

    def __init__(self, dimensions: int, n: int):
        self.dimensions, self.n = dimensions, n
        self.vectors: dict[int, np.ndarray] = {}
        self.is_letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)

    def _letter(self, code: int) -> np.ndarray:
        if code not in self.vectors:
            if len(self.vectors) > 20_000:
                self.vectors.clear()
            bits = np.random.Generator(np.random.Philox(key=code)).integers(0, 2, self.dimensions, np.int8)
            self.vectors[code] = 2 * bits - 1
        return self.vectors[code]

    def grams(self, grams: np.ndarray) -> np.ndarray:
        """One row of +1 and -1 for each n-gram."""
        out = np.ones((len(grams), self.dimensions), np.int8)
        for place in range(self.n):
            codes, at = np.unique((grams >> (21 * (self.n - 1 - place))) & 0x1FFFFF, return_inverse=True)
            out *= np.stack([np.roll(self._letter(int(c)), self.n - 1 - place) for c in codes])[at]
        return out.astype(np.float32)

    def counted(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, n-gram, count) of all n-grams, and whether a text has a letter. What is no letter stands for one space."""
        codes = [np.frombuffer((t or "").lower().encode("utf-32-le", "replace"), "<u4") for t in texts]
        border = np.zeros(1, np.uint32)
        flat = np.concatenate([x for c in codes for x in (border, c, border)]) if codes else border
        row = np.repeat(np.arange(len(codes)), [len(c) + 2 for c in codes]) if codes else np.zeros(1, np.int64)
        letter = self.is_letter[flat]
        has = np.zeros(len(codes), bool)
        has[row[letter]] = True
        flat = np.where(letter, flat, 0).astype(np.int64)
        keep = letter | np.concatenate(([True], letter[:-1])) | np.concatenate(([True], row[1:] != row[:-1]))
        flat, row = flat[keep], row[keep]
        if len(flat) < self.n:
            none = np.zeros(0, np.int64)
            return none, none, none, has
        key = flat[: len(flat) - self.n + 1].copy()
        for place in range(1, self.n):
            key = (key << 21) | flat[place : len(flat) - self.n + 1 + place]
        inside = (row[: len(key)] == row[self.n - 1 :]) & (key != 0)
        grams, at = np.unique(key[inside], return_inverse=True)
        pair, count = np.unique(row[: len(inside)][inside] * max(1, len(grams)) + at, return_counts=True)
        return pair // max(1, len(grams)), grams[pair % max(1, len(grams))], count, has

    def bundles(self, texts: list[str | None], groups: np.ndarray | None = None, n_groups: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Bundles of the texts, or of groups of texts, and whether a text has a letter."""
        row, gram, count, has = self.counted(texts)
        if groups is not None:
            row = groups[row]
        out = np.zeros((n_groups if groups is not None else len(texts), self.dimensions), np.float32)
        every, at = np.unique(gram, return_inverse=True)
        for start in range(0, len(every), _BLOCK):
            some = every[start : start + _BLOCK]
            inside = (at >= start) & (at < start + len(some))
            counts = np.zeros((len(out), len(some)), np.float32)
            np.add.at(counts, (row[inside], at[inside] - start), count[inside])
            out += counts @ self.grams(some)
        return out, has


_WORKER: dict[tuple[int, int], _Letters] = {}


def _letters(dimensions: int, n: int) -> _Letters:
    if (dimensions, n) not in _WORKER:
        _WORKER[dimensions, n] = _Letters(dimensions, n)
    return _WORKER[dimensions, n]


def _portions(texts: list[str | None], characters: int = 500_000) -> Iterator[slice]:
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= characters:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


class Profiles:
    """Prototypes by language."""

    def __init__(self, languages: list[str], sums: np.ndarray, dimensions: int, n: int):
        self.languages, self.dimensions, self.n = languages, dimensions, n
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        unit = sums / np.where(norms > 0, norms, 1)
        self.mean = unit.mean(axis=0) if len(languages) > 1 else np.zeros(dimensions)
        rest = unit - self.mean
        norms = np.linalg.norm(rest, axis=1, keepdims=True)
        self.prototypes = (rest / np.where(norms > 0, norms, 1)).astype(np.float32)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and cosine (0 where it is negative) of each text; `und` and 0 without a letter or any language."""
        bundles, has = _letters(self.dimensions, self.n).bundles(texts)
        norms = np.linalg.norm(bundles, axis=1, keepdims=True)
        rest = bundles / np.where(norms > 0, norms, 1) - self.mean.astype(np.float32)
        norms = np.linalg.norm(rest, axis=1, keepdims=True)
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        cosines = (rest / np.where(norms > 0, norms, 1)) @ self.prototypes.T
        best = cosines.argmax(axis=1)
        scores = np.clip(cosines[np.arange(len(texts)), best], 0, 1).astype(float)
        known = has.tolist()
        return (
            [self.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), known)],
            [s if ok else 0.0 for s, ok in zip(scores.tolist(), known)],
        )


def rows_of_each(counts: list[int], total: int) -> float:
    """The largest number of rows a language may give, so that all together give `total`; at least one."""
    left = total
    for place, count in enumerate(sorted(counts)):
        share = left / (len(counts) - place)
        if count > share:
            return max(1.0, share)
        left -= count
    return float(max(counts, default=1))


def learn(
    labelled: DataFrame, text: str = "text", lang: str = "lang", sample_rows: int = 20_000, dimensions: int = DIMENSIONS, n: int = N,
) -> Profiles:
    """Prototypes from the rows with a text and a language.

    Equal texts of a language count once, so that copies don't outweigh the rest. `sample_rows` bounds the texts that are
    learned from: all if there are no more, else about that many, drawn in each language by a hash of the text; the same rows
    in other files give the same prototypes. Languages with few texts keep all of theirs; the others get equally many, one at
    least. Each task sends one vector per language; the languages have to be few enough for the driver to hold a vector of each.
    """
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    distinct = rows.select("lang", F.xxhash64("text").alias("h")).distinct()
    counts = {r.lang: r.n for r in distinct.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if sum(counts.values()) > sample_rows:
        most = rows_of_each(list(counts.values()), sample_rows)
        shares = F.create_map(*(F.lit(x) for name, count in counts.items() for x in (name, min(1.0, most / count))))
        drawn = F.pmod(F.xxhash64("text", F.lit("sample")), F.lit(1 << 30)) / (1 << 30)
        rows = rows.where(drawn < shares[F.col("lang")])
    rows = rows.distinct()

    def bundled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for some in _portions(texts):
                names = sorted(set(langs[some]))
                groups = np.array([names.index(x) for x in langs[some]])
                found, _ = _letters(dimensions, n).bundles(texts[some], groups, len(names))
                for name, vector in zip(names, found):
                    sums[name] = sums.get(name, 0) + vector.astype(np.int64)
        yield pa.RecordBatch.from_arrays([
            pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64())),
        ], names=["lang", "sums"])

    parts = rows.mapInArrow(bundled, "lang string, sums array<long>")
    places = parts.select("lang", F.posexplode("sums").alias("at", "value")).groupBy("lang", "at").agg(F.sum("value").alias("value"))
    found = places.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("v")).collect()
    found.sort(key=lambda r: r.lang)
    sums = np.array([[x.value for x in r.v] for r in found], float).reshape(len(found), dimensions)
    return Profiles([r.lang for r in found], sums, dimensions, n)


def predicted(profiles: Profiles, text: Column) -> Column:
    """Struct of lang and score for a text column."""
    from pyspark.sql import SparkSession

    table = SparkSession.active().sparkContext.broadcast(profiles)

    @F.arrow_udf("struct<lang: string, score: double>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = batch.to_pylist()
            found = [table.value.predict(texts[some]) for some in _portions(texts)]
            langs, scores = (list(itertools.chain.from_iterable(part)) for part in zip(*found)) if found else ([], [])
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["lang", "score"])

    return predict(text)


def identify(
    documents: DataFrame, profiles: Profiles, text: str = "text", lang_pred: str = "lang_pred", score: str = "score",
) -> DataFrame:
    """Adds the predicted language and its score (the cosine, 0 to 1) to every row.

    Null texts and texts without a letter are `und` with score 0, and so is every text where nothing was learned. Rows that
    repeat another get the same prediction; other columns pass through, and ones named as the new ones are replaced. An
    empty table gives an empty result. Very long texts are held one at a time.
    """
    (name,) = fresh(documents, "found")
    found = documents.withColumn(name, predicted(profiles, F.col(text)))
    return found.withColumns({lang_pred: F.col(name).lang, score: F.col(name).score}).drop(name)
