"""Near-duplicate documents: an inverted join over the coordinates of MinHash signatures, confirmed on full shingle sets.

A class is all documents with the same shingle set. Classes are posted under each (coordinate, value) pair of their
signatures. Two sets that are similar enough agree in at least T of k coordinates (but for a chance of `MISS`), so

- a class needs T values that it shares with another class at all, and
- it is enough to look for partners in the lists of its k - T + 1 rarest values (its prefix); longer lists are skipped.

Lists of a prefix aren't expanded into pairs. Each first links its classes to the one whose set has the fewest shingles of
its own; what is confirmed forms components. Only pairs of different components that are still possible by the counts of
shingles which occur in one class alone are then compared, so no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .storage import written

COORDINATES = 32
MISS = 1e-9

# Fixed values of a well-known 64-bit mixing function.
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15))
_FOLD = bytes(0x20 if b in b"\x20\t\n\x0b\x0c\r" else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def least_matches(threshold: float, coordinates: int = COORDINATES, miss: float = MISS) -> int:
    """Matching coordinates that two sets with this similarity have, but for a chance of `miss`."""
    below = 0.0
    for n in range(coordinates + 1):
        below += comb(coordinates, n) * threshold**n * (1 - threshold) ** (coordinates - n)
        if below > miss:
            return n
    return coordinates


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles: `words` consecutive words, or all words if there are fewer."""
    from xxhash import xxh3_64_intdigest

    found = (text or "").encode().translate(_FOLD).split(b" ")
    found = [w for w in found if w]
    if not found:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxh3_64_intdigest, found), np.uint64, len(found))
    size = min(words, len(found))
    out = np.full(len(found) - size + 1, size, np.uint64)
    for place in range(size):
        out = _mixed(out * _MIX[2] + hashes[place : len(found) - size + 1 + place])
    return np.unique(out)


def _seeds(coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    numbers = np.random.Generator(np.random.Philox(key=1)).integers(0, 1 << 63, (2, coordinates), np.uint64)
    return numbers[0] * np.uint64(2) + np.uint64(1), numbers[1]


def _sketches(documents: DataFrame, doc_id: str, text: str, words: int, coordinates: int) -> DataFrame:
    """doc_id, same (hash of the text), n_shingles, digest of the set (null if it is empty) and signature of every row."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = documents.schema[doc_id].dataType
    schema = pa.schema([
        ("doc_id", to_arrow_type(kind)), ("same", pa.string()), ("n_shingles", pa.int64()), ("digest", pa.binary()),
        ("signature", pa.list_(pa.int64())),
    ])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor, term = _seeds(coordinates)
        for batch in batches:
            sets = [shingles(t.as_py(), words) for t in batch.column(2)]
            sizes = [len(s) for s in sets]
            filled = [s for s in sets if len(s)]
            signatures = np.zeros((len(filled), coordinates), np.uint64)
            if filled:
                flat = np.concatenate(filled)
                starts = np.cumsum([0, *map(len, filled[:-1])])
                for n in range(coordinates):
                    signatures[:, n] = np.minimum.reduceat(flat * factor[n] + term[n], starts)
            rows = iter(signatures.view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(sizes, pa.int64()),
                pa.array([blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                pa.array([next(rows) if n else None for n in sizes], pa.list_(pa.int64())),
            ], schema=schema)

    whole = F.coalesce(F.col(text), F.lit(""))
    return documents.select(F.col(doc_id).alias("doc_id"), F.md5(whole).alias("same"), whole.alias("text")).mapInArrow(
        sketch, f"doc_id {kind.simpleString()}, same string, n_shingles long, digest binary, signature array<long>"
    )


def _sets(wanted: DataFrame, documents: DataFrame, doc_id: str, text: str, words: int) -> DataFrame:
    """(c, shingles) of classes c whose sets can be made from the row with the class's doc_id and text."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py(), words).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["c", "shingles"])

    whole = F.coalesce(F.col(text), F.lit(""))
    rows = documents.select(F.col(doc_id).alias("doc_id"), whole.alias("text")).join(
        wanted.select("c", F.col("doc_id").alias("_id"), "same"),
        F.col("doc_id").eqNullSafe(F.col("_id")) & (F.md5("text") == F.col("same")),
    )
    return rows.select("c", "text").mapInArrow(make, "c long, shingles array<long>").dropDuplicates(["c"])


def _similar(common: Column, a: Column, b: Column, threshold: float) -> Column:
    """common / union >= threshold, in whole numbers."""
    parts = round(threshold * 10_000)
    return common * 10_000 >= (a + b - common) * parts


def _rare(sets: DataFrame) -> DataFrame:
    """Counts of the shingles that the same `n` classes, three at most, have and no other class: low, classes, n, shingles."""
    third = F.col("all").bitwiseXOR(F.col("low")).bitwiseXOR(F.col("high"))
    classes = F.when(F.col("n") == 1, F.array("low")).when(F.col("n") == 2, F.array("low", "high")).otherwise(F.array("low", third, "high"))
    return (
        sets.select("c", F.explode("shingles").alias("s")).groupBy("s")
        .agg(F.min("c").alias("low"), F.max("c").alias("high"), F.bit_xor("c").alias("all"), F.count("*").alias("n"))
        .where("n <= 3").groupBy("low", "high", "all", "n").agg(F.count("*").alias("shingles"))
        .select("low", classes.alias("classes"), "n", "shingles")
    )


def _possible(a: str, b: str, threshold: float, shared: str = "held") -> Column:
    """Whether two sets can be similar enough, by their sizes and the counts of those shingles that they can share."""
    most = F.least(F.col(f"{a}_{shared}"), F.col(f"{b}_{shared}"))
    return _similar(most, F.col(f"{a}_n"), F.col(f"{b}_n"), threshold)


def _confirmed(pairs: DataFrame, sets: DataFrame, threshold: float, matches: int) -> DataFrame:
    """The pairs (a, b) that match in enough coordinates and whose sets are similar enough."""
    left = sets.select(F.col("c").alias("a"), F.col("shingles").alias("sa"), F.col("signature").alias("ga"))
    right = sets.select(F.col("c").alias("b"), F.col("shingles").alias("sb"), F.col("signature").alias("gb"))
    equal = F.size(F.filter(F.zip_with("ga", "gb", lambda x, y: x == y), lambda e: e))
    common = F.size(F.array_intersect("sa", "sb")).cast("long")
    return (
        pairs.join(left, "a").join(right, "b").where(equal >= matches)
        .where(_similar(common, F.size("sa").cast("long"), F.size("sb").cast("long"), threshold)).select("a", "b")
    )


def near_duplicates(
    documents: DataFrame, threshold: float = 0.8, words: int = 5, doc_id: str = "doc_id", text: str = "text",
    coordinates: int = COORDINATES,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, same) of every row: components of documents linked by similar shingle sets.

    Words are what stands between white space, A-Z in lower case. A set holds the distinct shingles of `words` words, or all
    words as one if there are fewer; a text without words, or null, has an empty set and is linked with nothing. Documents
    are linked if the Jaccard similarity of their sets is at least `threshold`. component_id is the smallest doc_id reachable,
    kept says whether it is the document's own, same is the MD5 of the text. Rows with equal ids and texts are kept or dropped alike; null ids are above all others, and a
    component of null ids has a null component_id and keeps its rows. Other columns aren't read. An empty table gives an
    empty result.
    """
    matches = least_matches(threshold, coordinates)
    sketches = written(_sketches(documents, doc_id, text, words, coordinates), "sketches")
    classes = written(
        sketches.where("digest is not null").groupBy("digest").agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "same")).alias("row"), F.first("n_shingles").alias("n"),
            F.first("signature").alias("signature"),
        ).select(F.monotonically_increasing_id().alias("c"), "digest", "row.doc_id", "row.same", "n", "signature"), "classes",
    )
    postings = classes.select("c", F.posexplode("signature").alias("k", "value"))
    shared = written(
        postings.groupBy("k", "value").agg(F.count("*").alias("df")).where("df > 1"), "shared-values"
    )
    # values shared with nobody are the rarest, so they come first in the prefix
    length = F.size("all") - matches + 1
    prefixes = written(
        postings.join(shared, ["k", "value"]).groupBy("c").agg(F.array_sort(F.collect_list(F.struct("df", "k", "value"))).alias("all"))
        .where(length >= 1).select("c", F.slice("all", 1, length).alias("prefix")), "prefixes",
    )
    found = written(
        _sets(prefixes.join(classes, "c").select("c", "doc_id", "same"), documents, doc_id, text, words)
        .join(classes.select("c", "n", "signature"), "c"), "contested-sets",
    )
    rare = written(_rare(found), "rare-shingles")
    own = rare.where("n = 1").select(F.col("low").alias("c"), F.col("shingles").alias("own"))
    few = rare.select(F.explode("classes").alias("c"), "shingles").groupBy("c").agg(F.sum("shingles").alias("few"))
    sizes = found.select("c", "n").join(own, "c", "left").join(few, "c", "left").select(
        "c", "n", (F.col("n") - F.coalesce("own", F.lit(0))).alias("held"), (F.col("n") - F.coalesce("few", F.lit(0))).alias("common"))
    posted = written(
        prefixes.join(sizes, "c").where(_similar(F.col("held"), F.col("n"), F.col("held"), threshold))
        .select("c", "n", "held", "common", F.explode("prefix").alias("p")).select("c", "n", "held", "common", "p.k", "p.value"), "postings",
    )

    # first each list's classes with the one that has the fewest shingles of its own
    centre = F.min(F.struct((F.col("n") - F.col("held")).alias("own"), "c", "n", "held"))
    leaders = written(
        posted.groupBy("k", "value").agg(centre.alias("m"), F.count("*").alias("size")).where("size > 1")
        .select("k", "value", F.col("m.c").alias("b"), F.col("m.n").alias("b_n"), F.col("m.held").alias("b_held")), "leaders",
    )
    members = posted.select("k", "value", F.col("c").alias("a"), F.col("n").alias("a_n"), F.col("held").alias("a_held"))
    stars = members.join(leaders, ["k", "value"]).where("a <> b").where(_possible("a", "b", threshold)).select("a", "b").distinct()
    first = written(_confirmed(stars, found, threshold, matches), "links")
    grouped = written(components(first), "components")

    # then the pairs across components in the same list
    labelled = written(
        posted.join(grouped.withColumnRenamed("node", "c"), "c", "left").withColumn("g", F.coalesce("component", "c"))
        .drop("component"), "labelled-postings",
    )
    open_lists = written(
        labelled.groupBy("k", "value").agg(
            F.min("g").alias("low"), F.max("g").alias("high"),
            F.min(F.struct((F.col("n") - F.col("held")).alias("own"), "c", "g")).alias("m"),
        ).where("low < high").select("k", "value", F.col("m.g").alias("main")), "open-lists",
    )
    keys = prefixes.select("c", F.transform("prefix", lambda p: F.xxhash64(p.k, p.value)).alias("keys"))
    side = written(labelled.join(open_lists, ["k", "value"]).join(keys, "c"), "open-postings")

    def named(table: DataFrame, name: str) -> DataFrame:
        return table.select("k", "value", "main", *(F.col(c).alias(f"{name}_{c}") for c in ("c", "n", "common", "g", "keys")))

    # Pairs that share no shingle of only two or three classes are bounded by the counts of all other shingles. A pair comes
    # from the first of the lists that it shares.
    here = F.array_min(F.array_intersect("a_keys", "b_keys")) == F.xxhash64("k", "value")
    listed = (
        named(side.where("g <> main"), "a").join(named(side, "b").drop("main"), ["k", "value"])
        .where((F.col("a_g") != F.col("b_g")) & ((F.col("b_g") == F.col("main")) | (F.col("a_c") < F.col("b_c"))))
        .where(_possible("a", "b", threshold, "common")).where(here).select(F.col("a_c").alias("a"), F.col("b_c").alias("b"))
    )
    # those that share one are taken from its classes
    label = side.select("c", "g").distinct()
    some = rare.where("n > 1").select(F.explode(F.expr(
        "filter(flatten(transform(classes, x -> transform(classes, y -> struct(x as a, y as b)))), p -> p.a < p.b)")).alias("p"))
    sharing = (
        some.select("p.a", "p.b").distinct().join(label.select(F.col("c").alias("a"), F.col("g").alias("ga")), "a")
        .join(label.select(F.col("c").alias("b"), F.col("g").alias("gb")), "b").where("ga <> gb").select("a", "b")
    )
    pairs = listed.union(sharing).distinct()
    second = written(_confirmed(pairs, found, threshold, matches), "more-links")
    if second.limit(1).count():
        links = second.union(grouped.select(F.col("node").alias("a"), F.col("component").alias("b")))
        grouped = written(components(links), "components")

    labels = classes.join(grouped.withColumnRenamed("node", "c"), "c", "left").select(
        "digest", "doc_id", F.coalesce("component", "c").alias("g"))
    smallest = labels.groupBy("g").agg(F.min("doc_id").alias("component_id"))
    members = written(labels.join(written(smallest, "smallest"), "g").select("digest", "component_id"), "class-components")
    out = sketches.drop("signature").join(members, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "same"
    )
