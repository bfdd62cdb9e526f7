"""Drops lines that occur in many documents, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import fresh, written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WHITE = " \t\n\x0b\x0c\r"


def _digest(line: Column, min_length: int) -> Column:
    """128 bits of the line's key: without white space at its ends, A-Z in lower case; null for keys too short to count."""
    trimmed = F.btrim(line, F.lit(WHITE))
    return F.when(F.length(trimmed) >= min_length, F.unhex(F.md5(F.translate(trimmed, _UPPER, _LOWER))))


def line_dedup(
    documents: DataFrame, min_documents: int = 5, min_length: int = 40, doc_id: str = "doc_id", text: str = "text",
    n_lines: str = "n_lines", n_dropped: str = "n_dropped",
) -> DataFrame:
    """Removes lines whose key has `min_length` code points and occurs in `min_documents` documents; adds line counts.

    The document with the largest id keeps its lines. Line hashes are exploded (each once per document), counted with
    map-side combining, and hashes and the frequent ones are written to the shared folder; lines are then joined by hash,
    dropped positions are gathered per document, and the text is put together from the positions that stay.

    A null or empty text is one empty line and comes back as an empty text. Every row counts as a document, also when it
    repeats another; rows with equal ids and texts lose the same lines, and all rows with the largest id keep theirs.
    A null id is below all others. Other columns pass through; ones named as the counts are replaced. An empty table gives
    an empty result.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.split(whole, "\n", -1)
    # written, so that every line is hashed once
    keyed = written(documents.select(
        F.col(doc_id).alias("id"), F.md5(whole).alias("same"),
        F.transform(lines, lambda line: _digest(line, min_length)).alias("digests"),
    ), "line-digests")
    held = keyed.select("id", F.explode(F.array_distinct("digests")).alias("digest")).where("digest is not null")
    frequent = written(
        held.groupBy("digest").agg(F.count("*").alias("n"), F.max("id").alias("keeper"))
        .where(F.col("n") >= min_documents).drop("n"),
        "frequent-lines",
    )
    placed = keyed.select("id", "same", F.posexplode("digests").alias("position", "digest")).where("digest is not null")
    own_id, own_same, gone = fresh(documents, "id", "same", "gone")
    dropped = (
        placed.join(frequent, "digest").where(~F.col("id").eqNullSafe(F.col("keeper")))
        .groupBy("id", "same").agg(F.collect_set("position").alias("gone"))
        .select(F.col("id").alias(own_id), F.col("same").alias(own_same), F.col("gone").alias(gone))
    )
    # the lines are bound once, as what stands inside a lambda function is computed for each element
    stay = F.get(F.transform(F.array(lines), lambda z: F.array_join(
        F.transform(
            F.array_except(F.sequence(F.lit(0), F.size(z) - 1), F.col(gone)), lambda p: F.element_at(z, p + 1)), "\n")), F.lit(0))
    return (
        documents.join(dropped, F.col(doc_id).eqNullSafe(F.col(own_id)) & (F.md5(whole) == F.col(own_same)), "left")
        .withColumns({
            n_lines: F.size(lines).cast("long"),
            n_dropped: F.coalesce(F.size(gone), F.lit(0)).cast("long"),
            text: F.when(F.col(gone).isNull(), whole).otherwise(stay),
        })
        .drop(own_id, own_same, gone)
    )
