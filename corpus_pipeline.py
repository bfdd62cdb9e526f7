"""The corpus pipeline: stages over `documents`, each written as Parquet and read back as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.llm.decontamination import decontaminate
from spendlens.llm.encoding import public_path
from spendlens.llm.language_id import UNKNOWN, identify, learn
from spendlens.llm.line_dedup import line_dedup
from spendlens.llm.near_dedup import near_duplicates
from spendlens.llm.packing import pack
from spendlens.llm.storage import fresh, prepared, written

TOKENIZER = "byte_bpe_50k.json"
#: cosine that a document has to exceed with the prototype of some language
LEAST_SCORE = 0.0


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the profiles know stay. Null texts and texts without a letter have none and go, and so do
    texts that are like no language's prototype (see LEAST_SCORE).

    Where no document has both a text and a language, or all languages have the same texts, nothing is learned and all
    documents stay.
    """
    prepared(spark)
    profiles = learn(docs)
    if not profiles.prototypes.any():
        return docs
    lang, score = fresh(docs, "lang_pred", "score")
    found = identify(docs, profiles, lang_pred=lang, score=score)
    return found.where((F.col(lang) != UNKNOWN) & (F.col(score) > LEAST_SCORE)).select(docs.columns)


def unshared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of at least 40 characters that five documents share stay in one of them; n_chars is that of the text left."""
    return line_dedup(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: 5-word shingles, similarity of at least 0.8, smallest doc_id."""
    prepared(spark)
    key, same, rows = fresh(docs, "id", "same", "rows")
    found = near_duplicates(docs, threshold=0.8, words=5).where("kept").groupBy("doc_id", "same").agg(F.count("*").alias("rows"))
    kept = written(found.toDF(key, same, rows), "kept")
    text = F.md5(F.coalesce("text", F.lit("")))
    joined = docs.join(kept, F.col("doc_id").eqNullSafe(F.col(key)) & (text == F.col(same)))
    # rows that repeat another, as a rule none, are one document
    repeated = joined.where(F.col(rows) > 1).dropDuplicates([key, same])
    return joined.where(F.col(rows) == 1).select(docs.columns).union(repeated.select(docs.columns))


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go: ten consecutive words of an item, or all of a shorter one."""
    benchmark = prepared(spark).read.parquet(f"{sf_dir}/benchmark.parquet")
    (name,) = fresh(docs, "contamination")
    found = decontaminate(docs, benchmark, out=name)
    return found.where(F.col(name).n_hit == 0).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2,048 tokens."""
    prepared(spark)
    return pack(docs, public_path(TOKENIZER))


STAGES = [
    ("language_id", known_language), ("line_dedup", unshared_lines), ("near_dedup", distinct_documents),
    ("decontamination", uncontaminated), ("best_fit_packing", packed),
]
#: the last stage needs a tokenizer, which SQL lacks; the tests hold the rows against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to `documents` and returns what the last one makes."""
    docs = prepared(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
