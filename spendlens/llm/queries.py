"""Registered queries of the training-data operators over the given tables, and the SQL that some are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.session import scratch_path

from . import clustering, decontamination, language_id, near_dedup, neighbours, packing, personal_data, phrases, token_files, toxicity, warc
from . import line_dedup as lines
from . import token_counts as counts
from .encoding import public_path
from .storage import prepared

TOKENIZER = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_path(TOKENIZER))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"), threshold=0.85, words=3)
    return found.drop("same")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "token-files")
    documents = _table(spark, sf_dir, "documents")
    manifest = token_files.write_tokens(documents, folder, public_path(TOKENIZER))
    return token_files.read_documents(manifest, folder, documents.schema["doc_id"].dataType.simpleString())


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1
    profiles = language_id.learn(documents.where(~held_out))
    return language_id.identify(documents.select("doc_id", "text"), profiles).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score"
    )


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "archives")
    manifest = warc.write_archives(_table(spark, sf_dir, "pages"), folder)
    return warc.read_archives(manifest, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.decontaminate(documents, _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "contamination.n_words", "contamination.n_hit",
        F.size("contamination.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("contamination.items", ","), 256).alias("items_sha256"),
        (F.col("contamination.n_hit") > 0).alias("contaminated"),
    )


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data.personal_data(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        *(F.size(personal_data.of_kind(F.col("base"), k)).cast("long").alias(f"n_{k}") for k in personal_data.KINDS),
        F.sha2(personal_data.joined_spans("base"), 256).alias("base_sha256"), personal_data.joined_spans("spans").alias("spans"),
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.line_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op9_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_neighbours(_table(spark, sf_dir, "embeddings"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return counts.token_counts(documents, public_path(TOKENIZER)).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mined_phrases(_table(spark, sf_dir, "documents").select("text", "lang"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.clusters(_table(spark, sf_dir, "embeddings"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2
    model = toxicity.learn(documents.where(~held_out), _table(spark, sf_dir, "labels").where(~held_out))
    return toxicity.scored(documents, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_token_files": op3_token_files,
    "op4_language_id": op4_language_id,
    "op5_warc": op5_warc,
    "op6_decontamination": op6_decontamination,
    "op7_personal_data": op7_personal_data,
    "op8_line_dedup": op8_line_dedup,
    "op9_learned_partitions": op9_learned_partitions,
    "op10_token_counts": op10_token_counts,
    "op11_phrases": op11_phrases,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_toxicity": op13_toxicity,
}

_OP8 = r"""
WITH line AS (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS position
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)
), keyed AS (
  SELECT doc_id, line, position,
    translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM line
), frequent AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT k.doc_id, k.line, k.position, f.key IS NOT NULL AND f.keeper <> k.doc_id AS gone
  FROM keyed k LEFT JOIN frequent f ON f.key = k.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY position) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

_OP5 = """
WITH page AS (
  SELECT page_id, coalesce(html, '') AS payload, strlen(coalesce(html, '')) AS payload_bytes FROM pages
), response AS (
  SELECT payload, max(page_id) AS response FROM page WHERE payload_bytes >= 1000 GROUP BY payload
)
SELECT p.page_id, p.payload_bytes, sha1(p.payload) AS payload_digest,
  CASE WHEN r.response IS NULL OR r.response = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN r.response <> p.page_id THEN r.response END AS refers_to
FROM page p LEFT JOIN response r ON r.payload = p.payload
"""

_OP6 = r"""
WITH word AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), item_window AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') AS words
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM item WHERE len(w) > 0)
), place AS (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM word, (SELECT DISTINCT n FROM item_window) WHERE len(w) >= n
), hit AS (
  SELECT l.doc_id, l.p, l.n, i.item_id
  FROM (SELECT doc_id, p, n, array_to_string(w[p : p + n - 1], ' ') AS words FROM place) l
  JOIN item_window i ON i.words = l.words AND i.n = l.n
), hit_word AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id
), hit_item AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
  sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM word d LEFT JOIN hit_word h USING (doc_id) LEFT JOIN hit_item i USING (doc_id)
"""

_OP11 = r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), word AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM piece
), total AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM word GROUP BY lang
), place AS (
  SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM word, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE len(w) >= m
), counted AS MATERIALIZED (
  SELECT lang, m, array_to_string(w[p : p + m - 1], ' ') AS phrase, count(*) AS c FROM place GROUP BY ALL HAVING count(*) >= 30
), candidate AS (
  SELECT *, string_split(phrase, ' ') AS w FROM counted WHERE m > 1
), cut AS (
  SELECT c.lang, c.phrase, c.c AS a, x.k, l.c AS l, r.c AS r, CAST((2000000::HUGEINT * c.c) // (l.c::HUGEINT + r.c) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM candidate) x JOIN candidate c ON c.lang = x.lang AND c.phrase = x.phrase
  JOIN counted l ON l.lang = x.lang AND l.phrase = array_to_string(x.w[1 : x.k], ' ')
  JOIN counted r ON r.lang = x.lang AND r.phrase = array_to_string(x.w[x.k + 1 :], ' ')
), best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM cut) WHERE place = 1
), inside AS (
  SELECT lang, array_to_string(w[s : s + q - 1], ' ') AS phrase, max(c) AS longer
  FROM (SELECT *, unnest(range(1, m - q + 2)) AS s FROM (SELECT *, unnest(range(2, m)) AS q FROM candidate)) GROUP BY ALL
), kept AS (
  SELECT b.* FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase
  WHERE i.longer IS NULL OR 100::HUGEINT * i.longer < 80::HUGEINT * b.a
)
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN total USING (lang)
WHERE rank <= 2000
"""


def _op12(k: int = 16, turns: int = 3, components: int = 64) -> str:
    steps = [f"""
whole AS MATERIALIZED (
  SELECT row_number() OVER () AS id, vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v FROM embeddings
  WHERE len(embedding) = {components} AND len([1 for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), centroid_0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS k, v FROM whole ORDER BY sha256('1:' || vec_id) LIMIT {k}
)"""]
    for turn in range(turns + 1):
        steps.append(f"""
near_{turn} AS MATERIALIZED (
  SELECT id, vec_id, v, k, d FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, k) AS place FROM (
      SELECT w.id, w.vec_id, w.v, c.k, list_sum([(w.v[i] - c.v[i]) * (w.v[i] - c.v[i]) for i in range(1, {components + 1})]) AS d
      FROM whole w, centroid_{turn} c
    )
  ) WHERE place = 1
)""")
        if turn < turns:
            steps.append(f"""
centroid_{turn + 1} AS MATERIALIZED (
  SELECT c.k, coalesce(u.v, c.v) AS v FROM centroid_{turn} c LEFT JOIN (
    SELECT k, list(m ORDER BY i) AS v FROM (
      SELECT k, i, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS m
      FROM (SELECT k, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM near_{turn}) GROUP BY k, i
    ) GROUP BY k
  ) u ON u.k = c.k
)""")
    return "WITH " + ",".join(steps) + f"""
SELECT n.vec_id, CAST(n.k AS INTEGER) AS cluster, CAST(n.d AS BIGINT) AS distance,
  CAST(sum(n.d) OVER (PARTITION BY n.k) AS BIGINT) AS cluster_inertia, CAST(sum(n.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string([CAST(x AS VARCHAR) for x in c.v], ',')) AS centroid_sha256
FROM near_{turns} n JOIN centroid_{turns} c ON c.k = n.k
"""


ORACLE_SQL = {
    "op5_warc": _OP5, "op6_decontamination": _OP6, "op8_line_dedup": _OP8, "op11_phrases": _OP11, "op12_centroid_clustering": _op12(),
}
