"""Registered queries of the training-data operators and their SQL oracles."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import licenses, quality_rules, token_counts, toxicity, vector_codes
from .exact_dedup import exact_groups
from .licenses import license_digest
from .mixing import mix
from .near_dedup import near_groups
from .packing import pack_documents
from .resampling import resample
from .secrets import secret_digest
from .substring_dedup import remove_repeats
from .target_resampling import target_resample


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(documents(spark, sf_dir))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"),
                          public_tokenizers.path("byte_bpe_50k.tiktoken"),
                          public_tokenizers.PATTERN)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir)).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select(
        "doc_id", "size", "source_size", "target", "taken", "position")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(documents(spark, sf_dir), labels(spark, sf_dir)).select(
        "doc_id", "n_grams", "importance", "gumbel", "kept")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_digest(documents(spark, sf_dir))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "n_removed", "kept_sha256")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir), k=3, percent=85).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = toxicity.fit_on(docs, labels(spark, sf_dir), usable=~held_out)
    return toxicity.score(docs, model).select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    trees = quality_rules.fit_rules(docs, labels(spark, sf_dir))
    return quality_rules.judge(docs, trees)


def op11_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return target_resample(documents(spark, sf_dir), benchmark).select(
        "doc_id", "n_features", "weight", "score", "rank")


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.token_counts(documents(spark, sf_dir),
                                       public_tokenizers.path("byte_bpe_50k.json"),
                                       public_tokenizers.PATTERN)
    return counts.select("doc_id", "n_bytes", "n_tokens",
                         (F.col("n_tokens") > 1024).alias("over_limit"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return coded.select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error",
                        F.lit(books.sha256()).alias("codebooks_sha256"))


QUERIES = {
    "op1_secrets": op1_secrets,
    "op2_packing": op2_packing,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_mixing": op4_mixing,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_licenses": op6_licenses,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_near_dedup": op8_near_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_quality_rules": op10_quality_rules,
    "op11_target_resampling": op11_target_resampling,
    "op12_token_counts": op12_token_counts,
    "op13_vector_codes": op13_vector_codes,
}

_OP3 = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h
  FROM documents
)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, h AS text_sha256
FROM d WINDOW g AS (PARTITION BY h)
"""

# Words with their places; a window is told by the digest of its words.
_OP7 = r"""
WITH words AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'),
                             lambda w: w <> '') AS w
  FROM documents
), windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h
  FROM words, unnest(range(1, len(w) - 33)) AS t(i)
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p
  FROM (SELECT *, count(*) OVER (PARTITION BY h) AS n FROM windows) WHERE n > 1
), places AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM words
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text
  FROM places ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
), counts AS (
  SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id) LEFT JOIN counts USING (doc_id)
"""

# Every pair that shares a shingle, and the closure of the links.
_OP8 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
           lambda w: w <> '') AS w
  FROM documents
), sets AS (
  SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 2], ' ')) AS s
  FROM words, unnest(range(1, greatest(len(w) - 1, least(len(w), 1) + 1))) AS t(i)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * c >= 85 * (x.n + y.n - c)
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT a AS doc_id, a AS other FROM both_ways
  UNION
  SELECT reach.doc_id, both_ways.b FROM reach JOIN both_ways ON reach.other = both_ways.a
), least_ids AS (
  SELECT doc_id, min(other) AS least FROM reach GROUP BY doc_id
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(least, doc_id) AS component_id,
       doc_id = coalesce(least, doc_id) AS kept
FROM words LEFT JOIN sizes USING (doc_id) LEFT JOIN least_ids USING (doc_id)
"""

_PHRASES = ", ".join(f"({p.split()!r}, '{label}')" for p, label in licenses.PHRASES)
_TEMPLATES = ", ".join(f"({sorted(set(t.split()))!r}, '{label}')"
                       for label, t in licenses.TEMPLATES)
# Every block against every template.
_OP6 = rf"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '{licenses.NO_WORD}'), lambda w: w <> '') AS w
  FROM documents
), places AS (
  SELECT doc_id, i - 1 AS start, label
  FROM words, (VALUES {_PHRASES}) AS p(phrase, label),
       unnest(range(1, len(w) - len(phrase) + 2)) AS t(i)
  WHERE w[i:i + len(phrase) - 1] = phrase
), blocks AS (
  SELECT doc_id, label, len(list_intersect(w[i + 1:i + {licenses.BLOCK}], wording))
                        / len(wording) AS share
  FROM words, (VALUES {_TEMPLATES}) AS t(wording, label),
       unnest(range(0, greatest(len(w) - {licenses.BLOCK - licenses.STRIDE} - 1, 0) + 1,
                    {licenses.STRIDE})) AS b(i)
  WHERE 100 * len(list_intersect(w[i + 1:i + {licenses.BLOCK}], wording))
        >= {licenses.CONTAINMENT} * len(wording)
), found AS (
  SELECT doc_id, label, start, NULL AS share, TRUE AS base FROM places
  UNION ALL SELECT doc_id, label, NULL, share, FALSE FROM blocks
), summed AS (
  SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) AS first_word,
         max(start) AS last_word, max(share) AS best,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM found GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word,
       last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0) END AS score
FROM words LEFT JOIN summed USING (doc_id)
"""

# A feature's crc32 bit by bit, lowest bit of each byte first; one digest a distinct feature.
_OP11 = rf"""
WITH texts AS (
  SELECT 'raw' AS kind, doc_id AS id, text FROM documents
  UNION ALL SELECT 'target', item_id, text FROM benchmark
), words AS (
  SELECT kind, id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '{licenses.NO_WORD}'), lambda w: w <> '') AS w
  FROM texts
), features AS (
  SELECT kind, id, array_to_string(w[i:i + n - 1], ' ') AS feature, count(*) AS c
  FROM words, unnest(range(1, len(w) + 1)) AS p(i), unnest([1, 2, 3]) AS o(n)
  WHERE i + n - 1 <= len(w) GROUP BY ALL
), distinct_features AS (
  SELECT feature, encode(feature)::BIT AS bits, octet_length(encode(feature)) AS n
  FROM (SELECT DISTINCT feature FROM features)
), buckets AS (
  SELECT feature, xor(list_reduce(
           list_transform(range(8 * n), lambda i: get_bit(bits, ((i // 8) * 8 + 7 - i % 8)::INT)::BIGINT),
           lambda crc, bit: xor(crc >> 1, 3988292384 * (xor(crc, bit) & 1)), 4294967295::BIGINT),
         4294967295) % 10000 AS bucket
  FROM distinct_features
), counts AS (
  SELECT bucket, coalesce(sum(c) FILTER (kind = 'raw'), 0)::BIGINT AS s,
         coalesce(sum(c) FILTER (kind = 'target'), 0)::BIGINT AS t
  FROM features JOIN buckets USING (feature) GROUP BY bucket
), gains AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM counts) + 10000)::DOUBLE
           / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM counts) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM counts
), weights AS (
  SELECT id AS doc_id, sum(c)::BIGINT AS n_features, sum(c * gain)::BIGINT AS weight
  FROM features JOIN buckets USING (feature) JOIN gains USING (bucket)
  WHERE kind = 'raw' GROUP BY id
), scored AS (
  SELECT id AS doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features,
         coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || id), 1, 8))
           ::UBIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM words LEFT JOIN weights ON id = doc_id WHERE kind = 'raw'
), ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n
  FROM scored WHERE n_words >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 5 * n // 100 THEN r END AS rank
FROM scored LEFT JOIN ranked USING (doc_id)
"""

# A round of vector codes: every part against every entry, then the entries' floored means.
_NEAREST = """
  SELECT vec_id, label, part, v, arg_min(entry, (d, entry)) AS entry, min(d) AS d
  FROM (SELECT vec_id, label, p.part, v, entry,
               list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT
               AS d
        FROM parts p JOIN {books} b ON p.part = b.part)
  GROUP BY vec_id, label, part, v
"""
_MOVED = """
  SELECT part, entry, list(m ORDER BY place) AS c FROM (
    SELECT part, entry, place, floor(sum(v[place]) / count(*))::BIGINT AS m
    FROM {codes}, unnest(range(1, len(v) + 1)) AS t(place) GROUP BY part, entry, place
  ) GROUP BY part, entry
  UNION ALL SELECT part, entry, c FROM {books} b
  WHERE NOT EXISTS (FROM {codes} a WHERE a.part = b.part AND a.entry = b.entry)
"""
_OP13 = f"""
WITH whole AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS w
  FROM embeddings
  WHERE len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (
  SELECT vec_id, label, part, w[part * (len(w) // 16) + 1:(part + 1) * (len(w) // 16)] AS v
  FROM whole, unnest(range(16)) AS t(part)
), books0 AS (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v AS c
  FROM parts WHERE vec_id IN (SELECT vec_id FROM whole ORDER BY vec_id LIMIT 64)
), codes0 AS MATERIALIZED ({_NEAREST.format(books="books0")}
), books1 AS MATERIALIZED ({_MOVED.format(codes="codes0", books="books0")}
), codes1 AS MATERIALIZED ({_NEAREST.format(books="books1")}
), books2 AS MATERIALIZED ({_MOVED.format(codes="codes1", books="books1")}
), codes2 AS MATERIALIZED ({_NEAREST.format(books="books2")}
), coded AS (
  SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code,
         sum(d)::BIGINT AS error
  FROM codes2 GROUP BY vec_id, label
), digest AS (
  SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS d FROM books2
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT d FROM digest) AS codebooks_sha256
FROM coded
"""

ORACLES = {"op3_exact_dedup": _OP3, "op6_licenses": _OP6, "op7_substring_dedup": _OP7,
           "op8_near_dedup": _OP8, "op11_target_resampling": _OP11, "op13_vector_codes": _OP13}
