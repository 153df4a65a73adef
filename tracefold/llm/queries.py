"""The registered queries of the document operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, langid, mixing, quality, secrets, simhash, suffix_dedup, superkmer, toxicity
from .common import documents

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(documents(spark, sf_dir), vocabulary_path())


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(documents(spark, sf_dir)).withColumnRenamed("digest", "text_sha256")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeated_bytes(documents(spark, sf_dir))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(documents(spark, sf_dir))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superkmer.remove_repeated_windows(documents(spark, sf_dir))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(documents(spark, sf_dir), labels=spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_mixing": op2_mixing,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_quality": op5_quality,
    "op6_langid": op6_langid,
    "op7_secrets": op7_secrets,
    "op8_simhash": op8_simhash,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_toxicity": op10_toxicity,
}

SQL: dict[str, str] = {
    "op4_suffix_dedup": r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS s FROM d, LATERAL (SELECT unnest(range(0, greatest(0, length(h) // 2 - 99))) AS i)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM w) WHERE r > 1),
parted AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS fresh FROM late),
numbered AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS part FROM parted),
spans AS (SELECT doc_id, part, min(i) AS a, max(i) + 100 AS b FROM numbered GROUP BY doc_id, part),
gaps AS (SELECT doc_id, part, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY part), 0) AS a, a AS b FROM spans
    UNION ALL SELECT doc_id, 1000000000, max(b), 1000000000 FROM spans GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY part) AS k FROM gaps JOIN d USING (doc_id) GROUP BY doc_id),
counts AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN counts USING (doc_id)
""",
    "op9_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, i, array_to_string(ws[i : i + 34], ' ') AS s FROM d, LATERAL (SELECT unnest(range(1, greatest(1, len(ws) - 33))) AS i)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY s) AS n FROM w) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, p FROM again, LATERAL (SELECT unnest(range(i, i + 35)) AS p)),
words AS (SELECT doc_id, p, ws[p] AS word FROM d, LATERAL (SELECT unnest(range(1, len(ws) + 1)) AS p)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS k FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
""",
    "op2_mixing": r"""
WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
stats AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS docs, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS party FROM sized GROUP BY source),
weighed AS (SELECT *, CASE party % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM stats),
filled AS (SELECT *, 1.5e0 * sum(source_size) OVER () AS total,
    coalesce(sum(2 * source_size) OVER (ORDER BY 2e0 * source_size / weight, party ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped_before,
    sum(weight) OVER (ORDER BY 2e0 * source_size / weight, party ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left FROM weighed),
level AS (SELECT arg_min((total - capped_before) / weight_left, 2e0 * source_size / weight) FILTER ((total - capped_before) / weight_left <= 2e0 * source_size / weight) AS level FROM filled),
targets AS (SELECT party, source, source_size, least(2e0 * source_size, weight * level) AS target FROM weighed, level),
seats AS (SELECT CAST(floor(sum(target) / 8 + 0.5) AS BIGINT) AS n FROM targets),
quotients AS (SELECT party, target / (2 * k - 1) AS q FROM targets, LATERAL (SELECT unnest(range(1, source_size * 2 // 8 + 1)) AS k)),
ranked AS (SELECT party, row_number() OVER (ORDER BY q DESC, party) AS r FROM quotients),
blocks AS (SELECT party, count(*) AS quota FROM ranked, seats WHERE r <= n GROUP BY party),
placed AS (SELECT doc_id, size, t.*, coalesce(quota, 0) AS quota,
    coalesce(sum(size) OVER (PARTITION BY t.party ORDER BY md5('mix|' || doc_id), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_at,
    8 * (CAST('0x' || substr(md5('mix|offset|' || t.party || '|0'), 1, 8) AS BIGINT) % greatest(1, CAST(ceil(source_size / 8e0) AS BIGINT))) AS begin_at
    FROM sized JOIN targets t ON sized.source IS NOT DISTINCT FROM t.source LEFT JOIN blocks b ON b.party = t.party)
SELECT doc_id, size, source_size, target, CAST((SELECT sum(greatest(0, least(begin_at + 8 * quota, start_at + k * source_size + size) - greatest(begin_at, start_at + k * source_size))) FROM unnest([0, 1, 2, 3]) AS laps(k)) AS BIGINT) AS taken
FROM placed
""",
    "op3_exact_dedup": r"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM d JOIN g USING (norm)
""",
}
