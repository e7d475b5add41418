"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.llm.bpe import with_bpe
from grainmill.llm.line_dedup import drop_common_lines
from grainmill.llm.media import with_media_digest
from grainmill.llm.mixture import mix_amounts
from grainmill.llm.quality_classifier import score_quality
from grainmill.llm.quality_rules import with_repetition_rules
from grainmill.llm.repeated_bytes import mark_repeats
from grainmill.llm.sections import count_section_tokens
from grainmill.llm.simhash import near_duplicate_groups
from grainmill.llm.text import modest_batches
from grainmill.llm.toxicity import score_toxicity

BPE_FILE = "byte_bpe_50k.json"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    modest_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def sha256(text: str) -> F.Column:
    return F.sha2(F.col(text), 256)


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_media_digest(documents(spark, sf_dir).select("doc_id", "text"))
    names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    return docs.select("doc_id", *(f"media.{n}" for n in names))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = score_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scores.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op3_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_repeats(documents(spark, sf_dir).select("doc_id", "text"), spans=False)


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    amounts, sources = mix_amounts(documents(spark, sf_dir), F.array("source"))
    per_row = amounts.withColumn("source", F.col("sources")[0])
    joined = per_row.join(F.broadcast(sources.withColumnRenamed("source", "name")), F.col("source").eqNullSafe(F.col("name")))
    return joined.select("doc_id", "size", "source_size", "target", "taken")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = drop_common_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return docs.select("doc_id", "lines.n_lines", "lines.n_dropped", sha256("lines.text").alias("kept_sha256"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each line of each document; a token across lines counts for the line of most of its bytes."""
    sections = count_section_tokens(documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path(BPE_FILE))
    return sections.select("doc_id", "section.section", "section.from", "section.to", F.col("section.n_tokens").cast("long").alias("n_tokens"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = score_toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scores.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_duplicate_groups(documents(spark, sf_dir))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_bpe(documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path(BPE_FILE))
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return docs.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), sha256("decoded").alias("decoded_sha256"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_repetition_rules(documents(spark, sf_dir).select("doc_id", "text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return docs.select("doc_id", *(f"rules.{n}" for n in names))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_media, op2_quality_classifier, op3_repeated_bytes, op4_source_mix, op5_line_dedup, op6_token_counts, op7_toxicity, op8_simhash, op9_bpe, op10_quality_rules)
}

_WORD = r"[^\x20\x09-\x0D]+"

_TEXTS = "texts AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents)"


def _covered(n: int) -> str:
    """SQL for the flags of words in windows of n words that the row holds more than once."""
    window = " || ' ' || ".join(["word", *(f"lead(word, {k}) OVER here" for k in range(1, n))])
    return f"""
        grams_{n} AS (SELECT row, i, chars, {window} AS gram FROM words WINDOW here AS (PARTITION BY row ORDER BY i)),
        again_{n} AS (SELECT row, i, chars, gram IS NOT NULL AND count(*) OVER (PARTITION BY row, gram) > 1 AS again FROM grams_{n}),
        inside_{n} AS (SELECT row, chars, bool_or(again) OVER (PARTITION BY row ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS inside FROM again_{n}),
        cover_{n} AS (SELECT row, count(*) FILTER (WHERE inside) AS n, coalesce(sum(chars) FILTER (WHERE inside), 0) AS chars FROM inside_{n} GROUP BY row),"""


ORACLE_SQL: dict[str, str] = {
    "op5_line_dedup": r"""
        WITH lines AS (
            SELECT doc_id, row, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
            FROM (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS row FROM documents)
        ), keyed AS (
            SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM lines
        ), common AS (
            SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT row) >= 10
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE key IN (SELECT key FROM common)) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE key NOT IN (SELECT key FROM common)), '')) AS kept_sha256
        FROM keyed GROUP BY row, doc_id""",
    "op4_source_mix": rf"""
        WITH RECURSIVE sized AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size,
                   md5('42:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS key
            FROM documents
        ), sources AS (
            SELECT source, sum(size)::BIGINT AS source_size,
                   [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3] AS weight
            FROM sized GROUP BY source
        ), filled(round, source, source_size, weight, capped) AS (
            SELECT 0, source, source_size, weight::DOUBLE, FALSE FROM sources
            UNION ALL
            SELECT round + 1, source, source_size, weight,
                   capped OR (1.5 * (sum(source_size) OVER ()) - coalesce(sum(2 * source_size) FILTER (WHERE capped) OVER (), 0)) * weight
                             / sum(weight) FILTER (WHERE NOT capped) OVER () > 2 * source_size
            FROM filled WHERE round < (SELECT count(*) FROM sources)
        ), targets AS (
            SELECT source, source_size,
                   CASE WHEN capped THEN 2.0 * source_size
                        ELSE (1.5 * (sum(source_size) OVER ()) - coalesce(sum(2 * source_size) FILTER (WHERE capped) OVER (), 0)) * weight
                             / sum(weight) FILTER (WHERE NOT capped) OVER () END AS target
            FROM filled WHERE round = (SELECT count(*) FROM sources)
        ), quotas AS (
            SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target + 0.5)::BIGINT // source_size END AS whole,
                   CASE WHEN source_size = 0 THEN 0 ELSE floor(target + 0.5)::BIGINT % source_size END AS rest
            FROM targets
        ), keys AS (
            SELECT source, key, sum(size) AS size, count(*) AS n,
                   coalesce(sum(sum(size)) OVER (PARTITION BY source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
            FROM sized WHERE size > 0 GROUP BY source, key
        )
        SELECT s.doc_id, s.size, q.source_size, q.target::DOUBLE AS target,
               (q.whole * s.size + CASE WHEN k.before + k.size <= q.rest AND NOT (k.before < q.rest AND q.rest <= k.before + k.size) THEN s.size
                    WHEN k.before < q.rest THEN least(s.size, (q.rest - k.before) // k.n) ELSE 0 END)::BIGINT AS taken
        FROM sized s JOIN quotas q ON s.source IS NOT DISTINCT FROM q.source
        LEFT JOIN keys k ON s.source IS NOT DISTINCT FROM k.source AND s.key = k.key""",
    "op10_quality_rules": rf"""
        WITH {_TEXTS}, listed AS (SELECT row, regexp_extract_all(text, '{_WORD}') AS list, string_split(text, chr(10)) AS lines, text FROM texts),
        words AS (SELECT row, word, i, length(word) AS chars FROM (SELECT row, unnest(list) AS word, generate_subscripts(list, 1) AS i FROM listed)),
        sizes AS (SELECT row, count(*) AS n_words, sum(chars) AS word_chars FROM words GROUP BY row),
        {_covered(5)} {_covered(7)} {_covered(10)}
        lined AS (SELECT row, line, row_number() OVER (PARTITION BY row, line ORDER BY i) > 1 AS later FROM (SELECT row, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM listed)),
        doubled AS (SELECT row, count(*) AS n, sum(length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g'))) AS chars FROM lined WHERE later AND regexp_matches(line, '{_WORD}') GROUP BY row),
        measured AS (
            SELECT t.doc_id, coalesce(s.n_words, 0) AS n_words, coalesce(s.word_chars, 0)::BIGINT AS word_chars, length(t.text) - length(regexp_replace(t.text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
                   coalesce(d.n, 0) AS n_dup_lines, coalesce(a.n, 0) AS n_repeat_words, coalesce(d.chars, 0) AS line_chars, coalesce(a.chars, 0) AS c5, coalesce(b.chars, 0) AS c7, coalesce(c.chars, 0) AS c10
            FROM texts t LEFT JOIN sizes s USING (row) LEFT JOIN doubled d USING (row) LEFT JOIN cover_5 a USING (row) LEFT JOIN cover_7 b USING (row) LEFT JOIN cover_10 c USING (row)
        ), judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM measured)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT base_failed AND line_chars <= 0.30 * word_chars AND c5 <= 0.30 * word_chars AND c7 <= 0.25 * word_chars AND c10 <= 0.20 * word_chars AS kept
        FROM judged""",
    "op3_repeated_bytes": rf"""
        WITH {_TEXTS}, coded AS (SELECT row, doc_id, hex(encode(text)) AS bytes, strlen(text) AS n FROM texts),
        places AS (SELECT row, bytes, n, unnest(range(n)) AS i FROM coded),
        strings AS (SELECT row, i, substr(bytes, 2 * i + 1, 2) AS byte, CASE WHEN i + 200 <= n THEN md5(substr(bytes, 2 * i + 1, 400)) END AS string FROM places),
        again AS (SELECT string FROM strings WHERE string IS NOT NULL GROUP BY string HAVING count(*) > 1),
        started AS (SELECT row, i, byte, string IS NOT NULL AND string IN (SELECT string FROM again) AS starts FROM strings),
        gone AS (SELECT row, i, byte, bool_or(starts) OVER (PARTITION BY row ORDER BY i ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS gone FROM started),
        edges AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY row ORDER BY i), FALSE) AS opens FROM gone),
        cut AS (SELECT row, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE opens) AS n_spans, string_agg(byte, '' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM edges GROUP BY row)
        SELECT c.doc_id, c.n::BIGINT AS n_bytes, coalesce(x.n_removed, 0) AS n_removed, coalesce(x.n_spans, 0) AS n_spans, sha256(unhex(coalesce(x.kept, ''))) AS kept_sha256
        FROM coded c LEFT JOIN cut x USING (row)""",
}
