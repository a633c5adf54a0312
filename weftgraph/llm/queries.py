"""One query per operator over its whole table, with production parameters, and their SQL.

Without SQL: op2 and op10 (a tokenizer's ids), op9 (BM25 retrieval) and op8_license_notices (runs of any
length); tests/llm holds them against
the library and against brute force.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, licenses, line_dedup, mixing, near_dup, quality, token_count, token_records, warc

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_read(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "source", "mix_block", "mix_key")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(_read(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read_warc(warc.write_warc(_read(spark, sf_dir, "pages")), payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_conversations(rows.unionByName(own)))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_rules(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_read(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_read(spark, sf_dir, "documents"))


def op8_license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find_notices(_read(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op10_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_records.write_token_records(_read(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))
    return token_records.read_token_records(manifest)


QUERIES = {f.__name__: f for f in (op1_mixing, op2_token_counts, op3_line_dedup, op4_warc, op5_chat_format, op6_quality_rules, op7_minhash_near_dup, op8_license_scan, op9_decontamination, op10_token_records, op8_license_notices)}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"'[^\x20\x09-\x0D]+'"
_SPACES = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_ESCAPED = r"replace(replace({0}, '\', '\\'), '<|', '<\|')"
_KEY = "('0x' || substr(md5(concat_ws('|', '17', source, {block}::VARCHAR, coalesce(doc_id::VARCHAR, 'null'))), 1, 15))::BIGINT"


def _quoted(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _mixing_sql() -> str:
    block_key, next_key = _KEY.format(block="mix_block"), _KEY.format(block="blocks")
    return f"""
WITH n AS (SELECT doc_id, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), {_WORD})) AS w, (strlen(coalesce(text, '')) + 3) // 4 AS b,
  CASE WHEN w > 0 THEN greatest(w, b) ELSE 0 END AS t FROM documents),
s AS (SELECT source, sum(t)::BIGINT AS tokens FROM n GROUP BY 1 HAVING sum(t) > 0),
total AS (SELECT sum(tokens)::BIGINT AS budget, count(*) AS n, min(tokens) AS least FROM s),
grid AS (SELECT i / 65536.0::DOUBLE AS a, i FROM range(0, 65537) r(i)),
z AS (SELECT i, a, sum(exp(ln(tokens::DOUBLE) * a)) AS z, sum(exp(ln(tokens::DOUBLE) * a) * ln(tokens::DOUBLE)) AS sl FROM grid, s GROUP BY i, a),
e AS (SELECT max(i) AS i FROM z, total WHERE ln(z) - a * sl / z >= 0.95 * ln(n) OR i = 0),
p AS (SELECT min(i) AS i FROM z, total WHERE pow(least, a - 1) * budget / z <= 4.0 OR i = 65536),
w AS (SELECT source, tokens, exp(ln(tokens::DOUBLE) * z.a) / z.z AS weight FROM s, z WHERE z.i = (SELECT greatest(e.i, p.i) FROM e, p)),
q AS (SELECT source, tokens, floor(weight * budget)::BIGINT AS quota FROM w, total),
bl AS (SELECT source, quota // tokens AS blocks, quota % tokens AS rest FROM q),
k AS (SELECT n.source, rest, {next_key} AS mix_key, sum(t) AS t FROM n JOIN bl USING (source) GROUP BY 1, 2, 3),
c AS (SELECT source, max(mix_key) AS cut FROM (SELECT *, sum(t) OVER (PARTITION BY source ORDER BY mix_key) - t AS before FROM k) WHERE before < rest GROUP BY 1),
o AS (SELECT doc_id, source, unnest(range(0, blocks + 1)) AS mix_block, blocks, cut FROM n JOIN bl USING (source) LEFT JOIN c USING (source))
SELECT doc_id, source, mix_block, {block_key} AS mix_key FROM o WHERE mix_block < blocks OR {block_key} <= cut"""


def _quality_sql() -> str:
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {_WORD}) AS words,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, {_WORD})) AS lines FROM documents),
g AS (SELECT doc_id, i, array_to_string(words[i:i+7], ' ') AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM d WHERE len(words) >= 8)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM r) GROUP BY 1),
m AS (SELECT d.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
  coalesce(c.n, 0) AS n_repeat_words, length(regexp_replace(text, '[^!]+', '', 'g')) AS shout,
  len(list_filter(words, lambda x: list_contains({_quoted(quality.STOP_WORDS)}, x))) AS stop, len(lines) AS n_lines
  FROM d LEFT JOIN c USING (doc_id)),
v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, greatest(n_words, 1)::DOUBLE AS w FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND word_chars / w BETWEEN 2 AND 20 AND n_symbols / w <= 0.1
  AND shout / w <= 0.3 AND stop / w >= 0.06 AND n_dup_lines / greatest(n_lines, 1)::DOUBLE <= 0.5 AS kept FROM v"""


def _license_sql() -> str:
    values = ", ".join(f"('{k}', {_quoted(licenses.bigrams_of(t))})" for k, t in licenses.TEMPLATES.items())
    return f"""
WITH t(license, grams) AS (VALUES {values}),
l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines, coalesce(text, '') AS text FROM documents),
u AS (SELECT doc_id, unnest(range(1, len(lines) + 1)) AS unit, unnest(lines) AS raw FROM l UNION ALL SELECT doc_id, 0, text FROM l WHERE len(lines) > 1),
w AS (SELECT doc_id, unit, regexp_extract_all(lower(raw), '[a-z0-9]+') AS w FROM u),
g AS (SELECT doc_id, unit, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS own FROM w WHERE len(w) > 1),
x AS (SELECT doc_id, unit, license, 2.0::DOUBLE * len(list_intersect(own, grams)) / (len(own) + len(grams)) AS dice FROM g, t WHERE len(own) BETWEEN len(grams) * 0.6 AND len(grams) * 1.6)
SELECT doc_id, unit::BIGINT AS unit, license, round(dice, 6) AS dice FROM x WHERE dice >= 0.8"""


ORACLE_SQL = {
    "op1_mixing": _mixing_sql(),
    "op3_line_dedup": f"""
WITH l AS (SELECT doc_id, unnest(x) AS line, unnest(range(1, len(x) + 1)) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
k AS (SELECT *, translate(trim(line, {_SPACES}), '{_UPPER}', '{_LOWER}') AS key FROM l),
f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY 1 HAVING min(doc_id) < max(doc_id)),
d AS (SELECT doc_id, pos, line, first IS NOT NULL AND first <> doc_id AS dropped FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256 FROM d GROUP BY 1""",
    "op4_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY 1)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to FROM p LEFT JOIN f ON p.d = f.d AND n >= 100""",
    "op5_chat_format": f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(23 + length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")}))::BIGINT AS formatted_chars
FROM c GROUP BY 1""",
    "op6_quality_rules": _quality_sql(),
    "op7_minhash_near_dup": f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), {_WORD}) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM x JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)""",
    "op8_license_scan": _license_sql(),
}
