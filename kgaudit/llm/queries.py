"""The registered queries of this package and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from kgaudit.llm import (
    archive, exact_dedup, fingerprints, importance, language_id, mixing, near_dedup, packing, prefix_trie, quality, sentence_pieces, tokenizing, toxicity,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@query("op2_exact_dedup", f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
FROM t JOIN g USING (norm)
""")
def op2(spark, sf_dir):
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"), keep="largest")


@query("op4_warc_archive", """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages),
g AS (SELECT body, max(page_id) AS keep_id FROM p GROUP BY body)
SELECT page_id, payload_bytes, sha1(body) AS payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> keep_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> keep_id THEN keep_id END AS refers_to
FROM p JOIN g USING (body)
""")
def op4(spark, sf_dir):
    return archive.archive_digest(table(spark, sf_dir, "pages"))


@query("op6_source_mixing", r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS no FROM d GROUP BY source),
w AS (SELECT source, source_size, (no - 1) % 3 + 1 AS weight, 3 * source_size AS most, no FROM s),
r AS (
  SELECT source_size, weight, most, no, most / weight AS ratio,
    sum(source_size) OVER () AS words, sum(weight) OVER () AS weights,
    coalesce(sum(most) OVER (ORDER BY most / weight, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_words,
    coalesce(sum(weight) OVER (ORDER BY most / weight, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_weight
  FROM w),
l AS (SELECT min_by((words - full_words)::DOUBLE / (weights - full_weight)::DOUBLE, ratio) AS share FROM r WHERE weight * ((words - full_words) / (weights - full_weight)) <= most),
t AS (SELECT source, source_size, least(weight * coalesce(share, 0), most::DOUBLE) AS target FROM w LEFT JOIN l ON true),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS need,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY key, d.doc_id, d.size ROWS UNBOUNDED PRECEDING)::BIGINT - d.size AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CASE WHEN size = 0 THEN 0 ELSE (need // source_size) * size + greatest(least(need % source_size - start, size), 0) END::BIGINT AS taken
FROM p
""")
def op6(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


@query("op7_fingerprints")
def op7(spark, sf_dir):
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


@query("op1_token_counts")
def op1(spark, sf_dir):
    return tokenizing.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op10_packing")
def op10(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op5_near_dedup")
def op5(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@query("op9_quality_classifier")
def op9(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.quality_scores(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


@query("op8_language_id")
def op8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return language_id.languages(docs, language_id.profiles(docs))


@query("op3_toxicity")
def op3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.toxicity_scores(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the CRC-32 of a text's UTF-8 bytes: a fold over byte values, each followed by eight bit steps."""
    raw = f"hex(encode({text}))"
    steps = f"flatten([[('0x' || substr({raw}, 2 * i - 1, 2))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] FOR i IN range(1, length({raw}) // 2 + 1)])"
    step = "CASE WHEN b >= 0 THEN xor(a, b) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {steps}), lambda a, b: {step}), 4294967295)"


@query("op11_conversation_trie", f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, {crc32_sql("conv_id::VARCHAR")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (
  SELECT c.conv_id, 0 AS part, pos, role, text FROM c JOIN t ON t.conv_id = c.base AND pos <= h
  UNION ALL SELECT c.conv_id, 1, pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND pos > h),
l AS (SELECT conv_id, list({{'r': role, 't': text}} ORDER BY part, pos) AS turns FROM r GROUP BY conv_id),
s AS (SELECT c.conv_id, coalesce(turns, []) AS turns FROM c LEFT JOIN l USING (conv_id)),
p AS (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS depth FROM s),
n AS (
  SELECT turns[1:depth] AS node, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    string_agg(CASE WHEN len(turns) = depth THEN conv_id::VARCHAR END, ',' ORDER BY conv_id) AS ends
  FROM p GROUP BY turns[1:depth]),
k AS (SELECT node[1:depth - 1] AS node, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
a AS (
  SELECT n.*, coalesce(k.n_children, 0) AS n_children,
    CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * octet_length(encode(n.node[depth].t)) END AS saved
  FROM n LEFT JOIN k ON n.node = k.node),
u AS (SELECT node, saved, n_children, unnest(range(0, depth + 1)) AS d FROM a),
b AS (SELECT node[1:d] AS node, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM u GROUP BY 1)
SELECT a.conv_id, a.depth, q.conv_id AS parent_conv_id, a.n_convs, a.n_children, b.n_leaves, b.saved_tokens, sha256(coalesce(a.ends, '')) AS ends_sha256
FROM a JOIN b ON a.node = b.node LEFT JOIN n q ON a.depth > 0 AND q.node = a.node[1:a.depth - 1]
""")
def op11(spark, sf_dir):
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


@query("op12_importance_resampling", rf"""
WITH d AS (SELECT doc_id, text, false AS aim FROM documents UNION ALL SELECT -1, text, true FROM benchmark),
w AS (
  SELECT doc_id, aim, row_number() OVER () AS no,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM d),
f AS (
  SELECT no, aim, unnest(list_concat(words, [words[i] || ' ' || words[i + 1] FOR i IN range(1, len(words))])) AS feature FROM w),
v AS (SELECT feature, {crc32_sql("feature")} % 10000 AS bucket FROM (SELECT DISTINCT feature FROM f)),
g AS (SELECT no, aim, bucket FROM f JOIN v USING (feature)),
b AS (
  SELECT bucket, count(*) FILTER (NOT aim)::DOUBLE AS s, count(*) FILTER (aim)::DOUBLE AS t FROM g GROUP BY bucket),
m AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM b),
e AS (SELECT bucket, floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000))))::BIGINT AS gain FROM b, m),
x AS (SELECT no, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM g JOIN e USING (bucket) WHERE NOT aim GROUP BY no),
y AS (
  SELECT doc_id, len(words) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    ('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT::DOUBLE AS h
  FROM w LEFT JOIN x USING (no) WHERE NOT aim),
z AS (SELECT doc_id, n_words, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM y),
o AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS place, sum((n_words >= 20)::INT) OVER () AS n FROM z)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 25 * n // 100 THEN place END AS rank FROM o
""")
def op12(spark, sf_dir):
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_sentence_pieces")
def op13(spark, sf_dir):
    return sentence_pieces.piece_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)
