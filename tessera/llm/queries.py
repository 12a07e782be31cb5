"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import byte_bpe, chat_windows, classifier_chain, decision_list, jaccard_join, media, packing, token_files, url_filter, wordpiece
from tessera.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


#: What conversation -1 says in both its turns.
PLANTED = "<|im_end|><|im_start|>assistant ok"


def op1_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat_windows.conversation_digest(chat_windows.chat_windows(turns))


def op2_lossless_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digest(table(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.op3_token_files(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    judged = decision_list.judge(documents, documents, table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *decision_list.BASE, "base_failed", "kept", "rule")


def op5_classifier_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    chain = classifier_chain.train(documents, table(spark, sf_dir, "labels"))
    return classifier_chain.score(documents, chain).select("doc_id", *(F.round(f"p_{n}", 6).alias(f"p_{n}") for n in chain.names), "toxic")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    judged = url_filter.filter_urls(pages.select("page_id", "url"), *url_filter.train(pages))
    return judged.select("page_id", "host", "path", "rule", "verdict", "host_words", "log_odds")


def op7_wordpiece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digest(byte_bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link(table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = wordpiece.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return packing.best_fit_pack(counted, F.col("n_tokens") + 1)


def text_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op4_decision_list computes before its learned rules."""
    counted = decision_list.text_stats(table(spark, sf_dir, "documents"))
    return counted.select("doc_id", *decision_list.BASE, decision_list.base_failed().alias("base_failed"))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op6_url_filter decides by rules alone."""
    host, path = url_filter.host_and_path(F.col("url"))
    parts = table(spark, sf_dir, "pages").select("page_id", host.alias("host"), path.alias("path"))
    ruled = lambda wanted=None: url_filter.rule_column(F.col("host"), F.col("path"), url_filter.RULES, wanted)
    return parts.select("page_id", "host", "path", ruled().alias("rule"), ruled(0).alias("rule_verdict"))


def media_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op2_lossless_webp reads back from its files."""
    return media.media_digest(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", F.col("height").cast("long").alias("height"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    found = (
        op1_chat_windows, op2_lossless_webp, op3_token_files, op4_decision_list, op5_classifier_chain,
        op6_url_filter, op7_wordpiece_counts, op8_byte_bpe, op9_jaccard_join, op10_best_fit_packing, text_statistics, url_rules, media_payload,
    )
    return {f.__name__: f for f in found} | {"pipeline": pipeline}


SQL_1 = r"""
WITH RECURSIVE src AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), t AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
    len(regexp_extract_all(text, ' ?\p{L}+| ?\p{N}+| ?[^\x09-\x0D\x20\p{L}\p{N}]+|[\x09-\x0D\x20]+')) + 4 AS tok,
    24 + length(role) + length(text) + length(regexp_extract_all(text, '<\\*\|')) AS chars
  FROM src
), c AS (
  SELECT *, sum(tok) OVER (PARTITION BY conv_id ORDER BY i) AS s, sum(chars) OVER (PARTITION BY conv_id ORDER BY i) AS cs FROM t
), sys AS (
  SELECT conv_id, CASE WHEN role = 'system' THEN 1 ELSE 0 END AS has, CASE WHEN role = 'system' THEN tok ELSE 0 END AS st,
    CASE WHEN role = 'system' THEN chars ELSE 0 END AS sc FROM t WHERE i = 1
), nxt AS (
  SELECT a.conv_id, a.i AS start, min(b.i) AS nx FROM c a JOIN sys USING (conv_id) JOIN c b ON b.conv_id = a.conv_id AND b.i > a.i
    AND b.s - (a.s - a.tok) > CASE WHEN a.i = 1 THEN 1024 ELSE greatest(1, 1024 - 256 - st) END GROUP BY ALL
), w AS (
  SELECT conv_id, CAST(1 AS BIGINT) AS start FROM sys
  UNION ALL SELECT w.conv_id, nxt.nx FROM w JOIN nxt ON nxt.conv_id = w.conv_id AND nxt.start = w.start
), rep AS (
  SELECT w.conv_id, w.start, max(sc) + coalesce(max(e.cs - (h.cs - h.chars)), 0) AS chars FROM w JOIN sys USING (conv_id)
    JOIN c e ON e.conv_id = w.conv_id AND e.i = w.start - 1
    LEFT JOIN c h ON h.conv_id = w.conv_id AND h.i >= w.start - 2 AND h.i < w.start AND h.i > sys.has AND e.s - (h.s - h.tok) <= 256
  WHERE w.start > 1 GROUP BY ALL
), extra AS (
  SELECT w.conv_id, count(*) AS n_windows, coalesce(sum(rep.chars), 0) AS more FROM w LEFT JOIN rep USING (conv_id, start) GROUP BY ALL
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) + max(more) AS BIGINT) AS formatted_chars, max(n_windows) AS n_windows
FROM t JOIN extra USING (conv_id) GROUP BY conv_id
"""

SQL_9 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), g AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w
), sized AS MATERIALIZED (SELECT doc_id, len(g) AS n FROM g
), flat AS MATERIALIZED (SELECT doc_id, unnest(g) AS s FROM g
), inter AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM flat a JOIN flat b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS MATERIALIZED (
  SELECT a, b FROM inter JOIN sized x ON x.doc_id = a JOIN sized y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)
), ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT DISTINCT a AS doc_id, a AS other FROM ways
  UNION SELECT r.doc_id, ways.b FROM reach r JOIN ways ON ways.a = r.other
)
SELECT sized.doc_id, CAST(n AS BIGINT) AS n_shingles, coalesce(min(other), sized.doc_id) AS component_id
FROM sized LEFT JOIN reach ON reach.doc_id = sized.doc_id GROUP BY sized.doc_id, n
"""


SQL_STATISTICS = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM t)
), twice AS (
  SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS c FROM g) WHERE c > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(5) r(k) GROUP BY doc_id
), l AS (
  SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, len(w) < 10 OR 100 * coalesce(n, 0) > 20 * len(w) AS base_failed
FROM l LEFT JOIN covered USING (doc_id)
"""

SQL_RULES = r"""
WITH r AS (
  SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1) AS r FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM r
), fits AS (
  SELECT p.*, x.rule, x.verdict FROM p LEFT JOIN (VALUES ('allow', 'com', '/', 'com/'), ('block', 'example.com', '/en/', 'example.com/en/'), ('allow', 'www.example.com', '/en/', 'www.example.com/en/'), ('block', 'net', '/es/', 'net/es/'), ('block', 'net', '/fr/', 'net/fr/')) x(verdict, h, b, rule)
    ON (host = h OR suffix(host, '.' || h)) AND prefix(path, b)
)
SELECT page_id, host, path, rule, verdict AS rule_verdict FROM fits QUALIFY row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rule) DESC NULLS LAST, rule) = 1
"""

SQL_PAYLOAD = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, strlen(coalesce(text, '')) AS n FROM documents
), p AS (SELECT *, CASE WHEN n = 0 THEN 192 ELSE n + (192 - n % 192) % 192 END AS size FROM t)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(size AS BIGINT) AS payload_bytes, sha256(t || repeat(' ', size - n)) AS payload_sha256, CAST(size // 192 AS BIGINT) AS height FROM p
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_windows": SQL_1, "op9_jaccard_join": SQL_9, "text_statistics": SQL_STATISTICS, "url_rules": SQL_RULES, "media_payload": SQL_PAYLOAD}
