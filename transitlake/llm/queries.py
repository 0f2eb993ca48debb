"""The registered queries of these operators, and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, contamination, conversations, divergence, language, licenses, quality, simhash, suffixes, suffixtree, tokenfiles, toxicity, warc
from .common import importable, scratch, table


def vocabulary() -> str:
    """TRANSITLAKE_BPE names the vocabulary file; else the installed one."""
    if path := os.environ.get("TRANSITLAKE_BPE"):
        return path
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    headers = warc.resolved(warc.read_archives(spark, path))
    return headers.select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS d FROM p),
b AS (SELECT page_id, payload_bytes, d,
  array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform(range(4), lambda j:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST(('0x' || substr(d, CAST(5 * i + 1 AS INT), 5)) AS BIGINT) >> (15 - 5 * j)) & 31 AS INT), 1)), '')), '') AS payload_digest FROM h),
f AS (SELECT d, min(page_id) AS first FROM h GROUP BY d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM b JOIN f USING (d)
"""


def token_digests(docs: DataFrame, path: str) -> DataFrame:
    done = bpe.encode(docs, path, decoded=True)
    return done.select("doc_id", bpe.id_count(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"), vocabulary())


def op4_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffixes.deduplicate(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    names = F.array_sort(F.array_distinct(F.transform("finds", lambda x: x["license"])))
    return found.select("doc_id", F.size("finds").cast("long").alias("n_finds"), F.concat_ws(",", names).alias("licenses"), F.coalesce(F.array_max(F.transform("finds", lambda x: x["coverage"])), F.lit(0.0)).alias("coverage"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language.held_out(F.col("doc_id"), 4, 2)
    model = language.fit(docs.where(~out))
    return language.predict(docs.select("doc_id", "text"), model).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = language.held_out(F.col("doc_id"), 5, 1)
    found = suffixtree.scores(table(spark, sf_dir, "documents"), ~out)
    return found.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.quality(docs, host=F.col("source")).drop("host_failed")


OP8_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
g AS (SELECT r, unnest(range(1, len(words) - 3)) AS i, words FROM w WHERE len(words) >= 5),
h AS (SELECT r, i, list_slice(words, i, i + 4) AS gram FROM g),
t AS (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS c FROM h),
c AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM t WHERE c > 1) GROUP BY r),
m AS (SELECT doc_id, host, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN c USING (r)),
f AS (SELECT *, n_words < 10 AS short, 100 * n_repeat_words > 20 * n_words AS repeats, 10 * n_symbols > word_chars AS symbols, 10 * n_dup_lines > 3 * n_lines AS lines FROM m),
b AS (SELECT host, count(*) AS n, sum(CAST(short AS INT)) AS short, sum(CAST(repeats AS INT)) AS repeats, sum(CAST(symbols AS INT)) AS symbols, sum(CAST(lines AS INT)) AS lines FROM f GROUP BY host),
l AS (SELECT host, n, rule, failed, failed / n AS rate FROM (UNPIVOT b ON short, repeats, symbols, lines INTO NAME rule VALUE failed)),
p AS (SELECT rule, sum(failed) / sum(n) AS mean, var_pop(rate) AS var FROM l GROUP BY rule),
s AS (SELECT rule, mean, CASE WHEN var <= mean * (1 - mean) / 1001 THEN 1000.0 ELSE greatest(1.0, mean * (1 - mean) / var - 1) END AS strength FROM p),
v AS (SELECT host, max((failed + strength * mean) / (n + strength)) > 0.5 AS host_failed FROM l JOIN s USING (rule) GROUP BY host)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, short OR repeats AS base_failed, NOT (short OR repeats) AND NOT host_failed AS kept
FROM f JOIN v USING (host)
"""


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", names).cast("binary"), 256).alias("items_sha256"), contamination.contaminated().alias("contaminated"))


OP9_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
i AS (SELECT DISTINCT item_id, n, list_slice(w, s, s + n - 1) AS win FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS s FROM b WHERE len(w) > 0)),
n AS (SELECT DISTINCT n FROM i),
x AS (SELECT r, n, w, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS s FROM d, n WHERE len(w) >= n),
h AS (SELECT r, x.n, s, item_id FROM (SELECT r, n, s, list_slice(w, s, s + n - 1) AS win FROM x) x JOIN i ON i.n = x.n AND i.win = x.win),
c AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM h) GROUP BY r),
k AS (SELECT r, count(*) AS n_items, sha256(string_agg(t, ',' ORDER BY t)) AS items_sha256 FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS t FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN k USING (r)
"""


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = language.held_out(F.col("doc_id"), 3, 1)
    lm = toxicity.character_model(docs)
    weights = toxicity.fit(docs.where(~out), table(spark, sf_dir, "labels").where(~out), lm)
    return toxicity.scores(docs, lm, weights).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"), least=30, top=50)


OP11_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
v AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
l AS (SELECT lang, count(*) AS terms, CAST(sum(n) AS BIGINT) AS total FROM v GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN v USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT lang, source, coalesce(CAST(sum(n) AS BIGINT), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY lang, source),
p AS (SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 5) // (g.total + 5 * l.terms) AS p, 1 + 1000000000 * (v.n + 5) // (l.total + 5 * l.terms) AS q
  FROM g JOIN l ON l.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
term AS (SELECT lang, source, term AS item, CAST(p - q AS BIGINT) AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INT) AS rank FROM pair
UNION ALL
SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INT) AS rank FROM term) WHERE rank <= 50
"""


def op12_idplanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "ids")
    tokenfiles.write(table(spark, sf_dir, "documents"), path, vocabulary(), end=2)
    return tokenfiles.digests(spark, path)


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damaged(table(spark, sf_dir, "conversations")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_simhash, op2_warc, op3_bpe, op4_suffixes, op5_licenses, op6_language, op7_lm, op8_quality, op9_decontamination, op10_toxicity, op11_divergence, op12_idplanes, op13_conversations)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": OP2_SQL, "op8_quality": OP8_SQL, "op9_decontamination": OP9_SQL, "op11_divergence": OP11_SQL}
