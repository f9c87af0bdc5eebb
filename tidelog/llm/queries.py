"""The registered queries of the corpus operators: each over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import bpe, common, cws, html, langid, shards, simhash, spans, tokenfile, urls, winnow

#: The rules that the URL query judges by: verdict, host, path.
URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(common.spread(table(spark, sf_dir, "documents")), words=3, max_bits=3)


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"), URL_RULES).withColumn("antecedent", F.array_join("antecedent", " "))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cws.edited_likeness(table(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    to = f"{common.work_dir(spark)}/tidelog-tokens-{uuid.uuid4().hex}"
    tokenfile.write_images(table(spark, sf_dir, "documents"), vocabulary(), to, end_id=0)
    return tokenfile.read_images(spark, to)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.decontaminate(common.spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.spread(table(spark, sf_dir, "documents"))
    return langid.predict(docs, langid.train(docs))


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard(table(spark, sf_dir, "documents"), 40)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(common.spread(table(spark, sf_dir, "documents")), vocabulary())


def op10_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.dedup_report(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_removed", F.sha2("text", 256).alias("text_sha256"))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_html, op3_urls, op4_fingerprints, op5_token_files, op6_decontaminate, op7_language, op8_shards, op9_bpe, op10_spans)}

def _rule_sql(verdict: str, host: str, path: str) -> str:
    return f"CASE WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}') THEN {{{{'n': {len(host + path)}, 'rule': '{host + path}', 'verdict': '{verdict}'}}}} END".replace("{{", "{").replace("}}", "}")


ORACLE_SQL: dict[str, str] = {
    "op3_urls": f"""
WITH cut AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
judged AS (
  SELECT *, list_reverse_sort(list_filter([{', '.join(_rule_sql(*r) for r in URL_RULES)}], lambda x: x IS NOT NULL))[1] AS fit,
         list_distinct(list_concat([('host:' || x) FOR x IN string_split(host, '.') IF x <> ''],
           [('path:' || x) FOR x IN string_split_regex(translate(path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[/.]+') IF x <> ''])) AS tokens FROM cut),
labelled AS (SELECT row_number() OVER () AS r, fit.verdict AS verdict, tokens FROM judged WHERE fit IS NOT NULL AND len(tokens) > 0),
need AS (SELECT greatest(ceil(round(0.002 * count(*), 6)), 20) AS n FROM labelled),
each AS (SELECT r, verdict, unnest(tokens) AS t FROM labelled),
often AS (SELECT t FROM each GROUP BY t HAVING count(*) >= (SELECT n FROM need)),
kept AS (SELECT * FROM each SEMI JOIN often USING (t)),
combos AS (SELECT [t] AS antecedent, verdict FROM kept UNION ALL SELECT [a.t, b.t], a.verdict FROM kept a JOIN kept b ON a.r = b.r AND a.t < b.t),
counted AS (SELECT antecedent, verdict, count(*) AS support, count(*) / sum(count(*)) OVER (PARTITION BY antecedent)::DOUBLE AS confidence FROM combos GROUP BY antecedent, verdict),
rules AS (SELECT * FROM counted WHERE support >= (SELECT n FROM need) AND confidence >= 0.9),
least AS (SELECT * FROM rules r WHERE len(antecedent) = 1 OR NOT EXISTS (SELECT 1 FROM rules s WHERE len(s.antecedent) = 1 AND s.verdict = r.verdict AND list_contains(r.antecedent, s.antecedent[1]))),
best AS (
  SELECT j.page_id, max({{'c': l.confidence, 's': l.support, 'v': l.verdict, 'a': l.antecedent}}) AS b
  FROM judged j JOIN least l ON list_has_all(j.tokens, l.antecedent) WHERE j.fit IS NULL GROUP BY j.page_id)
SELECT page_id, host, path, fit.rule AS rule, coalesce(fit.verdict, b.v, 'allow') AS verdict, array_to_string(b.a, ' ') AS antecedent, b.c AS confidence
FROM judged LEFT JOIN best USING (page_id)
""",
    "op8_shards": r"""
WITH RECURSIVE rows AS (
  SELECT row_number() OVER () AS r, doc_id, strlen(coalesce(text, ''))::BIGINT + 16 AS size,
         [('0x' || x)::BIGINT FOR x IN regexp_extract_all(h, '..')] AS bytes
  FROM (SELECT doc_id, text, hex(encode(coalesce(text, ''))) AS h FROM documents)),
folds AS (SELECT list(f ORDER BY i) AS t FROM (SELECT i, list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: (xor(a >> 1, (a & 1) * 3988292384))) AS f FROM unnest(generate_series(0, 255)) g(i))),
summed AS (
  SELECT r, doc_id, size, CASE WHEN size = 16 THEN 0 ELSE xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8)), 4294967295::BIGINT) END::BIGINT AS text_crc32 FROM rows, folds),
jump(r, k, b, j) AS (
  SELECT r, (coalesce(doc_id, 0)::HUGEINT + 18446744073709551616::HUGEINT) % 18446744073709551616::HUGEINT, -1::BIGINT, 0::BIGINT FROM summed
  UNION ALL
  SELECT r, n, j, floor((j + 1)::DOUBLE * (2147483648::DOUBLE / ((n // 8589934592::HUGEINT) + 1)::DOUBLE))::BIGINT
  FROM (SELECT r, j, (k * 2862933555777941757::HUGEINT + 1) % 18446744073709551616::HUGEINT AS n FROM jump WHERE j < 41)),
place AS (SELECT r, max(b) FILTER (b < 40)::INT AS shard, max(b) FILTER (b < 41)::INT AS grown_shard FROM jump GROUP BY r)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1 AS slot, grown_shard FROM summed JOIN place USING (r)
""",
    "op6_decontaminate": r"""
WITH cut AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
lengths AS (SELECT DISTINCT least(13, len(w)) AS n FROM items WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g
  FROM items, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS t(i) WHERE len(w) > 0),
places AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM cut, lengths, unnest(generate_series(1, len(w) - n + 1)) AS t(i) WHERE len(w) >= n),
hit AS (SELECT DISTINCT p.doc_id, p.i, p.n, v.item_id FROM places p JOIN windows v ON p.n = v.n AND p.g = v.g),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM hit, unnest(generate_series(i, i + n - 1)) AS t(k) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY doc_id)
SELECT c.doc_id, len(c.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(f.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(f.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(c.w) AS contaminated
FROM cut c LEFT JOIN words h USING (doc_id) LEFT JOIN found f USING (doc_id)
""",
}
