"""The queries of the training-data operators, their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridquarry.llm import byte_bpe, decontam, html_extract, near_dedup, quality, secrets, token_counts, token_files, toxicity, url_filters
from gridquarry.sources.scratch import scratch_path

BYTE_BPE = "byte_bpe_50k.tiktoken"
WORD_BPE = "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a capture at a minute given by its id, against a list dated by host: spam hosts come on the list, go and come back; some others are listed for two weeks, or by a path, some of two steps; some hosts are listed in capitals."""
    pages = _table(spark, sf_dir, "pages").select(
        "page_id", "url", F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.col("page_id") * 7919, F.lit(86400 * 120))).alias("fetched")
    )
    path = F.filter(F.split(F.regexp_extract("url", url_filters.PATH, 1), "/"), lambda s: s != "")
    steps = pages.select(url_filters.host_of(F.col("url")).alias("h"), F.when(F.size(path) > 1, F.array_join(F.slice(path, 1, 2), "/")).alias("deep"), "page_id").where("h <> ''")
    hosts = steps.groupBy("h").agg(F.min("page_id").alias("f"))
    day = lambda x: F.timestamp_seconds(F.lit(1704067200) + x * 86400)
    entry = lambda key, action, since: F.struct(key.alias("key"), F.lit(action).alias("action"), since.alias("since"))
    h, by = F.col("h"), lambda n: F.pmod("f", F.lit(n))
    spam = F.array(entry(h, "block", day(by(20))), entry(h, "allow", day(30 + by(10))), entry(h, "block", day(F.lit(60))))
    some = F.array(
        entry(h, "block", day(by(90))),
        entry(h, "allow", day(by(90) + 14)),
        entry(F.concat(F.upper(h), F.lit("/en")), "block", day(by(50))),
        entry(F.concat(h, F.lit("/fr")), "allow", day(F.lit(0))),
    )
    entries = hosts.select(F.inline(F.when(F.expr("h LIKE '%spam%' OR h LIKE '%pills%'"), spam).when(F.length("h") % 5 == 0, some)))
    deep = steps.where("deep IS NOT NULL AND length(h) % 3 = 0").groupBy("h", "deep").agg(F.min("page_id").alias("f"))
    entries = entries.union(deep.select(F.concat(F.initcap(h), F.lit("/"), "deep"), F.lit("block"), day(by(70))))
    return url_filters.filtered(pages, entries).select("page_id", "host", "matched_key", "action", F.unix_seconds("since").alias("since_s"), "allowed")


OP1_SQL = r"""
WITH p AS (SELECT page_id, 1704067200 + (page_id * 7919) % 10368000 AS ts, url,
                  regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)', 1)), '\.$', '') AS host,
                  string_split(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '/') AS seg FROM pages),
h AS (SELECT host AS h, min(page_id) AS f, host LIKE '%spam%' OR host LIKE '%pills%' AS spam FROM p WHERE host <> '' GROUP BY host),
s AS (SELECT * FROM h WHERE NOT spam AND length(h) % 5 = 0),
e0 AS (SELECT h AS key, 'block' AS action, 1704067200 + (f % 20) * 86400 AS since FROM h WHERE spam
  UNION ALL SELECT h, 'allow', 1704067200 + (30 + f % 10) * 86400 FROM h WHERE spam
  UNION ALL SELECT h, 'block', 1704067200 + 60 * 86400 FROM h WHERE spam
  UNION ALL SELECT h, 'block', 1704067200 + (f % 90) * 86400 FROM s
  UNION ALL SELECT h, 'allow', 1704067200 + (f % 90 + 14) * 86400 FROM s
  UNION ALL SELECT h || '/en', 'block', 1704067200 + (f % 50) * 86400 FROM s
  UNION ALL SELECT h || '/fr', 'allow', 1704067200 FROM s
  UNION ALL SELECT host || '/' || seg[2] || '/' || seg[3], 'block', 1704067200 + (min(page_id) % 70) * 86400 FROM p WHERE host <> '' AND len(seg) > 2 AND length(host) % 3 = 0 GROUP BY host, seg[2], seg[3]),
e AS (SELECT key, since, max(action) AS action FROM e0 GROUP BY key, since),
i AS (SELECT *, lead(since) OVER (PARTITION BY key ORDER BY since) AS until FROM e),
m AS (SELECT page_id, key, action, since, row_number() OVER (PARTITION BY page_id ORDER BY length(key) DESC, action DESC, key DESC, since DESC) AS n
      FROM p JOIN i ON (host = key OR host LIKE '%.' || key OR key = host || '/' || seg[2] OR key = host || '/' || seg[2] || '/' || seg[3])
      AND ts >= since AND (until IS NULL OR ts < until))
SELECT p.page_id, host, key AS matched_key, action, since AS since_s, coalesce(action, 'allow') <> 'block' AS allowed
FROM p LEFT JOIN m ON m.page_id = p.page_id AND m.n = 1
"""


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extracted(_table(spark, sf_dir, "pages"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.groups(_table(spark, sf_dir, "documents"), k=4, percent=80)


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contained(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=5, percent=80)


def _rollup(spark: SparkSession, docs: DataFrame, counts: DataFrame, whole: bool) -> DataFrame:
    """Inserts all counts, deletes documents of under 200 characters, revises English counts by an end token, and commits the revision twice; whole: puts all counts back as they were."""
    rollup = token_counts.Rollup(spark, scratch_path(spark, "rollup"))
    rollup.commit("0001-insert", counts.withColumn("op", F.lit("upsert")))
    now = rollup.current()
    gone = now.join(docs.where("n_chars < 200").select("doc_id"), "doc_id", "left_semi")
    rollup.commit("0002-delete", gone.withColumn("op", F.lit("delete")))
    revised = rollup.current().where("lang = 'en'").withColumn("n_tokens", F.col("n_tokens") + 1).withColumn("op", F.lit("upsert"))
    rollup.commit("0003-revise", revised)
    rollup.commit("0003-revise", revised)
    if whole:
        rollup.commit("0004-restore", gone.unionByName(now.where("lang = 'en'")).withColumn("op", F.lit("upsert")))
    return rollup.totals()


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    bpe = token_counts.counted(docs, public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN, "byte-bpe-50k")
    return _rollup(spark, docs, bpe.unionByName(token_counts.words_counted(docs)), whole=True)


def token_rollup_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rollup of operator 5 over word counts alone, which SQL can express."""
    docs = _table(spark, sf_dir, "documents")
    return _rollup(spark, docs, token_counts.words_counted(docs), whole=False)


def token_rollup_words_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with all documents and their own counts at the end, as in operator 5."""
    docs = _table(spark, sf_dir, "documents")
    return _rollup(spark, docs, token_counts.words_counted(docs), whole=True)


TOKEN_ROLLUP_WORDS_SQL = r"""
SELECT source, lang, 'words-1' AS tokenizer, count(*) AS n_docs,
       CAST(sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) + CASE WHEN lang = 'en' THEN 1 ELSE 0 END) AS BIGINT) AS n_tokens
FROM documents WHERE n_chars >= 200 GROUP BY source, lang
"""

TOKEN_ROLLUP_WORDS_ALL_SQL = r"""
SELECT source, lang, 'words-1' AS tokenizer, count(*) AS n_docs,
       CAST(sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))) AS BIGINT) AS n_tokens
FROM documents GROUP BY source, lang
"""


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    token_files.write(_table(spark, sf_dir, "documents"), path, public_tokenizers.path(WORD_BPE), end=1)
    return token_files.checksums(spark, path)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades 0 (not toxic), 1 (toxic) and 2 (toxic and of low quality) of the labels, learnt and given to every document."""
    docs = _table(spark, sf_dir, "documents")
    grades = _table(spark, sf_dir, "labels").selectExpr("doc_id", "CASE WHEN toxic = 0 THEN 0 WHEN quality = 1 THEN 1 ELSE 2 END AS grade")
    return toxicity.graded(docs, toxicity.trained(docs, grades))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scanned(_table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return quality.judged(docs, keep=["doc_id"]).select("doc_id", *quality.MEASURES, "base_failed", "kept")


QUERIES = {
    q.__name__: q
    for q in (
        op1_url_filters,
        op2_html_extraction,
        op3_minhash_near_dedup,
        op4_benchmark_decontamination,
        op5_token_counts,
        token_rollup_words,
        token_rollup_words_all,
        op6_byte_bpe,
        op7_token_files,
        op8_toxicity,
        op9_secret_scan,
        op10_quality_rules,
    )
}

ORACLE_SQL = {
    "op1_url_filters": OP1_SQL,
    "op3_minhash_near_dedup": near_dedup.SQL,
    "op4_benchmark_decontamination": decontam.SQL,
    "token_rollup_words": TOKEN_ROLLUP_WORDS_SQL,
    "token_rollup_words_all": TOKEN_ROLLUP_WORDS_ALL_SQL,
    "op10_quality_rules": quality.SQL,
}
