"""The registered queries of the corpus operators, with production parameters, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ship import ship
from . import ann, bpe, lm_score, mixing, quality_net, quality_rules, sharding, simhash, url_filter, warc
from ._common import bound_batches, new_path

WORD_BPE = "word_bpe_49k.json"
RULES = [url_filter.Rule("block", "com", "/en/"), url_filter.Rule("allow", "example.com", "/en/7"), url_filter.Rule("allow", "net", "/de/"), url_filter.Rule("block", "example.net", "/de/8"), url_filter.Rule("block", "org", "/es/")]
SHARDS = 16


def tokenizer_path(name: str = WORD_BPE) -> str:
    """Where the public vocabulary file lies; the same on every machine of a cluster."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.cluster(_table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, path = _table(spark, sf_dir, "pages"), new_path(spark, "warc")
    warc.write_pages(pages, path)
    return warc.read_pages(spark, path)


def op3_quality_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_net.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(_table(spark, sf_dir, "documents"), tokenizer_path())


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(_table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"), RULES).drop("probability")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"), SHARDS)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan_mix(_table(spark, sf_dir, "documents"))


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash, op2_warc, op3_quality_net, op4_bpe, op5_lm_score, op6_quality_rules, op7_url_filter, op8_sharding, op9_mixing, op10_ann)}


#: Water filling and the inverse of the linear weight schedule, written from the definition: every candidate level is
#: tried by a join of sources with sources instead of a running sum.
OP9_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, text, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ' ' || md5(coalesce(text, ''))) AS k
  FROM documents),
named AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rn FROM sized GROUP BY source),
weighted AS (
  SELECT *, CAST([5, 2, 1][rn % 3 + 1] AS DOUBLE) AS w, CAST([0.5, 0.0, -0.5][rn % 3 + 1] AS DOUBLE) AS a, CAST(3.0 * source_size AS DOUBLE) AS cap FROM named),
ordered AS (SELECT *, row_number() OVER (ORDER BY cap / w, rn) AS j FROM weighted),
levels AS (
  SELECT x.j, x.w, x.cap, (SELECT CAST(sum(source_size) AS DOUBLE) FROM ordered)
         - coalesce((SELECT sum(y.cap) FROM ordered y WHERE y.j < x.j), 0) AS spare, (SELECT sum(y.w) FROM ordered y WHERE y.j >= x.j) AS rest
  FROM ordered x),
level AS (SELECT arg_min(spare / rest, j) AS l FROM levels WHERE spare / rest * w <= cap),
target AS (SELECT source, source_size, least(cap, (SELECT l FROM level) * w) AS target, a FROM weighted),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.a,
         CAST(coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM sized s JOIN target t ON s.source IS NOT DISTINCT FROM t.source),
passes AS (
  SELECT *, CAST(CASE WHEN size > 0 AND 2 * start + size < 2 * target THEN 1 ELSE 0 END
         + CASE WHEN size > 0 AND 2 * (start + source_size) + size < 2 * target THEN 1 ELSE 0 END
         + CASE WHEN size > 0 AND 2 * (start + 2 * source_size) + size < 2 * target THEN 1 ELSE 0 END AS BIGINT) AS n,
         (2 * start + size) / (target * 2) AS x
  FROM placed)
SELECT doc_id, size, source_size, target, size * n AS taken,
       CASE WHEN n > 0 THEN CASE WHEN a = 0 THEN x ELSE (a - 1 + sqrt((1 - a) * (1 - a) + 4 * a * x)) / (2 * a) END END AS first_position
FROM passes
"""


#: The 160 bits of SHA-1 as 32 base32 letters: five hex digits hold four of them.
OP2_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
q AS (SELECT page_id, h, CAST(strlen(body) AS BIGINT) AS payload_bytes, min(page_id) OVER (PARTITION BY body) AS first_id FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + ((CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31), 1)), '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM q
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": OP2_SQL, "op9_mixing": OP9_SQL}
