"""The registered queries of this subpackage: opN_<name>(spark, sf_dir), and SQL for those that it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, exact_dedup, license_scan, minhash_dedup, packing, quality, secret_scan, token_count, toxicity, url_filter
from ._common import table


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies; every executor has the package that holds it."""
    import public_tokenizers

    return public_tokenizers.path(name)


URL_RULES = [url_filter.Rule("block", "net/"), url_filter.Rule("allow", "example.net/en/"), url_filter.Rule("block", "example.com/de/"), url_filter.Rule("allow", "org/fr/")]
URL_PATTERNS = [url_filter.Rule("block", x, base=False) for x in ("*.spam-farm.*", "*.cheap-pills.*", "*/casino/*", "spam-farm.*", "cheap-pills.*")]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(spark, table(spark, sf_dir, "pages"), URL_RULES + URL_PATTERNS)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.group_copies(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json")))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_groups(table(spark, sf_dir, "documents"), k=2, percent=80)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"), secret_scan.train(spark, secret_scan.labelled_findings()))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_quality, op3_exact_dedup, op4_decontaminate, op5_packing, op6_minhash_dedup, op7_license_scan, op8_secret_scan, op9_toxicity, op10_token_count)}

ORACLES = {
    "op1_url_filter": r"""
WITH r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT row_number() OVER () AS n, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(regexp_extract(rest, '^([^/?#]*)', 1)) + 1), '^([^?#]*)', 1) AS path FROM r),
rules(verdict, text, rhost, rpath) AS (VALUES ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'), ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')),
m AS (SELECT h.n, max_by(struct_pack(v := verdict, t := text), length(text)) AS best FROM h JOIN rules
  ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY h.n)
SELECT page_id, host, path, m.best.t AS rule,
  CASE WHEN m.best IS NOT NULL THEN m.best.v WHEN p.pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, CASE WHEN m.best IS NULL THEN p.pattern END AS pattern
FROM h LEFT JOIN m ON h.n = m.n LEFT JOIN LATERAL (SELECT CASE
  WHEN host || path LIKE '%.cheap-pills.%' THEN '*.cheap-pills.*' WHEN starts_with(host || path, 'cheap-pills.') THEN 'cheap-pills.*'
  WHEN host || path LIKE '%.spam-farm.%' THEN '*.spam-farm.*' WHEN starts_with(host || path, 'spam-farm.') THEN 'spam-farm.*'
  WHEN host || path LIKE '%/casino/%' THEN '*/casino/*' END AS pattern) p ON true""",
    "op3_exact_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept,
  sha256(coalesce(text, '')) AS text_sha256 FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op7_license_scan": license_scan.sql(),
}
