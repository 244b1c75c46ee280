"""Queries that apply each operator, with production parameters, to its whole table; and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm import decontaminate, exact_dedup, hmm, mixing, near_dedup, quality, scratch, substring_dedup, toxicity, training, url_filter, warc

URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
MIX_WEIGHTS, MIX_SHARE, MIX_LIMIT = [5, 2, 1], 1.5, 2.0


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = substring_dedup.substring_dedup(_table(spark, sf_dir, "documents"), length=100)
    return cleaned.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch.new_path(spark, "warc")
    warc.write_warc(_table(spark, sf_dir, "pages"), path)
    return warc.read_warc(spark, path).drop("segments")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(_table(spark, sf_dir, "documents"), percent=85)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    lexicon = toxicity.fit_toxicity(docs, _table(spark, sf_dir, "labels"), training.fold(F.col("doc_id"), 5) != 0)
    scored = toxicity.score_toxicity(docs, lexicon)
    return scored.select("doc_id", (training.fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "clauses", "insults")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.withColumn("kept", ~F.col("contaminated"))


def op6_hmm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score_texts(_table(spark, sf_dir, "documents"), training.fold(F.col("doc_id"), 5) == 1)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"), keep="largest")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(_table(spark, sf_dir, "pages"), URL_RULES).drop("url")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit_quality(docs, _table(spark, sf_dir, "labels"), training.fold(F.col("doc_id"), 3) != 1)
    scored = quality.score_quality(docs, model)
    return scored.select("doc_id", (training.fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(_table(spark, sf_dir, "documents"), MIX_WEIGHTS, MIX_SHARE, MIX_LIMIT)
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


QUERIES = {"op1_substring_dedup": op1_substring_dedup, "op2_warc": op2_warc, "op3_near_dedup": op3_near_dedup, "op4_toxicity": op4_toxicity, "op5_decontaminate": op5_decontaminate, "op6_hmm_scoring": op6_hmm_scoring, "op7_exact_dedup": op7_exact_dedup, "op8_url_filter": op8_url_filter, "op9_quality": op9_quality, "op10_mixing": op10_mixing}

_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = {
    "op1_substring_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, s, md5(substr(hx, 2 * s + 1, 200)) AS k FROM (SELECT doc_id, hx, unnest(range(n - 99)) AS s FROM d WHERE n >= 100)),
f AS (SELECT k, min({'doc_id': doc_id, 's': s}) AS earliest FROM w GROUP BY k),
r AS (SELECT doc_id, s FROM w JOIN f USING (k) WHERE {'doc_id': doc_id, 's': s} > earliest),
g AS (SELECT doc_id, s, CASE WHEN s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) <= 100 THEN 0 ELSE 1 END AS fresh FROM r),
i AS (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS span FROM g),
p AS (SELECT doc_id, min(s) AS a, max(s) + 100 AS b FROM i GROUP BY doc_id, span),
q AS (SELECT doc_id, b AS from_byte, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS to_byte FROM p
  UNION ALL SELECT doc_id, 0, min(a) FROM p GROUP BY doc_id),
kept AS (SELECT q.doc_id, string_agg(substr(hx, 2 * from_byte + 1, 2 * (coalesce(to_byte, n) - from_byte)), '' ORDER BY from_byte) AS hx FROM q JOIN d USING (doc_id) GROUP BY q.doc_id),
t AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM p GROUP BY doc_id)
SELECT d.doc_id, d.n AS n_bytes, coalesce(CAST(t.n_removed AS BIGINT), 0) AS n_removed, coalesce(t.n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept.hx, d.hx))) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op2_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT html, max(page_id) AS holder FROM p GROUP BY html)
SELECT p.page_id, strlen(p.html) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + ((CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS INTEGER), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN p.page_id = g.holder THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN p.page_id <> g.holder THEN g.holder END AS refers_to
FROM p JOIN g USING (html)""",
    "op3_near_dedup": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS a FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(a) = 0 THEN [] WHEN len(a) < 5 THEN [array_to_string(a, ' ')]
  ELSE list_transform(range(1, len(a) - 3), lambda i: array_to_string(a[i:i + 4], ' ')) END) AS sh FROM w),
n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles FROM s),
x AS (SELECT doc_id, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n m ON m.doc_id = a JOIN n o ON o.doc_id = b WHERE 100 * c >= 85 * (m.n_shingles + o.n_shingles - c)),
u AS (SELECT a AS f, b AS t FROM e UNION ALL SELECT b, a FROM e),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, u.t FROM r JOIN u ON r.reached = u.f),
k AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN k USING (doc_id)""",
    "op7_exact_dedup": f"""
WITH n AS (SELECT doc_id, sha256({_LOW.format("coalesce(text, '')")}) AS text_sha256, {_LOW.format("coalesce(text, '')")} AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM n JOIN g USING (t)""",
    "op8_url_filter": rf"""
WITH p AS (SELECT page_id, {_LOW.format("regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1)")} AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
r(rhost, rpath, rverdict) AS (VALUES {", ".join(str(x) for x in URL_RULES)}),
m AS (SELECT page_id, rhost || rpath AS rule, rverdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS n
  FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT p.page_id, host, path, rule, coalesce(rverdict, 'allow') AS verdict FROM p LEFT JOIN m ON p.page_id = m.page_id AND n = 1""",
    "op10_mixing": rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  CAST(('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), 'text|' || md5(coalesce(text, '')))), 1, 15)) AS BIGINT) AS h FROM documents),
s AS (SELECT source, sum(size) AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS weight, sum(source_size) OVER () AS total FROM s),
r AS (SELECT *, row_number() OVER (ORDER BY 2.0 * source_size / weight, source NULLS LAST) AS k,
  coalesce(sum(2.0 * source_size) OVER (ORDER BY 2.0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
  sum(weight) OVER (ORDER BY 2.0 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight FROM w),
l AS (SELECT min(k) AS first_open FROM r WHERE (1.5 * total - capped) / open_weight * weight <= 2.0 * source_size),
v AS (SELECT (1.5 * total - capped) / open_weight AS level FROM r, l WHERE k = first_open),
t AS (SELECT source, CAST(source_size AS BIGINT) AS source_size, least(2.0 * source_size, weight * level) AS target FROM r, v),
c AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS whole,
  coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, round(target, 6) AS target,
  CAST(size * (whole + CASE WHEN target - whole * source_size > 0 AND before + size / 2.0 <= target - whole * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM c""",
}
