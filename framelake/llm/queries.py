"""The operators' queries over the driver's tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm import ann, exact_dedup, licenses, mixing, packing, simhash, tokens, toxicity, urls, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    model = toxicity.learn(docs, labels.filter(~toxicity.held_out(F.col("doc_id"))))
    out = toxicity.score_toxicity(docs, model)
    return out.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_read(spark, sf_dir, "documents"))


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_read(spark, sf_dir, "embeddings"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents"))


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels are of documents; a page's path ends with the number of the document that it shows, so the label is the page's outcome."""
    pages = _read(spark, sf_dir, "pages")
    out = urls.judge_urls(pages, urls.labelled_pages(pages, _read(spark, sf_dir, "labels")))
    return out.select("page_id", "host", "path", "rule", "verdict")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(_read(spark, sf_dir, "pages"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_read(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"))


def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(_read(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_read(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_toxicity, op2_licenses, op3_nearest, op4_mixing, op5_urls, op6_warc, op7_exact_dedup, op8_packing, op9_tokens, op10_simhash)
    return {f.__name__: f for f in every}


def _op2_sql() -> str:
    """Exact containment by brute force: each shingle of each text against those of each template, and windows at every start."""
    values = ", ".join("({}, '{}', '{}')".format(i, name, passage.lower().replace("'", "''")) for i, (name, passage) in enumerate(licenses.TEMPLATES))
    return f"""
    WITH p AS (SELECT i, license, regexp_extract_all(passage, '[a-z0-9]+') AS w FROM (VALUES {values}) v(i, license, passage)),
    t AS (SELECT i, license, greatest(8, CAST(pow(2, ceil(log2(len(w)))) AS BIGINT)) AS length, unnest(list_distinct([array_to_string(list_slice(w, j, j + 4), ' ') FOR j IN range(1, greatest(len(w) - 4, 1) + 1)])) AS sh FROM p),
    n AS (SELECT i, count(*) AS n FROM t GROUP BY i),
    d AS (SELECT doc_id, row_number() OVER () AS rn, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL),
    s AS (SELECT doc_id, rn, unnest(range(0, greatest(len(w) - 4, 1))) AS pos, unnest([array_to_string(list_slice(w, j, j + 4), ' ') FOR j IN range(1, greatest(len(w) - 4, 1) + 1)]) AS sh FROM d),
    m AS (SELECT doc_id, rn, i, license, length, pos, sh FROM s JOIN t USING (sh)),
    c AS (SELECT a.doc_id, a.rn, a.license, a.pos, count(DISTINCT b.sh) / any_value(n) AS containment FROM m a JOIN n USING (i) JOIN m b ON a.rn = b.rn AND a.i = b.i AND b.pos BETWEEN a.pos AND a.pos + a.length - 5 GROUP BY a.doc_id, a.rn, a.license, a.i, a.pos),
    x AS (SELECT doc_id, rn, license, max(containment) AS containment FROM c WHERE containment >= 0.8 GROUP BY ALL)
    SELECT x.doc_id, x.license, x.containment, CAST(min(pos) AS BIGINT) AS first_word FROM x JOIN c USING (doc_id, rn, license, containment) GROUP BY x.doc_id, x.rn, x.license, x.containment"""


_OP4_SQL = r"""
WITH d AS (SELECT doc_id, source, CASE WHEN trim(translate(coalesce(text, ''), chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     ')) = '' THEN 0
    ELSE len(string_split_regex(trim(translate(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     ')), ' +')) END AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [3.0::DOUBLE, 1.0, 2.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS w FROM d GROUP BY source),
k AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * (sum(source_size) OVER ()) AS every,
    coalesce(sum(2.0::DOUBLE * source_size) OVER o, 0) AS before, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS wl FROM s WINDOW o AS (ORDER BY 2.0::DOUBLE * source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, cap <= w * (every - before) / wl AS full_ FROM k),
g AS (SELECT source, source_size, CASE WHEN full_ THEN cap ELSE w * (every - coalesce(sum(CASE WHEN full_ THEN cap END) OVER (), 0)) / sum(CASE WHEN NOT full_ THEN w END) OVER () END AS target FROM f),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM g),
p AS (SELECT d.doc_id, d.size, e.source_size, e.target, e.epochs, CAST(floor(e.target) AS BIGINT) - e.epochs * e.source_size AS rest,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(CAST(d.doc_id AS VARCHAR)), d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(epochs * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM p"""

_OP5_SQL = r"""
WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
l AS (SELECT doc_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
n AS (SELECT page_id, max(bad) AS bad FROM p JOIN l ON l.doc_id = try_cast(regexp_extract(path, '/([0-9]{1,18})$', 1) AS BIGINT) WHERE page_id IS NOT NULL GROUP BY 1),
h AS (SELECT host, string_split(host, '.')[-1] AS suffix, array_to_string(string_split(host, '.')[-2:], '.') AS domain, CAST(count(bad) AS DOUBLE) AS n, CAST(coalesce(sum(bad), 0) AS DOUBLE) AS bad FROM p LEFT JOIN n USING (page_id) GROUP BY 1, 2, 3),
g0 AS (SELECT (sum(bad) + 1.0) / (sum(n) + 2.0) AS p0 FROM h),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, any_value(p0) AS q FROM h, g0 GROUP BY 1),
sk AS (SELECT (sum(n * (bad / n - q) * (bad / n - q)) - sum(q * (1 - q))) / nullif(sum(n * q * (1 - q)) - sum(q * (1 - q)), 0) AS o FROM s WHERE n > 0),
s1 AS (SELECT suffix, (bad + k * q) / (n + k) AS p1 FROM s, (SELECT coalesce(CASE WHEN o <= 0.001 THEN 1000.0 ELSE greatest(1.0, 1 / o - 1) END, 1000.0) AS k FROM sk)),
d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad, any_value(p1) AS q FROM h JOIN s1 USING (suffix) GROUP BY 1, 2),
dk AS (SELECT (sum(n * (bad / n - q) * (bad / n - q)) - sum(q * (1 - q))) / nullif(sum(n * q * (1 - q)) - sum(q * (1 - q)), 0) AS o FROM d WHERE n > 0),
d1 AS (SELECT domain, (bad + k * q) / (n + k) AS p2 FROM d, (SELECT coalesce(CASE WHEN o <= 0.001 THEN 1000.0 ELSE greatest(1.0, 1 / o - 1) END, 1000.0) AS k FROM dk)),
r AS (SELECT host, n, bad, p2 AS q FROM h JOIN d1 USING (domain)),
rk AS (SELECT (sum(n * (bad / n - q) * (bad / n - q)) - sum(q * (1 - q))) / nullif(sum(n * q * (1 - q)) - sum(q * (1 - q)), 0) AS o FROM r WHERE n > 0),
r1 AS (SELECT host, k, n + k AS m, (bad + k * q) / (n + k) AS mean FROM r, (SELECT coalesce(CASE WHEN o <= 0.001 THEN 1000.0 ELSE greatest(1.0, 1 / o - 1) END, 1000.0) AS k FROM rk)),
ab AS (SELECT host, mean * m AS a, (1 - mean) * m AS b, abs(ln(mean / (1 - mean))) + 60 / (mean * m) + 20 * sqrt(1 / (mean * m) + 1 / ((1 - mean) * m)) AS far FROM r1),
i AS (SELECT host, a, b, far, CAST(unnest(range(0, 20001)) AS INTEGER) AS k FROM ab),
g AS (SELECT host, sum((CASE WHEN k IN (0, 20000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * exp(lgamma(a + b) - lgamma(a) - lgamma(b) - (a + b) * ln(1 + exp(-far * k / 20000)) - a * far * k / 20000)) * any_value(far) / 60000 AS below FROM i GROUP BY host),
v AS (SELECT host, below FROM g),
u(rule, verdict, rhost, rpath) AS (VALUES ('org/', 'allow', 'org', '/'), ('example.org/es/', 'block', 'example.org', '/es/'), ('example.org/en/1', 'block', 'example.org', '/en/1'), ('com/fr/', 'allow', 'com', '/fr/'), ('com/de/', 'block', 'com', '/de/')),
f AS (SELECT p.*, (SELECT max_by(rule, length(rule)) FROM u WHERE (p.host = rhost OR ends_with(p.host, '.' || rhost)) AND starts_with(p.path, rpath)) AS rule FROM p)
SELECT page_id, host, path, f.rule, coalesce(u.verdict, CASE WHEN below < 0.05 THEN 'block' ELSE 'allow' END) AS verdict FROM f LEFT JOIN u ON f.rule = u.rule JOIN v USING (host)"""

_OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_ FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first_ THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= 100 AND page_id <> first_ THEN first_ END AS refers_to FROM m"""

_OP7_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256 FROM d WINDOW w AS (PARTITION BY text_sha256)"""


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that it can express. The others are tested against brute force, the tokenizer library or held-out labels."""
    return {"op2_licenses": _op2_sql(), "op4_mixing": _OP4_SQL, "op5_urls": _OP5_SQL, "op6_warc": _OP6_SQL, "op7_exact_dedup": _OP7_SQL}
