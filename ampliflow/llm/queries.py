"""The training-data queries: thin digests of the operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table

ORACLES: dict[str, str] = {}


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .pack import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import decontaminate

    out = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return out.drop("item_ids", "n_whole")


ORACLES["op8_decontaminate"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[k : k + least(len(w), 13) - 1], ' ') AS win FROM b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS u(k) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, k, array_to_string(w[k : k + n - 1], ' ') AS win FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS u(k) WHERE len(w) >= n),
hit AS (SELECT r, k, bw.n AS n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS s FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN items USING (r)
"""


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), ngram=2)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find_pii

    return find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text", "span_list")


def op2_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive, audit, damaged

    pages = table(spark, sf_dir, "pages")
    return audit(archive(pages), damaged(pages))


_LEAVES = "SELECT file, CAST(floor(\"offset\" / 65536) AS BIGINT) AS node, sha256(string_agg(s, ',' ORDER BY s)) AS hash FROM (SELECT file, \"offset\", concat_ws(':', \"offset\", length, digest) AS s FROM {t}) GROUP BY ALL"
_LEVEL = "SELECT file, CAST(floor(node / 16) AS BIGINT) AS node, sha256(string_agg(concat_ws(':', c, hash), ',' ORDER BY c)) AS hash FROM (SELECT file, node, node AS c, hash FROM ({t})) GROUP BY file, CAST(floor(node / 16) AS BIGINT)"


def _root(t: str) -> str:
    sql = _LEAVES.format(t=t)
    for _ in range(4):
        sql = _LEVEL.format(t=sql)
    return sql


def _records(t: str) -> str:
    record = "'WARC/1.0' || e || 'WARC-Type: resource' || e || 'WARC-Record-ID: <urn:sha256:' || sha256(url || chr(10) || html) || '>' || e || 'WARC-Target-URI: ' || url || e || 'Content-Length: ' || strlen(html) || e || e || html || e || e"
    return f"""SELECT CAST(coalesce(floor(page_id / 1000), -1 - CAST('0x' || digest[1:4] AS BIGINT)) AS BIGINT) AS file, coalesce(page_id, -1) AS page_id, length, digest
  FROM (SELECT page_id, CAST(strlen(record) AS BIGINT) AS length, sha256(record) AS digest FROM (SELECT page_id, {record} AS record FROM (SELECT *, chr(13) || chr(10) AS e FROM {t})))"""


ORACLES["op2_fixity"] = f"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, url, CASE WHEN coalesce(page_id, -1) % 97 = 5 AND html[1] = '<' THEN '[' || html[2:] ELSE html END AS html FROM p),
a0 AS ({_records("p")}),
b0 AS ({_records("q")}),
a AS (SELECT *, CAST(sum(length) OVER (PARTITION BY file ORDER BY page_id, digest) - length AS BIGINT) AS "offset" FROM a0),
b AS (SELECT * FROM (SELECT *, CAST(sum(length) OVER (PARTITION BY file ORDER BY page_id, digest) - length AS BIGINT) AS "offset" FROM b0) WHERE page_id % 211 <> 7),
ra AS ({_root("a")}),
rb AS ({_root("b")})
SELECT a.file, a."offset", CASE WHEN b.digest IS NULL THEN 'missing' ELSE 'corrupt' END AS status, a.length, a.digest, a.page_id, b.digest AS replica_digest, ra.hash AS root, rb.hash AS replica_root
FROM a LEFT JOIN b USING (file, "offset") JOIN ra ON a.file = ra.file LEFT JOIN rb ON a.file = rb.file WHERE b.digest IS DISTINCT FROM a.digest
"""


def op3_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vectors import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import filter_urls

    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "block_score")


def op6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .passages import shared_passages

    return shared_passages(table(spark, sf_dir, "documents"))


ORACLES["op6_passages"] = r"""
WITH d AS (SELECT DISTINCT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL),
g AS (SELECT doc_id, k, md5(array_to_string(w[k + 1 : k + 50], ' ')) AS h FROM d, unnest(range(0, len(w) - 49)) AS u(k) WHERE len(w) >= 50),
s AS (SELECT h FROM g GROUP BY h HAVING min(doc_id) <> max(doc_id)),
b AS (SELECT DISTINCT doc_id, k FROM g JOIN s USING (h)),
c AS (SELECT doc_id, k, CASE WHEN k - lag(k) OVER (PARTITION BY doc_id ORDER BY k) <= 50 THEN 0 ELSE 1 END AS fresh FROM b),
r AS (SELECT doc_id, k, sum(fresh) OVER (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS run FROM c),
p AS (SELECT doc_id, run, min(k) AS lo, max(k) + 50 AS hi FROM r GROUP BY doc_id, run)
SELECT doc_id, CAST(sum(hi - lo) AS BIGINT) AS n_shared, string_agg(lo || ':' || hi, ',' ORDER BY lo) AS passages FROM p GROUP BY doc_id
"""


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import language_of

    return language_of(table(spark, sf_dir, "documents"))


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .lm import score

    return score(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 7 != 2)


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
