"""The registered queries of this subpackage, one per operator, and the SQL that must return the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    cross_polytope, divergence, fingerprints, lexical_search, line_crf, mixing, packing, phrases, pivot_simhash, ppm, secret_scan,
    separator_scan, toxicity)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(job: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = job
        if sql is not None:
            ORACLES[name] = sql
        return job

    return add


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query("op1_mix_sources")
def mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.schedule(_documents(spark, sf_dir))


@query("op2_fingerprints")
def document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(_documents(spark, sf_dir))


# Brute force over all pairs of a label, and components by repeated relabelling.
_COSINE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), sound AS (
  SELECT vec_id, label, e FROM v
  WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links, least.component_id, v.vec_id = least.component_id AS kept
FROM v JOIN least ON least.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""


@query("op3_embedding_neighbours", _COSINE_SQL)
def embedding_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_polytope.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query("op4_simhash_pivots")
def simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_simhash.near_duplicates(_documents(spark, sf_dir))


@query("op5_pack_documents")
def pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir))


@query("op6_scan_secrets")
def scan_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_spans(_documents(spark, sf_dir))


@query("op7_toxicity_nnpu")
def toxicity_nnpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query("op8_ppm_scores")
def ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score_documents(_documents(spark, sf_dir))


@query("op9_token_counts")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return separator_scan.document_token_counts(_documents(spark, sf_dir))


# Every window as a string, the smallest document of each, and the words that later windows cover.
_REPEATS_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), h AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS k
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)
), f AS (SELECT k, min(doc_id) AS first_id, max(doc_id) AS last_id FROM h GROUP BY k HAVING min(doc_id) < max(doc_id)
), c AS (
  SELECT DISTINCT doc_id, i + j AS word_no
  FROM (SELECT h.doc_id, h.i, unnest(range(0, 50)) AS j FROM h JOIN f ON f.k = h.k WHERE f.first_id < h.doc_id)
), r AS (SELECT doc_id, list(word_no) AS gone FROM c GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN ws
    ELSE list_filter(ws, lambda x, i: NOT list_contains(gone, i)) END, ' '), '')) AS kept_sha256
FROM w LEFT JOIN r ON r.doc_id = w.doc_id
"""


@query("op10_remove_repeats", _REPEATS_SQL)
def remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.remove_repeats(_documents(spark, sf_dir))


@query("op11_line_quality")
def line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_crf.judge(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


# Every posting of every item scored.
_SEARCH_SQL = r"""
WITH letters AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS up, 'abcdefghijklmnopqrstuvwxyz' AS low),
d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(text, up, low), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents, letters WHERE text IS NOT NULL
), size AS (SELECT count(*) AS n, sum(len(ts)) AS l FROM d WHERE len(ts) > 0),
q AS (
  SELECT item_id, t, count(*) AS k FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, up, low), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
    FROM benchmark, letters WHERE text IS NOT NULL) GROUP BY item_id, t
), p AS (
  SELECT r, doc_id, m, t, count(*) AS tf
  FROM (SELECT r, doc_id, 25 + CAST((75 * len(ts) * n) // l AS BIGINT) AS m, unnest(ts) AS t FROM d, size) GROUP BY r, doc_id, m, t
), w AS (
  SELECT t, CAST(floor(1000 * ln((2 * any_value(n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM p, size GROUP BY t
), s AS (
  SELECT item_id, r, doc_id, CAST(sum(k * weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM q JOIN p USING (t) JOIN w USING (t) GROUP BY item_id, r, doc_id
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
WHERE rank <= 10
"""


@query("op12_lexical_search", _SEARCH_SQL)
def lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


# Every kept term for every group, and every pair of groups over all of them.
_AUDIT_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents
), u AS (SELECT r, lang, source, unnest(ts) AS t FROM d),
kept AS (SELECT lang, t FROM u GROUP BY lang, t HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, t, count(*) AS n FROM u JOIN kept USING (lang, t) GROUP BY lang, source, t),
own AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source),
every AS (
  SELECT g.lang, g.source, kept.t, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(own.total, 0) + 2 * v.v) AS p
  FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN own USING (lang, source) LEFT JOIN c USING (lang, source, t)
), al AS (
  SELECT lang, t, 1 + (1000000000::HUGEINT * (sum(n) + 2)) // (any_value(total) + 2 * any_value(v)) AS q
  FROM c JOIN (SELECT lang, sum(total) AS total FROM own GROUP BY lang) USING (lang) JOIN v USING (lang) GROUP BY lang, t
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, CAST(sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS BIGINT) AS value
  FROM every a JOIN every b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY a.lang, a.source, b.source
), terms AS (
  SELECT lang, source, t AS item, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) AS value
  FROM every JOIN al USING (lang, t) WHERE n > 0 AND p > q
), out AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(pairs.value, 0) AS value
  FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
  LEFT JOIN pairs ON pairs.lang = x.lang AND pairs.source = x.source AND pairs.item = y.source
  UNION ALL SELECT lang, source, 'term', item, value FROM terms
)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM out)
WHERE part = 'pair' OR rank <= 10
"""


@query("op13_divergence_audit", _AUDIT_SQL)
def divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_documents(spark, sf_dir))
