"""The queries op1 to op13, with their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, decontaminate, erasure, exact_topk, jaccard_forest, pii, quality, rans, secret_scan, templates, toxicity, vp_trees
from .shared import table


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all documents: a row each, with its class, the text it copies and its number of links."""
    return jaccard_forest.near_duplicates(table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page, by templates of the pages' hosts."""
    return templates.extract(table(spark, sf_dir, "pages"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item that it contains."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded: its number of ids and the digests of ids and bytes."""
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score of every text, learned from the labels that are not held out."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth, of all others."""
    return vp_trees.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text: the fixed patterns, and what the random field adds."""
    return pii.report(table(spark, sf_dir, "documents"))


def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's ids, written to files in ascending order and read back from them."""
    return rans.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence, site posteriors and score of every document."""
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every text: the fixed patterns, and tokens that look random."""
    return secret_scan.report(table(spark, sf_dir, "documents"))


def op11_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest integer inner products of every twentieth vector with all others."""
    return exact_topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op12_erasure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shop's tables laid out in files, and the victims erased from them: a row for each file that is left, from what is in it."""
    return erasure.report(erasure.rewrite(*(table(spark, sf_dir, name) for name in ("clients", "clicks", "sales", "sale_lines"))))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's tokens by two tokenizers, grouped where both end at one byte, and their links by how common these are."""
    return alignment.report(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join,
        op2_html_extraction,
        op3_benchmark_decontamination,
        op4_byte_bpe,
        op5_toxicity,
        op6_nearest_neighbours,
        op7_pii,
        op8_token_ids,
        op9_quality,
        op10_secrets,
        op11_exact_topk,
        op12_erasure,
        op13_token_alignment,
    )
}

# Word sequences as the operators see them, and the five-word shingles of them; a shorter text is one shingle.
_SHINGLES = r"""
words AS (SELECT key, regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}]+') AS w FROM texts),
shingles AS (
  SELECT DISTINCT key, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) ELSE [array_to_string(w, ' ')] END) AS s
  FROM words WHERE len(w) > 0)"""

ORACLES: dict[str, str] = {
    "op1_ngram_jaccard_join": f"""
WITH RECURSIVE copies AS (SELECT coalesce(text, '') AS text, min(doc_id) AS key FROM documents GROUP BY 1),
texts AS (SELECT key, text FROM copies), {_SHINGLES},
size AS (SELECT key, count(*) AS n FROM shingles GROUP BY key),
shared AS (SELECT x.key AS a, y.key AS b, count(*) AS n FROM shingles x JOIN shingles y ON x.s = y.s AND x.key <> y.key GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN size p ON p.key = a JOIN size q ON q.key = b WHERE shared.n / (p.n + q.n - shared.n)::DOUBLE >= 0.8),
reach AS (SELECT key AS a, key AS b FROM copies UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
component AS (SELECT a AS key, min(b) AS class_id FROM reach GROUP BY a),
degree AS (SELECT a AS key, count(*) AS n FROM links GROUP BY a)
SELECT d.doc_id, c.class_id, k.key AS copy_of, coalesce(g.n, 0)::BIGINT AS n_links
FROM documents d JOIN copies k ON k.text = coalesce(d.text, '') JOIN component c ON c.key = k.key LEFT JOIN degree g ON g.key = k.key""",
    # every page of the tables has one article element; the character references that occur are decoded
    "op2_html_extraction": r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article[^>]*>(.*)</article>', 1) AS h FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(h, '</?(b|i|a|em|strong|span)>', '', 'g'), '<[^>]*>', ' ', 'g') AS h FROM a),
c AS (SELECT page_id, url, replace(replace(replace(replace(replace(h, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&') AS h FROM b),
d AS (SELECT page_id, url, trim(regexp_replace(h, '\s+', ' ', 'g')) AS text FROM c)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM d""",
    # items of fewer than five words are sequences that a document has anywhere
    "op3_benchmark_decontamination": f"""
WITH texts AS (SELECT 2 * doc_id AS key, text FROM documents UNION ALL SELECT 2 * item_id + 1, text FROM benchmark), {_SHINGLES},
size AS (SELECT key, count(*) AS n FROM shingles JOIN words USING (key) WHERE key % 2 = 1 AND len(w) >= 5 GROUP BY key),
shared AS (SELECT d.key AS doc, i.key AS item, count(*) AS n FROM shingles d JOIN shingles i ON d.s = i.s AND d.key % 2 = 0 AND i.key % 2 = 1 GROUP BY 1, 2),
short AS (SELECT key, len(w) AS k, array_to_string(w, ' ') AS s FROM words WHERE key % 2 = 1 AND len(w) BETWEEN 1 AND 4),
sequences AS (
  SELECT DISTINCT key, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s
  FROM words JOIN (SELECT DISTINCT k FROM short) ON len(w) >= k WHERE key % 2 = 0)
SELECT (doc // 2)::BIGINT AS doc_id, (item // 2)::BIGINT AS item_id, size.n::INTEGER AS n_item, shared.n::INTEGER AS n_shared, shared.n / size.n::DOUBLE AS containment
FROM shared JOIN size ON size.key = item WHERE shared.n >= 0.8 * size.n
UNION ALL SELECT (q.key // 2)::BIGINT, (short.key // 2)::BIGINT, 1, 1, 1.0::DOUBLE FROM sequences q JOIN short ON q.s = short.s""",
    "op6_nearest_neighbours": """
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.n, q.vec_id AS query_id, c.n AS m, c.vec_id, list_inner_product(q.v, c.v) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.n <> c.n AND len(q.v) = len(c.v)),
r AS (SELECT query_id, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id, m)::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20""",
    "op11_exact_topk": """
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.n, q.vec_id AS query_id, c.n AS m, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.n <> c.n AND len(q.v) = len(c.v)),
r AS (SELECT query_id, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id, m)::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20""",
}
