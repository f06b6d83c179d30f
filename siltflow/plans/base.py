"""How the driver tables stand in for the engine's own: corpus pages, signals and the like."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import retrieval
from ..storage import bounded_batches, fingerprint, work_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table. Whole texts go to Python in batches of few rows, so that a worker's memory doesn't grow with the table."""
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as corpus pages: the first line is the title, the source the section, the language the kind; every 50th is an overview."""
    d = table(spark, sf_dir, "documents").where("doc_id is not null")
    return d.select(
        F.col("doc_id").alias("url"), F.substring_index("text", "\n", 1).alias("title"), "text", F.col("source").alias("section"), F.col("lang").alias("kind"), (F.col("doc_id") % 50 == 0).alias("overview")
    )


def indexed(spark: SparkSession, sf_dir: str) -> retrieval.Index:
    """The search index of corpus(), built once for many queries: stored in the shared folder under what its files look like and the code that
    made it, so that it is built anew when either changes. Its manifest is written last, so a half-built index is never read."""
    pages = corpus(spark, sf_dir)
    store = f"{work_dir(spark)}/index-{retrieval.version()}-{fingerprint(spark, f'{sf_dir}/documents.parquet')}"
    return retrieval.stored(pages, store) or retrieval.build(pages, store)


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, body): documents as quotes are looked for in them."""
    return table(spark, sf_dir, "documents").where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("body"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """benchmark items as queries."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")


#: The same views in SQL, and the stemmer in layers over the distinct words; a query adds its own CTEs after them.
SQL_CORPUS = """
corpus AS (SELECT doc_id AS url, string_split(text, chr(10))[1] AS title, text, source AS section, lang AS kind, doc_id % 50 = 0 AS overview FROM documents),
questions AS (SELECT item_id AS qid, text FROM benchmark)"""


def sql_stems(words: str) -> str:
    """CTEs that give stems(word, term) for the distinct words of a table words(word)."""
    return f"""
stem1 AS (SELECT word, CASE WHEN length(word) > 4 AND word LIKE '%ies' THEN left(word, -3) || 'y'
  WHEN length(word) > 4 AND regexp_matches(word, '(s|x|z|ch|sh)es$') THEN left(word, -2)
  WHEN length(word) > 3 AND word LIKE '%s' AND word NOT LIKE '%ss' THEN left(word, -1) ELSE word END AS t FROM (SELECT DISTINCT word FROM {words})),
stem2 AS (SELECT word, CASE WHEN length(t) > 4 AND t LIKE '%ing' THEN left(t, -3) WHEN length(t) > 4 AND t LIKE '%ed' THEN left(t, -2) ELSE t END AS t FROM stem1),
stem3 AS (SELECT word, CASE WHEN length(t) > 4 AND t LIKE '%e' THEN left(t, -1) ELSE t END AS t FROM stem2),
stems AS (SELECT word, CASE WHEN length(t) > 1 AND right(t, 1) = left(right(t, 2), 1) AND contains('bdgklmnprt', right(t, 1)) THEN left(t, -1) ELSE t END AS term FROM stem3)"""
