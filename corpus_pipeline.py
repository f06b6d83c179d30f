"""The corpus pipeline: each stage applies one operator to all that its predecessor kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next one's docs. All but the last return the columns of documents; the last returns each text's encoding.

In every stage a null text counts as empty but stays null in what is handed on; a row with a null id, and rows that repeat an id or a text, are
rows like any other (near duplicates but for copies of a text, of which one row stays); further columns of any name are left out; an empty table
gives an empty one; a text of any length is read whole. Ties are broken by the least doc_id, then by the text's digest.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from siltflow.llm import bpe, decontaminate, jaccard_forest, pii, quality
from siltflow.llm.shared import only, table, work_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. Empty texts are judged like others, by features that are all 0; without labels all stay."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, that of the least doc_id. Null and empty texts are copies of one another; a text of fewer
    than five words is one shingle, so that it is near to texts of exactly its words alone."""
    return jaccard_forest.keep_one(only(docs, *COLUMNS))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go, each judged by its own text. A text or item without words contains, or is in, nothing."""
    return decontaminate.decontaminate(only(docs, *COLUMNS), table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked; n_chars follows the text. Null texts stay null, and so does their n_chars; every row stays."""
    return pii.mask(only(docs, *COLUMNS))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each text is encoded and decoded: doc_id, n_tokens and the digests of both. Null and empty texts have no ids, and the digests of nothing."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("encoding", encoding_stage),
]

#: The trained classifier and the random field can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each but the last written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{work_dir(spark)}/stage-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
