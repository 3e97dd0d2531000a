"""From raw documents to packed training sequences, in five stages.

Each stage takes what the one before it kept and returns documents, but for the
last, which returns the packed pieces. Null and empty texts, texts of any length, repeated
rows, null ids and an empty table go through all of them; columns beyond those of
documents are dropped by the first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tillroll.llm.common import open_table
from tillroll.llm.jaccard import distinct_documents
from tillroll.llm.mixing import mixed_documents
from tillroll.llm.packing import pack_documents
from tillroll.llm.privacy import sanitise
from tillroll.llm.quality import fit_quality, graded, select_quality
from tillroll.session import freeze, release

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents, with the length of the text as it now is."""
    n_chars = F.coalesce(F.length("text").cast("bigint"), F.col("n_chars"))
    return df.withColumn("n_chars", n_chars).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are likelier good than not go on; the others are dropped."""
    model = fit_quality(docs, graded(open_table(spark, sf_dir, "labels")))
    return _documents(select_quality(docs, model))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id goes on."""
    return _documents(distinct_documents(docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents go on, with personal data masked and disclosing terms generalised."""
    return _documents(sanitise(docs))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix reads goes on, in training order: once, twice, in part, or not at all."""
    return _documents(mixed_documents(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as token pieces, packed into sequences."""
    return pack_documents(docs)


STAGES = [
    ("quality_classifier", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("personal_data", personal_data),
    ("mixing", mixing),
    ("best_fit_packing", packing),
]

# The classifier is fitted, so no SQL gives its decisions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written and read again by the next."""
    docs = open_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        made = stage(spark, docs, sf_dir)
        docs = freeze(made, f"stage-{name}")
        # What the stage read is done with: the documents before it and its own tables.
        release(made)
    return STAGES[-1][1](spark, docs, sf_dir)
