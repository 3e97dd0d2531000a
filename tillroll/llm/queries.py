"""The corpus operators applied to their whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tillroll.llm import sql
from tillroll.llm.circulant import circulant_duplicates
from tillroll.llm.codes import code_report
from tillroll.llm.common import open_table
from tillroll.llm.manifest import tamper_report
from tillroll.llm.neighbours import nearest
from tillroll.llm.jaccard import near_duplicates
from tillroll.llm.privacy import personal_data, span_report
from tillroll.llm.fingerprints import fingerprint_edits
from tillroll.llm.quality import fit_quality, graded, score_quality
from tillroll.llm.toxicity import fit_toxicity, score_toxicity
from tillroll.llm.mixing import by_position, mix
from tillroll.llm.sharding import shard_records
from tillroll.llm.packing import pack_documents
from tillroll.llm.token_counts import token_counts


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(open_table(spark, sf_dir, "documents"), limit=512)



def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(open_table(spark, sf_dir, "documents"))



def op3_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_records(open_table(spark, sf_dir, "documents"))



def op2_curriculum_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix(open_table(spark, sf_dir, "documents"))
    columns = ("doc_id", "size", "source_size", "target", "taken", "position", "second_position")
    return by_position(plan.select(*columns), "doc_id")



def op1_factorization_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = open_table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_toxicity(docs, open_table(spark, sf_dir, "labels")))



def op4_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = open_table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, graded(open_table(spark, sf_dir, "labels"))))



def op5_quartile_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(open_table(spark, sf_dir, "documents"))



def op9_disclosure_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_report(personal_data(open_table(spark, sf_dir, "documents")))



def op10_grouped_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(open_table(spark, sf_dir, "documents"))



def op6_kmeans_tree_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(open_table(spark, sf_dir, "embeddings"), every=20, k=20)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tamper_report(open_table(spark, sf_dir, "documents"))


def op11_hilbert_block_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_report(open_table(spark, sf_dir, "embeddings"))


def op12_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return circulant_duplicates(open_table(spark, sf_dir, "documents"))


QUERIES = {
    "op12_circulant_minhash": op12_circulant_minhash,
    "op11_hilbert_block_codes": op11_hilbert_block_codes,
    "op13_merkle_manifest": op13_merkle_manifest,
    "op6_kmeans_tree_neighbours": op6_kmeans_tree_neighbours,
    "op10_grouped_prefix_join": op10_grouped_prefix_join,
    "op9_disclosure_pii": op9_disclosure_pii,
    "op5_quartile_fingerprints": op5_quartile_fingerprints,
    "op4_ordinal_quality": op4_ordinal_quality,
    "op1_factorization_toxicity": op1_factorization_toxicity,
    "op2_curriculum_mixing": op2_curriculum_mixing,
    "op3_rendezvous_sharding": op3_rendezvous_sharding,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op7_token_counts": op7_token_counts,
}

ORACLE_SQL: dict[str, str] = {
    "op2_curriculum_mixing": sql.MIXING,
    "op3_rendezvous_sharding": sql.SHARDING,
    "op11_hilbert_block_codes": sql.CODES,
    "op13_merkle_manifest": sql.MANIFEST,
}
