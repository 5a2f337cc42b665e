"""The registered queries of the operators: each applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arenaflow.llm import (
    bpe, chosen_path, collocations, ctph, html_text, line_dedup, merkle, mixing, neighbours, packing, simhash, sql, token_counts, toxicity)

WORDS = "word_bpe_49k.json"
BYTES = "byte_bpe_50k.json"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    return bpe.round_trip(documents, public_tokenizers.path(WORDS)).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op2_simhash_groups(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_groups(table(spark, folder, "documents"))


def op3_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), public_tokenizers.path(WORDS))


def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    return token_counts.count_tokens(documents, public_tokenizers.path(BYTES)).select(
        "doc_id", "n_bytes", "n_tokens", "over_limit")


def op4_piecewise_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return ctph.compare_edited(table(spark, folder, "documents"))


def op6_context_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.score_documents(table(spark, folder, "documents").select("doc_id", "text"))


def op7_projected_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return neighbours.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def op8_main_text(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    return html_text.extract(pages, html_text.fit(pages)).select("page_id", "url", "text", "n_chars")


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op10_fuzzy_lines(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.mark_lines(table(spark, folder, "documents")).drop("_row")


def op11_chosen_path_groups(spark: SparkSession, folder: str) -> DataFrame:
    return chosen_path.near_duplicates(table(spark, folder, "documents"), size=2, similarity=(80, 100))


def op12_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return merkle.manifest(
        table(spark, folder, "documents"), doubted=F.crc32(F.col("doc_id").cast("string")) % 5 == 0,
        claims={"text": F.translate("text", upper, lower)})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    builder.__name__: builder
    for builder in (
        op1_bpe_round_trip, op2_simhash_groups, op3_best_fit_packing, op4_piecewise_fingerprints, op5_token_counts,
        op6_context_mixing, op7_projected_neighbours, op8_main_text, op9_toxicity,
        op10_fuzzy_lines, op11_chosen_path_groups, op12_phrase_collocations,
        op13_merkle_manifest)
}
#: SQL for those that SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op11_chosen_path_groups": sql.CHOSEN_PATH_GROUPS,
    "op12_phrase_collocations": sql.PHRASE_COLLOCATIONS, "op13_merkle_manifest": sql.MERKLE_MANIFEST}
