"""Registered queries of the subpackage and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from martwright.llm import (
    fill_middle, filter_audit, language, mixing, near_embeddings, neighbours, pieces, pii, quality, repeats, sharding, simhash, warc,
)
from martwright.llm.common import read

Query = Callable[[SparkSession, str], DataFrame]


def op1_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_digest(read(spark, folder, "documents"))


def op2_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_embeddings.embedding_groups(read(spark, folder, "embeddings"))


def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(read(spark, folder, "documents"))


def op4_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find(read(spark, folder, "documents"))


def op5_warc_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archive_round_trip(read(spark, folder, "pages"))


def op6_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.simhash_groups(read(spark, folder, "documents"))


def op7_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_documents(read(spark, folder, "documents"))


def op8_repeated_strings(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.remove_repeats(read(spark, folder, "documents"))


def op9_sampled_segmentations(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.sample_encode(read(spark, folder, "documents"), samples=2, digest=True)


def op10_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest_neighbours(read(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def op11_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.filter_audit(read(spark, folder, "documents"), read(spark, folder, "labels"))


def op12_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality(read(spark, folder, "documents"), read(spark, folder, "labels"))


def op13_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    return fill_middle.fill_in_middle_digest(read(spark, folder, "documents"))


QUERIES: dict[str, Query] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_embedding_near_dedup": op2_embedding_near_dedup,
    "op3_language_id": op3_language_id,
    "op4_personal_data": op4_personal_data,
    "op5_warc_round_trip": op5_warc_round_trip,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_sharding": op7_sharding,
    "op8_repeated_strings": op8_repeated_strings,
    "op9_sampled_segmentations": op9_sampled_segmentations,
    "op10_nearest_neighbours": op10_nearest_neighbours,
    "op11_filter_audit": op11_filter_audit,
    "op12_quality": op12_quality,
    "op13_fill_in_middle": op13_fill_in_middle,
}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mix_sources": mixing.oracle(),
        "op2_embedding_near_dedup": near_embeddings.oracle(),
        "op5_warc_round_trip": warc.oracle(),
        "op11_filter_audit": filter_audit.oracle(),
        "op13_fill_in_middle": fill_middle.oracle(),
    }
