"""The operators as queries over whole tables, with production parameters, and the SQL of those that have any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mixing, packing, rank_profiles, repetition, shards, simhash, suffix_tree, voronoi_knn, warc, weak_quality

#: Target weights of sources; those not listed weigh 1.
WEIGHTS = {"src0": 2.0, "src1": 6.0, "src2": 3.0, "src3": 0.5}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_tree_lm(spark, sf_dir):
    return suffix_tree.suffix_tree_scores(_table(spark, sf_dir, "documents"))


def op2_source_mixing(spark, sf_dir):
    return mixing.mixture(_table(spark, sf_dir, "documents"), WEIGHTS)


def op3_suffix_array_repetition(spark, sf_dir):
    return repetition.repetition(_table(spark, sf_dir, "documents"))


def op4_simhash_near_dedup(spark, sf_dir):
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_warc_round_trip(spark, sf_dir):
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op6_tiered_compaction(spark, sf_dir):
    return shards.stored_with_state(_table(spark, sf_dir, "documents"))


def op7_rank_order_language(spark, sf_dir):
    return rank_profiles.identified(_table(spark, sf_dir, "documents"))


def op8_voronoi_knn(spark, sf_dir):
    """Of every vector whose id is divisible by 100 the neighbours among all."""
    return voronoi_knn.neighbours(_table(spark, sf_dir, "embeddings"), queries=F.col("vec_id") % 100 == 0).withColumn("distance", F.round("distance", 9))


def op9_vector_best_fit(spark, sf_dir):
    return packing.packed(_table(spark, sf_dir, "documents"))


def op10_weak_label_quality(spark, sf_dir):
    return weak_quality.quality_scores(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_suffix_tree_lm, op2_source_mixing, op3_suffix_array_repetition, op4_simhash_near_dedup, op5_warc_round_trip, op6_tiered_compaction, op7_rank_order_language, op8_voronoi_knn, op9_vector_best_fit, op10_weak_label_quality)}
SQL = {
    "op2_source_mixing": mixing.sql(WEIGHTS),
    "op5_warc_round_trip": warc.sql(),
    "op6_tiered_compaction": "SELECT doc_id, text, lang, source, n_chars, (SELECT count(*) FROM documents) AS manifest_rows, true AS within_target, true AS settled FROM documents",
    "op7_rank_order_language": rank_profiles.sql(),
    "op8_voronoi_knn": voronoi_knn.sql(),
}
