"""Queries of the ten problems over the project's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from muster.llm.canonical import map_places
from muster.llm.components import match_groups
from muster.llm.mixing import mix, mixture_shares
from muster.llm.names import name_entities, name_pairs
from muster.llm import near_duplicates
from muster.llm.near_duplicates import near_duplicate_groups
from muster.llm.packing import CAPACITY, pack, token_counts
from muster.llm.pii import find_personal_data, redact_texts
from muster.llm.ranking import robust_ranking
from muster.llm.subjects import document_subjects
from muster.llm.vectors import measured_recall, similar_pairs
from muster.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_pairs(table(spark, sf_dir, "comment_vectors"), "comment_id", "embedding", k=10, min_cosine=0.9)


def _hundredth(c: str) -> Column:
    return F.try_to_number(F.substring_index(c, "-", -1), F.lit("99999999999")) % 100 == 0


def p1_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of the index against brute force, for every comment whose number is divisible by 100."""
    vectors = table(spark, sf_dir, "comment_vectors")
    return measured_recall(vectors, vectors.where(_hundredth("comment_id")), "comment_id", "embedding", k=10, min_cosine=0.9)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_groups(table(spark, sf_dir, "comment_matches"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return map_places(table(spark, sf_dir, "comments"), table(spark, sf_dir, "places"), table(spark, sf_dir, "states"))


def p4_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = ("duplicate", "temporal_coupling", "stylometric", "argument_identity", "ai_detection", "paraphrase_reachable")
    scores = {p: F.col(f"score_breakdown.{p}") for p in parts} | {"campaign_score": F.col("campaign_score")}
    return robust_ranking(table(spark, sf_dir, "clusters"), ["run_id", "cluster_id"], scores)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "comments"), "id", "text").select("id", "kind", "start_pos")


def p5_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact_texts(table(spark, sf_dir, "comments").select("id", "text").distinct(), "id", "text")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(table(spark, sf_dir, "comments"), "id", "text", threshold=0.5)


def p6_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of the groups against brute force, for every comment whose number is divisible by 100."""
    comments = table(spark, sf_dir, "comments")
    return near_duplicates.measured_recall(comments, comments.where(_hundredth("id")), "id", "text", threshold=0.5)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return name_pairs(name_entities(table(spark, sf_dir, "comments")))


def p7_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each spelling with its entity, without expanding entities into pairs."""
    return name_entities(table(spark, sf_dir, "comments"))


def _sizes(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), "doc_id", "text", keep=list(keep))


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_sizes(spark, sf_dir), "id", "n_tokens", CAPACITY).withColumnRenamed("id", "doc_id")


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the contexts are: containers, tokens, the least possible containers, share of room used."""
    packed = pack(_sizes(spark, sf_dir), "id", "n_tokens", CAPACITY)
    boxes = packed.groupBy("container").agg(F.sum("n_tokens").alias("t"))
    return boxes.agg(F.count(F.lit(1)).alias("containers"), F.sum("t").alias("tokens"), F.ceil(F.sum("t") / CAPACITY).alias("least_containers"), F.round(F.sum("t") / (F.count(F.lit(1)) * CAPACITY), 6).alias("fill"), F.max("t").alias("fullest"))


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_sizes(spark, sf_dir, "source"), table(spark, sf_dir, "mix_targets")).withColumnRenamed("id", "doc_id")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes, targets = _sizes(spark, sf_dir, "source"), table(spark, sf_dir, "mix_targets")
    return mixture_shares(sizes, targets, mix(sizes, targets))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_subjects(table(spark, sf_dir, "documents"), table(spark, sf_dir, "subject_labels"), table(spark, sf_dir, "subjects"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_recall, p2_found, p3_found, p4_ranking, p5_found, p5_redacted, p6_found, p6_recall, p7_found, p7_entities, p8_packed, p8_fill, p9_mixture, p9_shares, p10_found)}
