"""First per key, top-k per group, priority unions, filling and re-ranking. Every order ends in a unique key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def top_k(scores: DataFrame, k: int, seed: str = "seed_id", rec: str = "rec_id", digits: int = 6) -> DataFrame:
    """(seed, rank, rec, score): the k highest scores of each seed, rounded, ties to the smaller rec; the seed itself is left out."""
    rounded = scores.filter(F.col(seed) != F.col(rec)).select(seed, rec, F.round("score", digits).alias("score"))
    rank = F.row_number().over(Window.partitionBy(seed).orderBy(F.desc("score"), F.asc(rec)))
    return rounded.withColumn("rank", rank).filter(F.col("rank") <= k).select(seed, "rank", rec, "score")


def priority_union(sources: list[tuple[str, DataFrame, int]], keep: int, seed: str = "seed_id", rec: str = "rec_id") -> DataFrame:
    """Union of (name, rows with seed, rec and rank, limit): limits first, then the first source that offers a pair wins, then `keep` per seed."""
    union = None
    for i, (name, df, limit) in enumerate(sources):
        own = df.filter(F.col("rank") <= limit).select(seed, rec, F.lit(i).alias("source_order"), F.col("rank").alias("source_rank"), F.lit(name).alias("candidate_source"))
        union = own if union is None else union.unionByName(own)
    once = first_per_key(union, [seed, rec], F.asc("source_order"), F.asc("source_rank"))
    rank = F.row_number().over(Window.partitionBy(seed).orderBy("source_order", "source_rank", rec))
    return once.withColumn("rank", rank).filter(F.col("rank") <= keep).select(seed, "rank", rec, "candidate_source")


def fill_to_k(ranked: DataFrame, candidates: DataFrame, k: int, label: int = 1, score: int = 4) -> DataFrame:
    """ranked (seed_id, rec_id, score_10, label, rank) filled up with unseen candidates (seed_id, rec_id, pos) in their order."""
    unseen = candidates.join(ranked.select("seed_id", "rec_id"), ["seed_id", "rec_id"], "left_anti")
    have = ranked.groupBy("seed_id").agg(F.max("rank").alias("have"))
    extra = unseen.join(have, "seed_id", "left").withColumn("n", F.row_number().over(Window.partitionBy("seed_id").orderBy("pos", "rec_id")))
    extra = extra.select("seed_id", "rec_id", F.lit(score).alias("score_10"), F.lit(label).alias("label"), (F.coalesce("have", F.lit(0)) + F.col("n")).alias("rank"))
    return ranked.select("seed_id", "rec_id", "score_10", "label", "rank").unionByName(extra).filter(F.col("rank") <= k)


def rerank(rows: DataFrame, k: int) -> DataFrame:
    """Ranks anew by score, label, and the old rank."""
    rank = F.row_number().over(Window.partitionBy("seed_id").orderBy(F.desc("score_10"), F.desc("label"), F.asc("rank"), F.asc("rec_id")))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k)
