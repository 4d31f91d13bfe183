"""Set overlap: Jaccard scores and the candidate sources, joined on set elements rather than on all pairs.

Items have id, pos (their place by popularity), popularity, title_key and the arrays genre_set and tag_set.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions import text as X
from shelfmark.operators import blocks
from shelfmark.operators.topk import priority_union

SEEDS, POOL, KEEP = 100, 10_000, 40
LIMITS = {"thematic_overlap": 28, "same_franchise_candidate": 5, "partial_overlap": 12, "popular_fallback": 12}


def prepared(items: DataFrame) -> DataFrame:
    """Items with genres, description and a title; their sets and place by popularity."""
    usable = items.filter(~X.is_blank("genres") & ~X.is_blank("description") & ~X.is_blank("title_romaji"))
    rows = usable.select("id", "popularity", X.franchise_key(X.preferred_title()).alias("title_key"), X.list_set("genres").alias("genre_set"), X.list_set("tags").alias("tag_set"))
    return ranked(rows)


def ranked(rows: DataFrame) -> DataFrame:
    """pos: 1 for the most popular. Ranked within ranges of popularity and moved on by the ranges' sizes, so no task sorts all rows."""
    bucket = F.floor(F.log2(F.greatest(F.col("popularity"), F.lit(0)) + F.lit(1.0)) * 64).cast("long")
    local = rows.withColumn("__bucket", bucket).withColumn("__n", F.row_number().over(Window.partitionBy("__bucket").orderBy(F.desc("popularity"), "id")))
    sizes = local.groupBy("__bucket").agg(F.max("__n").alias("__size"))  # some thousand rows at most
    before = sizes.select("__bucket", (F.sum("__size").over(Window.orderBy(F.desc("__bucket"))) - F.col("__size")).alias("__before"))
    return local.join(F.broadcast(before), "__bucket").withColumn("pos", F.col("__before") + F.col("__n")).drop("__bucket", "__n", "__before")


def shared(seeds: DataFrame, items: DataFrame, column: str, name: str) -> DataFrame:
    """(seed_id, rec_id, n): how many elements of a set the pair shares, for pairs that share one."""
    left = seeds.select(F.col("id").alias("seed_id"), F.explode(column).alias("x"))
    right = items.select(F.col("id").alias("rec_id"), F.explode(column).alias("x"))
    return left.join(right, "x").filter("seed_id <> rec_id").groupBy("seed_id", "rec_id").agg(F.count(F.lit(1)).alias(name))


def overlap(seeds: DataFrame, pool: DataFrame, genres: int, tags: int, genre_weight: int, limit: int) -> DataFrame:
    """Pairs of different franchises that share enough genres and tags, by weighted overlap and popularity."""
    both = shared(seeds, pool, "genre_set", "g").filter(F.col("g") >= genres).join(shared(seeds, pool, "tag_set", "t").filter(F.col("t") >= tags), ["seed_id", "rec_id"])
    keys = both.join(seeds.select(F.col("id").alias("seed_id"), F.col("title_key").alias("sk")), "seed_id").join(pool.select(F.col("id").alias("rec_id"), F.col("title_key").alias("rk"), "popularity", "pos"), "rec_id")
    rank = F.row_number().over(Window.partitionBy("seed_id").orderBy(F.desc(genre_weight * F.col("g") + F.col("t")), F.desc("popularity"), F.asc("pos")))
    return keys.filter("sk <> rk").withColumn("rank", rank).filter(F.col("rank") <= limit).select("seed_id", "rank", "rec_id")


def franchise(seeds: DataFrame, items: DataFrame, limit: int) -> DataFrame:
    """Other items of the seed's franchise, from the whole catalog, by popularity."""
    left = seeds.filter(X.useful_franchise(F.col("title_key"))).select(F.col("id").alias("seed_id"), "title_key")
    pairs = left.join(items.select(F.col("id").alias("rec_id"), "title_key", "pos"), "title_key").filter("seed_id <> rec_id")
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("seed_id").orderBy("pos"))).filter(F.col("rank") <= limit).select("seed_id", "rank", "rec_id")


def popular(seeds: DataFrame, pool: DataFrame, limit: int) -> DataFrame:
    """The most popular items of other franchises.

    Only a franchise's first `limit` items can be asked for, and a seed leaves
    out one franchise; so the first 2 * limit of those answer every seed.
    """
    per_key = F.row_number().over(Window.partitionBy("title_key").orderBy("pos"))
    head = pool.withColumn("k", per_key).filter(F.col("k") <= limit).orderBy("pos").limit(2 * limit).select(F.col("id").alias("rec_id"), F.col("title_key").alias("rk"), "pos")
    pairs = seeds.select(F.col("id").alias("seed_id"), F.col("title_key").alias("sk")).crossJoin(F.broadcast(head)).filter("seed_id <> rec_id AND sk <> rk")
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("seed_id").orderBy("pos"))).filter(F.col("rank") <= limit).select("seed_id", "rank", "rec_id")


def candidates(items: DataFrame, n_seeds: int = SEEDS, n_pool: int = POOL, keep: int = KEEP) -> DataFrame:
    """(seed_id, rank, rec_id, candidate_source): the four sources in order of priority, each pair once."""
    seeds, pool = items.filter(F.col("pos") <= n_seeds), items.filter(F.col("pos") <= n_pool)
    return priority_union([
        ("thematic_overlap", overlap(seeds, pool, 2, 4, 12, LIMITS["thematic_overlap"]), LIMITS["thematic_overlap"]),
        ("same_franchise_candidate", franchise(seeds, items, LIMITS["same_franchise_candidate"]), LIMITS["same_franchise_candidate"]),
        ("partial_overlap", overlap(seeds, pool, 1, 1, 8, LIMITS["partial_overlap"]), LIMITS["partial_overlap"]),
        ("popular_fallback", popular(seeds, pool, LIMITS["popular_fallback"]), LIMITS["popular_fallback"]),
    ], keep)


def candidate_rows(items: DataFrame, chosen: DataFrame) -> DataFrame:
    """The columns of a candidate file: chosen pairs (seed_id, rank, rec_id, candidate_source) with the attributes of both; in order of rank within a seed."""
    side = lambda name: items.select(F.col("id").alias(f"{name}_id"), X.preferred_title().alias(f"{name}_title"), X.text("genres").alias(f"{name}_genres"), X.text("tags").alias(f"{name}_tags"), X.truncate_words("description", 450).alias(f"{name}_description"))
    pairs = chosen.select("seed_id", "rank", F.col("rec_id").alias("candidate_id"), "candidate_source")
    # few pairs and all items: attributes are looked up, never the other way round
    rows = pairs.join(side("seed"), "seed_id").join(side("candidate"), "candidate_id")
    columns = [f"{name}_{c}" for name in ("seed", "candidate") for c in ("id", "title", "genres", "tags", "description")]
    return rows.select("rank", *columns, "candidate_source")


def set_vectors(items: DataFrame, column: str, name: str) -> DataFrame:
    """(id, <name>_t, <name>_w): a set as a vector of ones."""
    return items.select("id", F.col(column).alias(f"{name}_t"), F.transform(column, lambda _: F.lit(1.0)).alias(f"{name}_w"))


def jaccard_best(items: DataFrame, seeds: DataFrame, column: str, k: int) -> DataFrame:
    """(seed_id, rec_id, score): the items of highest overlap with each seed, of those that share an element."""
    rows = set_vectors(items, column, "set")
    return blocks.best_of(rows, rows.join(seeds.select("id"), "id", "left_semi"), {"set": "jaccard"}, k)
