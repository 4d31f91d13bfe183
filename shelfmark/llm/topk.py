"""Exact top-k by inner product with Fagin's threshold algorithm.

Vectors are dealt into shards of about `shard_rows`, queries into blocks of at
most about `block_rows`; each pair of shard and block is a task. A shard sorts
its rows by each dimension. A query reads the lists from the end where its
weight makes the largest products, in rounds of doubling depth; the rows that
it meets there for the first time are scored in full, no others, and it stops
when the sum of the products at the depth reached can't beat its kth score.
The shards' few rows per query are ranked at the end.

Scores are whole numbers and exact: doubles where every product and sum stays
within 2**53, else 64-bit integers, else Python's. A score beyond the range of
a long counts as its nearer end, for the ranking too.

Vectors that are null, or have null or non-finite components, and rows without
id take no part. Vectors of other lengths than the query's aren't candidates.
Rows that share the query's id aren't candidates; other repeated rows each
are. Of repeated query rows the smallest vector counts. Ties go to the smaller
id. Empty tables give no rows. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import table

LONG = (1 << 63) - 1


def exact(rows: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both, whole numbers as doubles, in a type in which their inner products are exact."""
    largest = rows.shape[1] * int(np.abs(rows).max(initial=0)) * int(np.abs(queries).max(initial=0))
    if largest < 1 << 53:
        return rows, queries
    if largest <= LONG:
        return rows.astype(np.int64), queries.astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    return whole(rows), whole(queries)


def threshold_search(rows: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int, first_depth: int = 16) -> Iterator[tuple[np.ndarray, list[int], int]]:
    """For each query the places and scores of its k best rows, and how many rows it met. rows and queries come from exact()."""
    n = len(rows)
    order = np.argsort(rows, axis=0, kind="stable")
    ranked = np.take_along_axis(rows, order, axis=0)
    scores, met = np.zeros(n, rows.dtype), np.zeros(n, bool)
    for query, id_ in zip(queries, own, strict=True):
        met[:] = False
        up, down = query > 0, query < 0
        able, low, depth = ids != id_, 0, min(n, first_depth)
        if not (up.any() or down.any()):  # all scores are zero
            depth = n
        while True:
            seen = np.zeros(n, bool)
            seen[order[n - depth : n - low, up]] = True
            seen[order[low:depth, down]] = True
            new = np.flatnonzero((seen | (depth == n)) & ~met)
            scores[new] = within_long(rows[new] @ query)
            met[new] = True
            have = np.flatnonzero(met & able)
            if depth == n:
                break
            if len(have) >= k:
                bound = (query[up] * ranked[n - depth, up]).sum() + (query[down] * ranked[depth - 1, down]).sum()
                if kth(scores[have], k) > bound:
                    break
            low, depth = depth, min(n, 2 * depth)
        if len(have) > k:
            have = have[scores[have] >= kth(scores[have], k)]
        found = [int(x) for x in scores[have]]
        best = sorted(range(len(have)), key=lambda i: (-found[i], ids[have[i]]))[:k]
        yield have[best], [found[i] for i in best], int(met.sum())


def within_long(scores: np.ndarray) -> np.ndarray:
    return np.array([max(-LONG - 1, min(LONG, x)) for x in scores], object) if scores.dtype == object else scores


def kth(scores: np.ndarray, k: int):
    """The kth highest score."""
    return sorted(scores.tolist())[-k] if scores.dtype == object else np.partition(scores, len(scores) - k)[len(scores) - k]


def whole_numbers(vectors: list, scale: float) -> np.ndarray:
    return np.floor(scale * np.array([np.asarray(v, np.float64) for v in vectors]).reshape(len(vectors), -1))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0, shard_rows: int = 1024, block_rows: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score) of vectors (vec_id, embedding) for queries of the same form."""
    def usable(df: DataFrame) -> DataFrame:
        fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        return df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter("vec_id IS NOT NULL AND embedding IS NOT NULL").filter(F.coalesce(fine, F.lit(False)))

    left, right = usable(vectors), usable(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    shards, blocks = max(1, -(-left.count() // shard_rows)), max(1, -(-right.count() // block_rows))
    dealt = left.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = right.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))

    def search(key: tuple, mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        found = {"query_id": [], "vec_id": [], "score": []}
        for dims, own in theirs.groupby(theirs["embedding"].map(len)) if len(theirs) and len(mine) else ():
            same = mine[mine["embedding"].map(len) == dims]
            if not len(same):
                continue
            x, q = whole_numbers(same["embedding"].tolist(), scale), whole_numbers(own["embedding"].tolist(), scale)
            ids, own_ids = same["vec_id"].to_numpy(), own["vec_id"].to_numpy()
            x, q = exact(x, q)
            for id_, (places, scores, _) in zip(own_ids, threshold_search(x, ids, q, own_ids, k), strict=True):
                found["query_id"] += [id_] * len(places)
                found["vec_id"] += ids[places].tolist()
                found["score"] += scores
        return pd.DataFrame(found).astype("int64")

    local = dealt.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInPandas(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return local.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_exact_topk(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(rows, rows.filter("vec_id % 50 = 0"))


OP6_SQL = """
WITH v AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(coalesce(list_sum([p[1] * p[2] FOR p IN list_zip(q.e, v.e)]), 0) AS BIGINT) AS score
      FROM v AS q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
