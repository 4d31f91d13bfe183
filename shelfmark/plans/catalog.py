"""The item catalog that the queries run over, made of the driver's tables; and the same as SQL.

Expressions are valid in both dialects. Blanks, odd values and untidy lists
are made from the keys, since the tables have none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_S = "CAST({} AS STRING)"
COLUMNS = {
    "id": "CAST(p_partkey AS STRING)",
    "title_romaji": "concat(p_name, CASE p_partkey % 4 WHEN 0 THEN ' (TV)' WHEN 1 THEN ': Season 2' WHEN 2 THEN '' ELSE ' Movie' END)",
    "title_english": "CASE WHEN p_partkey % 7 = 0 THEN '' ELSE upper(p_name) END",
    "title_native": "CASE WHEN p_partkey % 2 = 0 THEN '' ELSE concat(p_brand, '  ', p_name) END",
    "format": "CASE p_partkey % 9 WHEN 0 THEN 'TV' WHEN 1 THEN 'MOVIE' WHEN 2 THEN 'OVA' WHEN 3 THEN 'ONA' WHEN 4 THEN '' WHEN 5 THEN 'RADIO' WHEN 6 THEN ' TV' ELSE 'SPECIAL' END",
    "source": "coalesce(source, '')",
    "episodes": "CASE WHEN p_size % 11 = 0 THEN '' WHEN p_size % 13 = 0 THEN 'nan' ELSE CAST(p_size * 40 AS STRING) END",
    "duration": "CAST(p_size * 5 - 10 AS STRING)",
    "status": "CASE p_partkey % 5 WHEN 0 THEN 'FINISHED' WHEN 1 THEN 'RELEASING' WHEN 2 THEN 'CANCELLED' WHEN 3 THEN '' ELSE 'PAUSED' END",
    "season": "CASE p_partkey % 6 WHEN 0 THEN 'SPRING' WHEN 1 THEN 'SUMMER' WHEN 2 THEN 'FALL' WHEN 3 THEN 'WINTER' WHEN 4 THEN '' ELSE 'MONSOON' END",
    "seasonYear": "CAST(1930 + p_size * 2 AS STRING)",
    "end_date": "CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '2001-02' END",
    "averageScore": "CASE WHEN p_partkey % 10 = 0 THEN '' ELSE CAST(p_size * 3 - 5 AS STRING) END",
    "meanScore": "CASE WHEN p_partkey % 8 = 0 THEN '' ELSE CAST(p_size * 2 AS STRING) END",
    "popularity": "coalesce(n_sold, 0)",
    "favourites": "CAST(p_partkey % 6 AS STRING)",
    "genres": "CASE WHEN p_partkey % 17 = 0 THEN '' ELSE concat(' ', p_type, ' | S', CAST(p_size % 5 AS STRING), '||', p_type) END",
    "tags": "concat(replace(p_name, ' ', '|'), '|', p_brand, '|K', CAST(p_partkey % 5 AS STRING), '|M', CAST(p_partkey % 3 AS STRING), '| N', CAST(p_partkey % 11 AS STRING), ' ')",
    "studios": "p_brand",
    "description": "coalesce(text, '')",
    "cover_image": "CASE WHEN p_partkey % 19 = 0 THEN '' ELSE concat('img/', p_name) END",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    sold = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n_sold"))
    # by merge: texts are large, and the text functions above the join need its partitions
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source").hint("merge")
    joined = table(spark, sf_dir, "part").join(sold, F.col("l_partkey") == F.col("p_partkey"), "left").join(docs, F.col("doc_id") == F.col("p_partkey"), "left")
    return joined.select(*[F.expr(e).alias(c) for c, e in COLUMNS.items()])


ITEM = "item AS (SELECT " + ", ".join(f'{e} AS "{c}"' for c, e in COLUMNS.items()) + """
 FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n_sold FROM lineitem GROUP BY 1) ON l_partkey = p_partkey LEFT JOIN documents ON doc_id = p_partkey)"""
