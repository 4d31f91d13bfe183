"""Catalog files: scans with fixed string schemas, appending and overwriting sinks, resume helpers."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions import text as X

#: The columns of a raw item, of judged rows, of candidates and of the preview.
ITEM_COLUMNS = ["id", "idMal", "title_romaji", "title_english", "title_native", "type", "format", "source", "episodes", "duration", "status", "season", "seasonYear", "start_date", "end_date", "averageScore", "meanScore", "popularity", "favourites", "genres", "tags", "studios", "description", "cover_image", "isAdult"]
JUDGED_COLUMNS = ["seed_id", "seed_title", "rank", "recommended_id", "recommended_title", "similarity_label", "similarity_score_10", "reason", "seed_genres", "recommended_genres", "seed_tags", "recommended_tags"]
CANDIDATE_COLUMNS = ["seed_id", "seed_title", "seed_genres", "seed_tags", "seed_description", "candidate_id", "candidate_title", "candidate_genres", "candidate_tags", "candidate_description", "candidate_source"]
PREVIEW = ["id", "title_romaji", "title_english", "format", "source", "episodes", "status", "seasonYear", "averageScore", "popularity", "genres", "studios", "isAdult"]


def read_strings(spark: SparkSession, path: str, columns: list[str] = ITEM_COLUMNS, na_tokens: bool = True) -> DataFrame:
    """A CSV with header as strings without nulls; the usual tokens for "not available" become blank."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    df = spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"', enforceSchema=False)
    return df.select([(X.na_to_blank(c) if na_tokens else X.text(c)).alias(c) for c in columns])


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Items with id and title, and numeric copies of popularity and score."""
    df = read_strings(spark, path).filter(~X.is_blank("id") & ~X.is_blank("title_romaji"))
    number = lambda c: F.coalesce(X.to_num(c), F.lit(0.0))
    return df.withColumns({"popularity_num": number("popularity"), "average_score_num": number("averageScore")})


def read_judgements(spark: SparkSession, path: str) -> DataFrame:
    """Judgements; a label that is no number counts as 0."""
    df = read_strings(spark, path, JUDGED_COLUMNS)
    return df.withColumn("similarity_label", F.coalesce(X.to_num("similarity_label").cast("int"), F.lit(0)))


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    return read_strings(spark, path, CANDIDATE_COLUMNS)


def existing(spark: SparkSession, path: str, columns: list[str] = ITEM_COLUMNS) -> DataFrame:
    """What a former run left, or no rows."""
    try:
        return read_strings(spark, path, columns)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in columns]))


def existing_ids(spark: SparkSession, path: str) -> DataFrame:
    return existing(spark, path).select("id").filter(F.col("id").rlike("^[0-9]+$")).distinct()


def count_rows(spark: SparkSession, path: str) -> int:
    """Records, not lines."""
    return existing(spark, path).count()


def size_mb(path: str) -> float:
    """Size of a local file, or of the files of a folder; 0 if there is none."""
    if os.path.isdir(path):
        return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names) / 1e6
    return os.path.getsize(path) / 1e6 if os.path.exists(path) else 0.0


def append(df: DataFrame, path: str, columns: list[str] = ITEM_COLUMNS) -> None:
    """Add rows; columns that the file does not have are left out, and missing ones are blank."""
    df.select([(X.text(c) if c in df.columns else F.lit("")).alias(c) for c in columns]).write.mode("append").csv(path, header=True, escape='"', emptyValue="")


def overwrite(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    (df.select(*columns) if columns else df).write.mode("overwrite").csv(path, header=True, escape='"', emptyValue="")


def append_audit(records: DataFrame, path: str) -> None:
    """One JSON line per record (annotate.audit_records)."""
    records.write.mode("append").json(path)


def preview(df: DataFrame, rows: int = 20, width: int = 28) -> None:
    df.select([X.truncate(c, width).alias(c) for c in PREVIEW if c in df.columns]).show(rows, truncate=False)
