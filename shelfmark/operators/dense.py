"""Dense vectors: dot products of seeds with all items, an encoder protocol and a validated cache."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.operators import blocks

TEXT_VERSION = "content-v1"


def dot_best(vectors: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """(seed_id, rec_id, score): the vectors (id, embedding) with the highest inner products with each seed's, in double precision."""
    rows = lambda df: df.select("id", F.col("embedding").cast("array<double>").alias("dense_w"))
    return blocks.best_of(rows(vectors), rows(seeds), {"dense": "dense"}, k, lambda *_: lambda seeds_, scores: scores["dense"])


def encode(items: DataFrame, text: str, encoder: Callable[[list[str]], np.ndarray], batch: int = 64) -> DataFrame:
    """(id, embedding): the encoder's vectors of the texts, scaled to unit length, in batches."""
    schema = T.StructType([items.schema["id"], T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in range(0, len(frame), batch):
                part = frame.iloc[i : i + batch]
                v = np.asarray(encoder(part["__text"].tolist()), np.float32)
                norm = np.linalg.norm(v, axis=1, keepdims=True)
                yield pd.DataFrame({"id": part["id"].to_numpy(), "embedding": list(v / np.where(norm == 0, 1, norm))})

    return items.select("id", F.coalesce(text, F.lit("")).alias("__text")).mapInPandas(run, schema)


def fingerprint(items: DataFrame) -> tuple[int, int]:
    """Number and order-free checksum of the ids."""
    row = items.agg(F.count(F.lit(1)), F.sum(F.xxhash64("id").cast("decimal(38,0)"))).first()
    return row[0], int(row[1] or 0)


def cached(items: DataFrame, path: str, model: str, build: Callable[[DataFrame], DataFrame], version: str = TEXT_VERSION) -> DataFrame:
    """Vectors from the cache at path if ids, text version and model agree with its metadata; else built and stored."""
    spark = items.sparkSession
    n, mark = fingerprint(items)
    try:
        known = [tuple(r) for r in spark.read.parquet(f"{path}/meta").select("model", "version", "n", "mark").collect()]
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        known = []
    if known != [(model, version, n, str(mark))]:
        build(items).write.mode("overwrite").parquet(f"{path}/vectors")
        spark.createDataFrame([(model, version, n, str(mark))], "model string, version string, n long, mark string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
    return spark.read.parquet(f"{path}/vectors")
