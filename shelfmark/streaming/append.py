"""Page-by-page arrival as a stream: new rows are appended once, whatever is replayed."""

from __future__ import annotations

from pyspark.sql import DataFrame


def append_new(stream: DataFrame, path: str, key: str, checkpoint: str):
    """Append to the Parquet folder `path` the rows of a stream whose key is not there yet; each batch once per key."""
    spark = stream.sparkSession

    def save(batch: DataFrame, batch_id: int) -> None:
        fresh = batch.dropDuplicates([key])
        try:
            old = spark.read.parquet(path)
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
                raise
            old = None
        if old is not None:
            fresh = fresh.join(old.select(key), key, "left_anti")
        fresh.write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
