"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Rows and bytes in an Arrow batch at most. Texts may be long, so a batch stays far below Spark's default of 10,000 rows.
BATCH_ROWS, BATCH_BYTES = 256, 16 << 20
LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    A cluster names it in spark.checkpoint.dir. Where that is unset in a local
    session (tests), a temporary folder becomes the session's checkpoint
    folder; elsewhere there is no such folder, and that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='shelfmark-')}")
    return context.getCheckpointDir().rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Spark deletes a shuffle's files only once the driver's JVM collects the plan, however large they are; with this when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: its lineage is cut, it outlives lost executors, and its shuffles leave the disk at once."""
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path := scratch(spark, name))
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes what written() wrote for these frames. No plan that still has to run may read them."""
    for frame in frames:
        spark = frame.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(frame.written_to)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def in_fold(key: str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the key as text leaves the remainder; a null key does not."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % modulus == remainder, F.lit(False))


def ascii_lower(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def small_batches(spark: SparkSession) -> None:
    """Sets the session's batch limits. They stay set, since the plans that need them run later; they change no result."""
    for key, value in LIMITS.items():
        spark.conf.set(key, str(value))


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Batches of so many short rows, for an action within; afterwards those of small_batches()."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    try:
        yield
    finally:
        small_batches(spark)


def give_back() -> None:
    """Returns free memory to the system. A Python worker outlives its task and would hold on to it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def append_columns(df: DataFrame, keep: list[str], inputs: list[str], start: Callable[[], Callable], fields: list[T.StructField]) -> DataFrame:
    """df's `keep` columns followed by `fields`, which Python computes from the columns `inputs`.

    start() is called once in each task and returns a function from lists of
    input values to a tuple of lists of output values. Rows stay in place:
    nothing is shuffled, and a task holds one Arrow batch at a time.
    """
    small_batches(df.sparkSession)
    n, types = len(keep), [to_arrow_type(f.dataType) for f in fields]
    schema = T.StructType([df.schema[c] for c in keep] + fields)
    names = [f.name for f in schema]
    kept = [to_arrow_type(df.schema[c].dataType) for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = start()
        for batch in batches:
            made = compute(*[batch.column(n + i).to_pylist() for i in range(len(inputs))])
            old = [batch.column(i).cast(t) for i, t in enumerate(kept)]
            yield pa.RecordBatch.from_arrays(old + [pa.array(v, type=t) for v, t in zip(made, types, strict=True)], names=names)
            del made, old
        del compute
        give_back()

    chosen = [F.col(f"`{c}`") for c in keep] + [F.col(f"`{c}`").alias(f"__in{i}") for i, c in enumerate(inputs)]
    return df.select(*chosen).mapInArrow(run, schema)


def words_of(text: str, table_: bytes) -> list[bytes]:
    """The words of a text as UTF-8: `table_` maps a byte to its form in a word, or to a blank."""
    return text.encode("utf-8", "surrogatepass").translate(table_).split()


def word_table(is_word: Callable[[int], bool]) -> bytes:
    """A translation table: A-Z to a-z, other word bytes as they are, and the rest to a blank."""
    return bytes((b + 32 if 65 <= b <= 90 else b) if is_word(b + 32 if 65 <= b <= 90 else b) else 32 for b in range(256))


class Memo(dict):
    """A dictionary that computes what it lacks, and starts anew beyond `most` entries when trimmed."""

    def __init__(self, compute: Callable, most: int = 100_000):
        super().__init__()
        self.compute, self.most = compute, most

    def __missing__(self, key):
        value = self[key] = self.compute(key)
        return value

    def trim(self) -> None:
        if len(self) > self.most:
            self.clear()
