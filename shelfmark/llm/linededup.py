"""Exact line deduplication with DataFrame functions only.

Each line's key is hashed to 128 bits. The hashes are range-partitioned and
sorted within by document and position; a window streams to the first document
of each. Ranges are cut on (hash, salt), where the salt is dealt by document,
so a line which a third of all documents hold spreads over as many ranges as
there are salts. One row for each hash and salt is summed up per hash, and the
verdict goes back to the lines by (hash, salt).

The result is a bitmap per document, not text: an array of 32-bit masks of
dropped lines, absent if the document keeps all its lines.

A null or empty text is one empty line. A row without id counts as the last
document. Rows are told apart by id and text: repeated rows are one document,
get equal bitmaps and don't duplicate each other. Other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import ascii_lower, table, written

BLANKS = " \t\n\x0b\x0c\r"
LAST = (1 << 63) - 1
SPOT = ["h1", "h2", "salt"]


def keyed(docs: DataFrame) -> DataFrame:
    """docs with __id and __text, which tell rows apart, and __body, the text without nulls."""
    body = F.coalesce("text", F.lit(""))
    return docs.select(*[f"`{c}`" for c in docs.columns], F.coalesce("doc_id", F.lit(LAST)).alias("__id"), F.xxhash64(body).alias("__text"), body.alias("__body"))


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z lower-cased. lower() does that for ASCII, and faster."""
    bare = F.trim(line, F.lit(BLANKS))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(ascii_lower(bare))


def line_keys(rows: DataFrame, min_chars: int, salts: int) -> DataFrame:
    """A row for each line whose key has at least min_chars: hash, salt, document and position."""
    lines = rows.select("__id", "__text", F.posexplode(F.split("__body", "\n", -1)).alias("pos", "line"))
    lines = lines.filter(F.char_length("line") >= min_chars).select("__id", "__text", "pos", line_key(F.col("line")).alias("key")).filter(F.char_length("key") >= min_chars)
    return lines.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"), F.pmod(F.xxhash64("__id"), F.lit(salts)).cast("int").alias("salt"), "__id", "__text", "pos")


def bitmaps(rows: DataFrame, min_chars: int = 10, salts: int | None = None) -> DataFrame:
    """(__id, __text, __n_dropped, __drop) for each distinct row of `rows` (from keyed) that loses lines.

    salts: at least 64, and no fewer than the session's shuffle partitions.
    """
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salts = salts or max(64, partitions)
    lines = written(line_keys(rows, min_chars, salts), "lines")
    order = Window.partitionBy(*SPOT).orderBy("__id", "pos")
    streamed = lines.repartitionByRange(partitions, *SPOT).withColumn("first", F.first("__id").over(order))
    spots = streamed.groupBy(*SPOT).agg(F.min("first").alias("first"), F.max("__id").alias("last"))
    owners = spots.groupBy("h1", "h2").agg(F.min("first").alias("owner"), F.max("last").alias("end")).filter("owner < end").select("h1", "h2", "owner")
    verdicts = spots.join(owners, ["h1", "h2"]).filter("last > owner").select(*SPOT, "owner")
    dropped = lines.join(verdicts, SPOT).filter("__id > owner")
    bit = F.expr("shiftleft(1, pos % 32)")
    words = dropped.distinct().groupBy("__id", "__text", F.expr("pos DIV 32").cast("int").alias("word")).agg(F.bit_or(bit).alias("mask"))
    docs = words.groupBy("__id", "__text").agg(F.sum(F.expr("bit_count(mask & 4294967295L)")).cast("long").alias("__n_dropped"), F.array_sort(F.collect_list(F.struct("word", "mask"))).alias("w"))
    zeros = "array_repeat(0, w[i].word - if(i = 0, -1, w[greatest(i - 1, 0)].word) - 1)"
    return docs.select("__id", "__text", "__n_dropped", F.expr(f"flatten(transform(w, (x, i) -> array_append({zeros}, x.mask)))").alias("__drop"))


def kept_text() -> Column:
    """The text that a bitmap leaves of __body."""
    stays = "coalesce(get(__drop, cast(i DIV 32 AS int)) & shiftleft(1, i % 32), 0) = 0"
    return F.when(F.col("__drop").isNull(), F.col("__body")).otherwise(F.array_join(F.expr(rf"filter(split(__body, '\n', -1), (x, i) -> {stays})"), "\n"))


def deduplicated(docs: DataFrame, min_chars: int = 10, salts: int | None = None) -> DataFrame:
    """docs' columns, then __body and __kept (the text before and after) and __n_dropped. The texts are shuffled once."""
    rows = keyed(docs)
    own = [f"`{c}`" for c in docs.columns]
    joined = rows.join(bitmaps(rows.select("__id", "__text", "__body"), min_chars, salts), ["__id", "__text"], "left")
    return joined.select(*own, "__body", kept_text().alias("__kept"), F.coalesce("__n_dropped", F.lit(0).cast("long")).alias("__n_dropped"))


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    rows = deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n_lines = F.size(F.split("__body", "\n", -1)).cast("long")
    return rows.select("doc_id", n_lines.alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2("__kept", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
k AS (SELECT doc_id, line, pos, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
o AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT doc_id, pos, line, coalesce(doc_id > owner, false) AS gone FROM k LEFT JOIN o USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
