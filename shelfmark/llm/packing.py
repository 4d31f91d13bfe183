"""Lexical retrieval packing into windows of `window` tokens.

A document's tokens that fill whole windows go out as they are; its rest (the
tail) is packed with the tails of lexically close documents. Terms are token
ids. Document frequencies and lengths are counted over the whole corpus.

The inverted index is sharded. Documents are dealt by their words: each has a
sketch, its BM25 weights summed into `SKETCH` signed places by a hash of the
term, and a tree of two-means splits, fitted on at most about `sample_rows`
sketches, sends it to a leaf. A leaf of more than `shard_rows` documents is
dealt on by a hash of the row, so copies of one text, which no tree can part,
still spread. Tree and leaves grow with the corpus; a shard does not, so the
work is in proportion to the input, and a task holds one shard.

Within a shard, seeds are taken in order of id. All documents of the shard are
ranked by BM25 against all of the seed's terms, and those still unused fill
the seed's window greedily, best first. The one that doesn't fit is cut at a
multiple of `cell` tokens, and what is left of it is the next seed. Every
unused document of the shard is ranked; only those of other shards are not, as
the README's recall figures tell. Terms in over half of all documents have no
positive weight in BM25 and are left out of the index.

Ids are those of `tokenizers` for byte_bpe_50k.json: a special token's string
in a text is that token. Null and empty texts are documents of one token, the
end mark. Null ids and repeated rows are packed like others. An empty table
gives no pieces. Other columns are not looked at.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.llm.common import append_columns, give_back, small_batches, table, written

WINDOW, CELL, END_ID = 2048, 32, 1
#: The vocabulary's special tokens (fixed values).
SPECIAL = {"<|endoftext|>": 50_256}
#: Places of a sketch; from which share of a shard's documents on a term's weights lie in a dense matrix, and its cells at most.
SKETCH, DENSE_SHARE, DENSE_CELLS = 64, 0.1, 1 << 24
#: The smaller side of a split has this share of the sample at least, and a leaf this many of its rows.
LEAST_SIDE, LEAST_SAMPLE = 0.2, 8
VOCABULARY = 1 << 16
PIECE = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


class Encoder:
    """Token ids of texts: those of byte_bpe_50k.json under the slower library; tests compare them."""

    def __init__(self, path: str | None = None):
        with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken")) as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(str.split, file)}
        self.plain = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.special = re.compile("|".join(f"({re.escape(s)})" for s in SPECIAL))

    def ids(self, text: str | None) -> np.ndarray:
        """The ids of a text and the end mark."""
        text = text or ""
        if not any(s in text for s in SPECIAL):
            found = self.plain(text)
        else:
            found = []
            for part in self.special.split(text):
                found += [SPECIAL[part]] if part in SPECIAL else self.plain(part)
        found.append(END_ID)
        return np.array(found, "<u4")


def describe(ids: np.ndarray, window: int, cell: int) -> tuple[list[int], bytes, bytes, bytes]:
    """Checksums of the whole windows; running checksums of the tail at cell ends; distinct terms and their counts."""
    whole = len(ids) // window
    crcs = [zlib.crc32(ids[i * window : (i + 1) * window]) for i in range(whole)]
    tail, now, running = memoryview(ids[whole * window :]).cast("B"), 0, []
    for a in range(0, len(tail), 4 * cell):
        now = zlib.crc32(tail[a : a + 4 * cell], now)
        running.append(now)
    terms, counts = np.unique(ids, return_counts=True)
    return crcs, np.array(running, "<u4").tobytes(), terms.astype("<u2").tobytes(), counts.astype("<u4").tobytes()


def tokenized(docs: DataFrame, window: int = WINDOW, cell: int = CELL, tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_tokens (with the end mark), whole (checksums), tail, terms and counts for each row of docs."""

    def start():
        encoder = Encoder(tokenizer)

        def compute(texts):
            out = [], [], [], [], []
            for text in texts:
                ids = encoder.ids(text)
                for column, value in zip(out, (len(ids), *describe(ids, window, cell)), strict=True):
                    column.append(value)
            return out

        return compute

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("whole", T.ArrayType(T.LongType()))] + [T.StructField(c, T.BinaryType()) for c in ("tail", "terms", "counts")]
    return append_columns(docs, ["doc_id"], ["text"], start, fields)


def span_crc(running: np.ndarray, a: int, b: int, cell: int) -> int:
    """The checksum of the tail's tokens a to b from the running checksums; a is a multiple of cell, b too or the end."""
    end = int(running[-(-b // cell) - 1])
    if a == 0:
        return end
    shifted = zlib.crc32(bytes(4 * (b - a)), int(running[a // cell - 1]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    return end ^ shifted


class Weights:
    """BM25 weights under the corpus's document frequencies and mean length."""

    def __init__(self, idf: np.ndarray, mean_length: float, k1: float = 1.2, b: float = 0.75):
        self.idf, self.mean_length, self.k1, self.b = idf, mean_length, k1, b

    def of(self, terms: list[np.ndarray], counts: list[np.ndarray], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, term, weight) of every posting with a positive weight."""
        doc = np.repeat(np.arange(len(terms)), [len(t) for t in terms])
        term, tf = np.concatenate([*terms, []]).astype(np.int64), np.concatenate([*counts, []])
        useful = self.idf[term] > 0
        doc, term, tf = doc[useful], term[useful], tf[useful]
        return doc, term, self.idf[term] * tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * lengths[doc] / self.mean_length))

    def sketches(self, terms: list[np.ndarray], counts: list[np.ndarray], lengths: np.ndarray) -> np.ndarray:
        """A unit vector for each document: its weights, summed into places by the term, with signs."""
        doc, term, weight = self.of(terms, counts, lengths)
        mixed = (term.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        place, sign = (mixed >> np.uint64(32)).astype(np.int64) % SKETCH, np.where(mixed >> np.uint64(63), 1.0, -1.0)
        x = np.bincount(doc * SKETCH + place, weight * sign, len(terms) * SKETCH).reshape(-1, SKETCH)
        return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)).astype(np.float32)


class Router:
    """A tree of two-means splits over a sample of sketches; its leaves hold at most `most` of the rows that the sample stands for."""

    def __init__(self, sample: np.ndarray, most: float, rounds: int = 12):
        self.directions, self.limits, self.children = [], [], []
        self.leaves = 0
        self.grow(sample, max(most, LEAST_SAMPLE), rounds)

    def grow(self, x: np.ndarray, most: float, rounds: int) -> int:
        """The place of the subtree of these rows: a node, or -1 minus the leaf."""
        split = self.split(x, rounds) if len(x) > most else None
        if split is None:
            self.leaves += 1
            return -self.leaves
        direction, limit = split
        right = x @ direction > limit
        at = len(self.directions)
        self.directions.append(direction)
        self.limits.append(limit)
        self.children.append([0, 0])
        self.children[at] = [self.grow(x[~right], most, rounds), self.grow(x[right], most, rounds)]
        return at

    @staticmethod
    def split(x: np.ndarray, rounds: int) -> tuple[np.ndarray, float] | None:
        """The direction and limit that part two clusters; None where all rows are alike."""
        first = x[np.argmax(((x - x.mean(axis=0)) ** 2).sum(axis=1))]
        second = x[np.argmax(((x - first) ** 2).sum(axis=1))]
        found = None
        for _ in range(rounds):
            direction = first - second
            at = x @ direction
            limit = float(np.clip((first + second) @ direction / 2, np.quantile(at, LEAST_SIDE), np.quantile(at, 1 - LEAST_SIDE)))
            right = at > limit
            if right.all() or not right.any():
                break
            found = direction, limit
            first, second = x[right].mean(axis=0), x[~right].mean(axis=0)
        return found

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row, from 0."""
        if not self.directions:
            return np.zeros(len(x), np.int64)
        directions, limits, children = np.array(self.directions, np.float32), np.array(self.limits), np.array(self.children)
        at = np.zeros(len(x), np.int64)
        while len(open_ := np.flatnonzero(at >= 0)):
            node = at[open_]
            side = (x[open_] * directions[node]).sum(axis=1) > limits[node]
            at[open_] = children[node, side.astype(np.int64)]
        return -at - 1


class Shard:
    """An inverted index over some documents: terms that many have in a dense matrix, the others as postings."""

    def __init__(self, terms: list[np.ndarray], counts: list[np.ndarray], lengths: np.ndarray, weights: Weights):
        self.n = len(terms)
        doc, term, weight = weights.of(terms, counts, lengths)
        self.terms = [t[weights.idf[t] > 0].astype(np.int64) for t in terms]
        found = np.bincount(term, minlength=VOCABULARY)
        dense = np.argsort(-found, kind="stable")[: DENSE_CELLS // max(1, self.n)]
        dense = dense[found[dense] > DENSE_SHARE * self.n]
        self.column = np.full(VOCABULARY, -1)
        self.column[dense] = np.arange(len(dense))
        self.matrix = np.zeros((len(dense), self.n), np.float32)
        at = self.column[term]
        self.matrix[at[at >= 0], doc[at >= 0]] = weight[at >= 0]
        rare = at < 0
        order = np.argsort(term[rare], kind="stable")
        self.doc, self.weight = doc[rare][order], weight[rare][order]
        self.ends = np.cumsum(np.bincount(term[rare], minlength=VOCABULARY))

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every document for all distinct terms of the seed."""
        terms = self.terms[seed]
        at = self.column[terms]
        out = self.matrix[at[at >= 0]].sum(axis=0, dtype=np.float64)
        terms = terms[at < 0]
        ends = self.ends[terms]
        starts = np.where(terms > 0, self.ends[terms - 1], 0)
        sizes = ends - starts
        if total := int(sizes.sum()):
            at = np.arange(total) + np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)
            out += np.bincount(self.doc[at], self.weight[at], self.n)
        return out


def fill(lengths: np.ndarray, shard: Shard, window: int, cell: int) -> Iterator[list[tuple[int, int, int]]]:
    """Windows as lists of (document, start in its tail, length). Documents are numbered in order of id; lengths are those of their tails."""
    n = len(lengths)
    used, rest, at = np.zeros(n, bool), None, 0

    def ranked(seed: int) -> Iterator[int]:
        """The unused documents, best first, of equal ones the earlier."""
        scores = np.round(shard.scores(seed), 3)
        free = np.flatnonzero(~used)
        own, count = scores[free], 64
        while count < len(free):  # the best few, then all
            least = np.partition(own, len(own) - count)[len(own) - count]
            some = np.flatnonzero(own >= least)
            order = some[np.argsort(-own[some], kind="stable")]
            yield from free[order].tolist()
            free, own = free[own < least], own[own < least]
            count *= 8
        yield from free[np.argsort(-own, kind="stable")].tolist()

    while True:
        if rest is None:
            while at < n and used[at]:
                at += 1
            if at == n:
                return
            seed, begin = at, 0
        else:
            seed, begin = rest
        used[seed], rest = True, None
        pieces, room = [(seed, begin, int(lengths[seed]) - begin)], window - int(lengths[seed]) + begin
        if room >= cell:
            for other in ranked(seed):
                size = int(lengths[other])
                took = size if size <= room else room // cell * cell
                pieces.append((other, 0, took))
                used[other] = True
                room -= took
                if took < size:
                    rest = other, took
                if room < cell:
                    break
        yield pieces


def pack(docs: DataFrame, window: int = WINDOW, cell: int = CELL, shard_rows: int = 2048, tokenizer: str | None = None, sample_rows: int = 32_768) -> DataFrame:
    """The pieces of all rows of docs (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    rows = written(tokenized(docs, window, cell, tokenizer).withColumn("row", F.monotonically_increasing_id()), "tokens")
    total = rows.agg(F.count("*").alias("n"), F.sum("n_tokens").alias("tokens")).first()
    n = max(1, total["n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(VOCABULARY, np.int64)
        for batch in batches:
            found += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u2"), minlength=VOCABULARY)
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(found[some], pa.int64())], names=["term", "n"])

    small_batches(spark)
    # a row for each term of the vocabulary at most
    frequency = rows.select("terms").mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(VOCABULARY)
    df[frequency["term"].to_numpy()] = frequency["n"].to_numpy()
    weights = Weights(np.where(df > 0, np.maximum(0.0, np.log((n - df + 0.5) / (df + 0.5))), 0.0), (total["tokens"] or 1) / n)
    shared = spark.sparkContext.broadcast(weights)

    heads = rows.select("doc_id", "n_tokens", F.posexplode("whole").alias("i", "crc"))
    heads = heads.select("doc_id", (F.col("i") * F.lit(window).cast("long")).alias("start"), F.lit(window).cast("long").alias("length"), F.col("crc").alias("ids_crc32"), F.col("n_tokens").alias("doc_tokens"), (F.lit(1 << 62) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    tails = rows.filter(F.length("tail") > 0).select("row", "doc_id", "n_tokens", "tail", "terms", "counts")
    dealt = routed(tails, shared, n, shard_rows, sample_rows)

    def pack_shard(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        # equal rows are alike, so it does not matter which of them comes first
        absent = pdf["doc_id"].isna()
        pdf = pdf.assign(absent=absent, doc_id=pdf["doc_id"].fillna(0), crc=pdf["tail"].map(zlib.crc32)).sort_values(["absent", "doc_id", "n_tokens", "crc", "row"], ignore_index=True)
        terms, counts = [np.frombuffer(x, "<u2") for x in pdf["terms"]], [np.frombuffer(x, "<u4") for x in pdf["counts"]]
        tokens = pdf["n_tokens"].to_numpy()
        shard = Shard(terms, counts, tokens.astype(float), shared.value)
        running = [np.frombuffer(x, "<u4") for x in pdf["tail"]]
        first = (int(key[0]) << 40) + (int(key[1]) << 20)
        out = []
        for i, pieces in enumerate(fill(tokens % window, shard, window, cell)):
            offset = 0
            for doc, a, size in pieces:
                out.append((doc, a, size, span_crc(running[doc], a, a + size, cell), first + i, offset))
                offset += size
        doc, a, size, crc, sequence, offset = (np.array(x, np.int64) for x in zip(*out, strict=True))
        own = pdf["doc_id"].astype("Int64").mask(pdf["absent"]).iloc[doc].reset_index(drop=True)
        del shard, terms, counts, running
        give_back()
        return pd.DataFrame({"doc_id": own, "start": tokens[doc] // window * window + a, "length": size, "ids_crc32": crc, "doc_tokens": tokens[doc], "sequence_id": sequence, "offset": offset})

    pieces = dealt.groupBy("leaf", "part").applyInPandas(pack_shard, PIECE)
    return heads.select(*[F.col(c).cast("long") for c in PIECE.names]).unionByName(pieces)


def routed(tails: DataFrame, shared, n: int, shard_rows: int, sample_rows: int) -> DataFrame:
    """tails with `leaf` and `part`, which together name a shard of about shard_rows at most. `shared` broadcasts the Weights."""
    spark = tails.sparkSession
    names = tails.columns

    def sketched(batch: pa.RecordBatch) -> np.ndarray:
        terms, counts = ([np.frombuffer(x, t) for x in batch.column(c).to_pylist()] for c, t in (("terms", "<u2"), ("counts", "<u4")))
        return shared.value.sketches(terms, counts, batch.column("n_tokens").to_numpy().astype(float))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([x.tobytes() for x in sketched(batch)], pa.binary())], names=["row", "sketch"])

    share = min(1.0, sample_rows / n)
    chosen = tails.filter(F.pmod(F.xxhash64("row"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))) if n > shard_rows else tails.limit(0)
    taken = chosen.select("row", "n_tokens", "terms", "counts").mapInArrow(sample, "row long, sketch binary").toArrow().sort_by("row")
    sketches = np.frombuffer(b"".join(taken["sketch"].to_pylist()), np.float32).reshape(-1, SKETCH)
    tree = spark.sparkContext.broadcast(Router(sketches, shard_rows * len(sketches) / n))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = tree.value.leaf(sketched(batch)) if tree.value.directions else np.zeros(batch.num_rows, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf, pa.int64())], names=[*names, "leaf"])

    placed = written(tails.mapInArrow(place, T.StructType([*tails.schema.fields, T.StructField("leaf", T.LongType())])), "routed")
    sizes = {r["leaf"]: r["count"] for r in placed.groupBy("leaf").count().collect()}  # at most a row for LEAST_SAMPLE rows of the sample
    parts = spark.createDataFrame([(k, -(-v // shard_rows)) for k, v in sizes.items()], "leaf long, parts long")
    return placed.join(F.broadcast(parts), "leaf").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")))


def op3_retrieval_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
