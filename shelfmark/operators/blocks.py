"""Rankings of many seeds against all items without a row per pair.

Items and seeds are rows of id and one vector per signal: `<signal>_t`, its
terms (each once), and `<signal>_w`, their weights; a dense vector has weights
only. Items are packed once into chunks of SLICE, whose terms are numbered
within the chunk. Seeds come in blocks of at most about BLOCK, which are
broadcast one after another; each block is a pass over the chunks where they
lie. Terms that many seeds of a block have are multiplied as matrices, the
others by their postings. A task keeps each seed's best over all its chunks, so
what is shuffled grows with seeds and tasks, not with pairs.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.sources.store import stored

#: Seeds in a broadcast block, and items in a chunk.
BLOCK, SLICE = 4096, 512
#: The share of a block's seeds from which on a term is multiplied as a matrix, how many terms at most, and products of postings made at once.
HEAD, MOST_HEAD, PRODUCTS = 0.05, 1024, 1 << 20


def vectors(weights: DataFrame, name: str) -> DataFrame:
    """(id, <name>_t, <name>_w) of weights (id, term, w)."""
    pairs = F.array_sort(F.collect_list(F.struct("term", "w")))  # in order of term, so sums are the same in every run
    rows = weights.groupBy("id").agg(pairs.alias("p"))
    return rows.select("id", F.col("p.term").alias(f"{name}_t"), F.col("p.w").alias(f"{name}_w"))


class Seeds:
    """A block's vectors of one signal, as encode() makes them."""

    def __init__(self, lengths: np.ndarray, weights: np.ndarray, terms: list | None = None, at: np.ndarray | None = None):
        self.n, self.sizes = len(lengths), lengths.astype(float)
        seed = np.repeat(np.arange(self.n), lengths)
        if terms is None:
            self.head = dense(lengths, weights, int(lengths.max(initial=0))).T.copy()
            return
        df = np.bincount(at, minlength=len(terms))
        place = np.empty(len(terms), np.int64)
        place[order := np.argsort(-df, kind="stable")] = np.arange(len(terms))
        self.place = dict(zip(terms, place.tolist(), strict=True))
        h = min(MOST_HEAD, int((df[order] >= max(2, HEAD * self.n)).sum()))
        own = place[at]
        head = own < h
        self.head = np.zeros((h, self.n))
        self.head[own[head], seed[head]] = weights[head]
        own, seed, weights = own[~head] - h, seed[~head], weights[~head]
        by_term = np.argsort(own, kind="stable")
        self.seed, self.weights = seed[by_term], weights[by_term]
        self.start = np.concatenate(([0], np.cumsum(np.bincount(own, minlength=len(terms) - h))))

    def dense(self, lengths: np.ndarray, weights: np.ndarray) -> np.ndarray:
        return finite(dense(lengths, weights, len(self.head)) @ self.head)

    def dot(self, lengths: np.ndarray, weights: np.ndarray, terms: list, at: np.ndarray) -> np.ndarray:
        """Inner products, items by seeds."""
        out, h = np.zeros((len(lengths), self.n)), len(self.head)
        own = np.fromiter((self.place.get(t, -1) for t in terms), np.int64, len(terms))[at]
        row = np.repeat(np.arange(len(lengths)), lengths)
        head = (own >= 0) & (own < h)
        if head.any():
            rows, back = np.unique(row[head], return_inverse=True)
            part = np.zeros((len(rows), h))
            part[back, own[head]] = weights[head]
            if len(rows) == len(out):
                np.matmul(part, self.head, out=out)
            else:
                out[rows] = part @ self.head
        tail = own >= h
        own, row, weights = own[tail] - h, row[tail], weights[tail]
        first = self.start[own]
        count = self.start[own + 1] - first
        ends, flat = np.cumsum(count), out.reshape(-1)
        total = ends[-1] if len(ends) else 0
        cuts = [*np.unique(np.searchsorted(ends, np.arange(0, total, PRODUCTS), "right")).tolist(), len(own)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            n = count[i:j]
            total = np.cumsum(n)
            place = np.repeat(first[i:j] - (total - n), n) + np.arange(total[-1])
            np.add.at(flat, np.repeat(row[i:j] * self.n, n) + self.seed[place], np.repeat(weights[i:j], n) * self.weights[place])
        return finite(out)

    def jaccard(self, lengths: np.ndarray, weights: np.ndarray, terms: list, at: np.ndarray) -> np.ndarray:
        """Shared elements over all elements, of sets as vectors of ones."""
        both = self.dot(lengths, weights, terms, at)
        union = lengths[:, None] + self.sizes
        union -= both
        np.maximum(union, 1, out=union)
        return np.divide(both, union, out=both)


def finite(x: np.ndarray) -> np.ndarray:
    return x if np.isfinite(x.sum()) else np.where(np.isfinite(x), x, 0.0)


def dense(lengths: np.ndarray, weights: np.ndarray, width: int) -> np.ndarray:
    """Vectors as rows of a matrix, cut or filled up with zeros."""
    out = np.zeros((len(lengths), width))
    row = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(weights)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[row[place < width], place[place < width]] = weights[place < width]
    return out


def signals_of(kinds: dict[str, str]) -> list[str]:
    return [c for name, kind in kinds.items() for c in ([f"{name}_w"] if kind == "dense" else [f"{name}_t", f"{name}_w"])]


def encode(rows: pa.Table, kinds: dict[str, str]) -> dict:
    """id: a list; by signal the vectors' lengths, all weights, and for sparse ones the distinct terms and the place of each weight's term among them."""
    out: dict = {"id": rows.column("id").to_pylist()}
    flat = lambda c: pa.concat_arrays([x.flatten() for x in rows.column(c).chunks]) if rows.num_rows else pa.array([], rows.schema.field(c).type.value_type)
    for name, kind in kinds.items():
        lengths = pc.fill_null(pc.list_value_length(rows.column(f"{name}_w")), 0).to_numpy().astype(np.int64)
        out[name] = (lengths, flat(f"{name}_w").to_numpy(zero_copy_only=False).astype(float))
        if kind != "dense":
            terms = flat(f"{name}_t").dictionary_encode()
            out[name] += (terms.dictionary.to_pylist(), terms.indices.to_numpy(zero_copy_only=False).astype(np.int32))
    return out


def packed(rows: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """(chunk): rows (id and vectors) in chunks of SLICE, in order of id within a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        made = lambda table: pa.RecordBatch.from_arrays([pa.array([pickle.dumps(encode(table, kinds), 5)], pa.binary())], names=["chunk"])
        for batch in batches:
            held, n = [*held, batch], n + batch.num_rows
            if n >= SLICE:
                table = pa.Table.from_batches(held)
                for i in range(0, n - SLICE + 1, SLICE):
                    yield made(table.slice(i, SLICE))
                held, n = table.slice(n - n % SLICE).to_batches(), n % SLICE
        if n:
            yield made(pa.Table.from_batches(held))

    return stored(rows.repartition("id").sortWithinPartitions("id").mapInArrow(run, "chunk binary"), "chunks")


def scored(batches: Iterator[pa.RecordBatch], block: dict, kinds: dict[str, str]) -> Iterator[tuple[np.ndarray, dict[str, np.ndarray]]]:
    """(item ids, scores by signal: items by seeds of the block) for each chunk."""
    seeds = {name: Seeds(*block[name]) for name in kinds}
    for batch in batches:
        for i in range(batch.num_rows):
            own = pickle.loads(batch.column(0)[i].as_buffer())
            yield keys(own["id"]), {name: getattr(seeds[name], kind)(*own[name]) for name, kind in kinds.items()}


def keys(ids: list) -> np.ndarray:
    """Ids as an array that sorts as Spark does."""
    return np.array(ids) if ids else np.array([], object)


def blocks_of(seeds: DataFrame, kinds: dict[str, str]) -> Iterator[dict]:
    """The seeds' rows, encoded, in blocks of about BLOCK."""
    n = -(-seeds.count() // BLOCK)
    for b in range(n):
        own = seeds if n == 1 else seeds.filter(F.pmod(F.xxhash64("id"), F.lit(n)) == b)
        yield encode(own.orderBy("id").toArrow(), kinds)


class Best:
    """The k best items of each seed of a block so far, by rounded score and then by id."""

    def __init__(self, seeds: np.ndarray, k: int, digits: int, positive: bool):
        self.n, self.k, self.unit = len(seeds), k, 10.0**digits
        self.own: dict = {}
        for i, s in enumerate(seeds.tolist()):
            self.own.setdefault(s, []).append(i)
        self.least = np.full(self.n, np.nextafter(0, 1) if positive else np.finfo(float).min)  # what counts at all
        self.full, self.rounded, self.last = np.zeros(self.n, bool), np.zeros(self.n), None
        self.kept: tuple = ()
        self.pending: list = []
        self.waiting = 0

    def edge(self, rounded: np.ndarray) -> np.ndarray:
        """No score below rounds to this or more."""
        x = (rounded - 0.5) / self.unit
        return x - 1e-12 * np.maximum(1, np.abs(x))

    def add(self, ids: np.ndarray, total: np.ndarray) -> None:
        """Takes scores, items by seeds, which it changes."""
        for i, x in enumerate(ids.tolist()):
            if (at := self.own.get(x)) is not None:
                total[i, at] = -np.inf
        least = self.least
        if self.last is not None:  # a tie counts only if an id comes before the last one kept
            least = np.where(self.full, np.maximum(least, self.edge(self.rounded + (np.sort(ids)[0] >= self.last))), least)
        able = total >= least
        if len(ids) > self.k:
            many = np.flatnonzero(np.count_nonzero(able, axis=0) > 4 * self.k)
            if len(many):
                some = total[:, many].T
                kth = np.partition(some, len(ids) - self.k, axis=1)[:, len(ids) - self.k]
                able[:, many] &= some.T >= self.edge(np.floor(kth * self.unit + 0.5))
        at, seed = np.nonzero(able)
        if len(at):
            self.pending.append((seed, total[at, seed], ids[at]))
            self.waiting += len(at)
            if self.last is None or self.waiting > self.n * self.k:
                self.merge()

    def merge(self) -> None:
        if not self.pending:
            return
        seed, score, ids = (np.concatenate(x) for x in zip(*([self.kept] if self.kept else []), *self.pending, strict=True))
        rounded = np.floor(score * self.unit + 0.5)
        key = np.unique(ids, return_inverse=True)[1] if ids.dtype == object else ids
        order = np.lexsort((key, -rounded, seed))
        ordered = seed[order]
        first = np.searchsorted(ordered, ordered)
        place = np.arange(len(ordered)) - first
        order = order[place < self.k]
        self.kept, self.pending, self.waiting = (seed[order], score[order], ids[order]), [], 0
        ends = np.searchsorted(self.kept[0], np.arange(self.n), "right")
        self.full = ends - np.searchsorted(self.kept[0], np.arange(self.n)) >= self.k
        last = np.maximum(ends - 1, 0)
        self.rounded, self.last = rounded[order][last], self.kept[2][last]

    def rows(self) -> tuple:
        self.merge()
        return self.kept or (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, object))


def best_of(items: DataFrame, seeds: DataFrame, kinds: dict[str, str], k: int, blend: Callable | None = None, digits: int = 6) -> DataFrame:
    """(seed_id, rec_id, score): at least the k best items of each seed, itself left out; ties go to the smaller id after rounding.

    Without `blend` there is one signal, and only scores over zero count. With
    it, blend(chunks, block, kinds), which may make a first pass, makes a
    function from seed ids and scores by signal to a matrix, and all items count.
    """
    spark, columns, out = items.sparkSession, signals_of(kinds), None
    schema = f"seed_id {items.schema['id'].dataType.simpleString()}, rec_id {items.schema['id'].dataType.simpleString()}, score double"
    usable = lambda df: df.filter("id IS NOT NULL").select("id", *columns)
    types = [items.select("id").limit(0).toArrow().schema.field(0).type] * 2
    chunks = packed(usable(items), kinds)
    for block in blocks_of(stored(usable(seeds), "seeds"), kinds):
        shared = spark.sparkContext.broadcast(block)  # about BLOCK vectors per signal
        combine = blend(chunks, shared, kinds) if blend else None

        def search(batches: Iterator[pa.RecordBatch], shared=shared, combine=combine) -> Iterator[pa.RecordBatch]:
            seed_ids = keys(shared.value["id"])
            best = Best(seed_ids, k, digits, combine is None)
            for ids, scores in scored(batches, shared.value, kinds):
                best.add(ids, combine(seed_ids, scores) if combine else next(iter(scores.values())))
            seed, score, ids = best.rows()
            yield pa.RecordBatch.from_arrays([pa.array(seed_ids[seed].tolist(), types[0]), pa.array(ids.tolist(), types[1]), pa.array(score, pa.float64())], names=["seed_id", "rec_id", "score"])

        part = chunks.mapInArrow(search, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)
