"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at distance 3 or less differ, outside one of three blocks of
bits, in at most 2 bits; so each can flip half of that, one bit, and meet the
other. Every distinct fingerprint therefore emits, for each block left out,
its remaining bits and all their variants at distance 1 (131 keys). The keys
are shuffled and sorted, and the fingerprints at a key are compared.

At a key with more than `crowd` fingerprints no pairs are formed. Its members
go to a second, exact round over all 64 bits: each emits its ball of radius 1
as a centre and its ball of radius 2 as a member. A centre and a member that
meet are at most 3 apart without further check, and any two centres that meet
are at most 2 apart, so linking everything at a key to one of its centres
keeps all components while the rows stay proportional to the members.

similar_links() is for a wider radius: texts whose sets of `shingle` words have
a Jaccard similarity of `similarity` or more, some tenth of all bits. There one
fingerprint of 64 bits can't be left with a small radius, so each text gets 448
further bits in 14 bands of 30. Each band is a fingerprint of its own with
radius 2: it emits its ball of radius 1 (31 keys), and pairs that meet are
checked on the first 64 bits, then on the 448, and last by their shingles. Of
many fingerprints at one key the pairs of a minimum spanning forest go on to the
checks. So this finds most links, not all, and groups what is close.

whole_links() adds what is missing, so that no link is left out. Two sets that
similar share one of the first shingles of each, in any order common to all
sets: so many that the rest alone could not be similar enough. The order puts
shingles that are frequent in a sample last. Sets that meet at such a shingle
and are in different components so far are checked by bounds that no similar
pair can fail (sizes and places; the parities of the counts of shingles in 512
bins, which differ in no more bins than the sets do in shingles), and then by
their shingles. At a key of more than `crowd` sets each is first checked with
the nearest of another component, and then all pairs that are still apart.

Components come from rounds that merge neighbours, as joins and minima; equal fingerprints are one vertex throughout, whose copies are never
expanded into pairs.

A text without words (null, empty, blank) has fingerprint zero and is linked
like any other. Null ids get a fingerprint and the component of their links;
they never name one unless nothing else does (then component_id is null).
Repeated rows each get their row. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.llm.common import Memo, append_columns, batches_of, discard, table, written
from shelfmark.llm.winnow import code, kgrams

BITS, RADIUS = 64, 3
#: Over how many tasks the edges of one vertex are spread that has more than HUB of them.
SALTS, HUB = 16, 256
#: Blocks of bits of which one is left out of a key: first bit and width.
BLOCKS = ((0, 22), (22, 21), (43, 21))

#: Words of 64 further bits, the bits of a band (two in each word), and how far apart, of 64 and of all further bits, pairs may be to be checked by their shingles.
WIDE, BAND, NEAR_FIRST, NEAR_WIDE = 7, 30, 18, 0.22
#: Of how many bands the keys (31 a fingerprint and band) are on disk at once.
BANDS_AT_ONCE = 4
#: Bits of the parity sketch of a set of shingles.
SKETCH = 512
#: Of how many documents, at most about, shingles are counted to order them, and how many of the most frequent are told apart.
COUNTED, FREQUENT = 20_000, 200_000
#: Bits of the bitmap that tells which rows need a join.
FILTER_BITS = 1 << 24
#: Bits of each byte.
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float32)


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The SimHash of a text's word shingles: a bit is 1 if set in over half of their XXH64."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > shingle:
        starts, ends = starts[: 1 - shingle], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(line[a:b], seed) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], "<u8")
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, keep: list[str], shingle: int = 3, seed: int = 42, name: str = "fp") -> DataFrame:
    """docs' `keep` columns with the fingerprint as a signed long."""

    def start():
        def compute(texts):
            return ([int(np.uint64(fingerprint(t, shingle, seed)).astype(np.int64)) for t in texts],)

        return compute

    return append_columns(docs, keep, ["text"], start, [T.StructField(name, T.LongType())])


def masks() -> list[tuple[int, int, list[int]]]:
    """For each block: its number, the mask of the bits outside it, and what to flip of them."""
    out = []
    for b, (first, width) in enumerate(BLOCKS):
        outside = [i for i in range(BITS) if not first <= i < first + width]
        out.append((b, sum(1 << i for i in outside), [0] + [1 << i for i in outside]))
    return out


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def literal(values: list[int]):
    return F.array(*[F.lit(signed(v)).cast("long") for v in values])


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint64))  # of signed numbers it would count the absolute value's bits


def forest(members: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what is connected within RADIUS among a few fingerprints."""
    near = popcount(members[:, None] ^ members[None, :]) <= RADIUS
    left, links = np.ones(len(members), bool), []
    for seed in range(len(members)):
        if left[seed]:
            left[seed], todo = False, [seed]
            while todo:
                x = todo.pop()
                for y in np.flatnonzero(near[x] & left).tolist():
                    left[y] = False
                    todo.append(y)
                    links.append((x, y))
    return links


def meetings(distinct: DataFrame, crowd: int) -> DataFrame:
    """Rows (a, b): linked fingerprints; or (a, null): a fingerprint at a crowded key."""
    emitted = None
    for b, mask, flips in masks():
        base = F.col("fp").bitwiseAND(F.lit(signed(mask)).cast("long"))
        own = distinct.select("fp", F.lit(b).cast("byte").alias("block"), base.alias("base"), F.explode(literal(flips)).alias("flip"))
        own = own.select("block", F.col("base").bitwiseXOR(F.col("flip")).alias("key"), "fp")
        emitted = own if emitted is None else emitted.unionByName(own)
    dealt = emitted.repartition("block", "key").sortWithinPartitions("block", "key", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None  # the open key's members so far
        at, crowded = None, False

        def out(links: list[tuple[int, int]], active: list[int]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in links] + active, pa.int64()), pa.array([y for _, y in links] + [None] * len(active), pa.int64())], names=["a", "b"])

        def close(group: np.ndarray, links: list, active: list) -> None:
            if len(group) > crowd:
                active.extend(group.tolist())
            elif len(group) > 1:
                links.extend((int(group[x]), int(group[y])) for x, y in forest(group))

        held = np.zeros(0, np.int64)
        for batch in batches:
            block, key, fp = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if not len(fp):
                continue
            links, active = [], []
            new = np.concatenate(([at != (block[0], key[0])], (key[1:] != key[:-1]) | (block[1:] != block[:-1])))
            starts = np.flatnonzero(new)
            bounds = np.append(starts, len(fp))
            if not new[0]:  # the open key goes on
                first_end = int(bounds[0])
                more = fp[:first_end]
                if crowded:
                    active.extend(more.tolist())
                else:
                    held = np.concatenate((held, more))
                    if len(held) > crowd:
                        active.extend(held.tolist())
                        held, crowded = held[:0], True
            if len(starts):
                if not crowded:
                    close(held, links, active)
                sizes = np.diff(bounds)
                twos = bounds[:-2][sizes[:-1] == 2]
                twos = twos[popcount(fp[twos] ^ fp[twos + 1]) <= RADIUS]
                links.extend(zip(fp[twos].tolist(), fp[twos + 1].tolist(), strict=True))
                for g in np.flatnonzero(sizes[:-1] > 2).tolist():
                    close(fp[bounds[g] : bounds[g + 1]], links, active)
                held, crowded = fp[bounds[-2] :], False
                if len(held) > crowd:
                    active.extend(held.tolist())
                    held, crowded = held[:0], True
            at = (block[-1], key[-1])
            if links or active:
                yield out(list(dict.fromkeys(links)), list(dict.fromkeys(active)))
        links, active = [], []
        if not crowded:
            close(held, links, active)
        if links or active:
            yield out(links, active)

    return dealt.mapInArrow(run, "a long, b long")


def crowded_links(active: DataFrame) -> DataFrame:
    """Links (a, b) that connect all components of the fingerprints `active` (fp), in rows proportional to them."""
    one = [1 << i for i in range(BITS)]
    bit = lambda name: F.expr(f"shiftleft(1L, {name})")
    near = active.select("fp", F.explode(literal([0, *one])).alias("flip")).withColumn("centre", F.col("fp"))
    two = active.select("fp", F.explode(F.sequence(F.lit(1), F.lit(BITS - 1))).alias("i")).select("fp", "i", F.explode(F.expr("sequence(0, i - 1)")).alias("j"))
    far = two.select("fp", bit("i").bitwiseOR(bit("j")).alias("flip"), F.lit(None).cast("long").alias("centre"))
    emitted = near.unionByName(far).select(F.col("fp").bitwiseXOR(F.col("flip")).alias("key"), "fp", "centre")
    centres = emitted.groupBy("key").agg(F.min("centre").alias("hub"), F.count("*").alias("n")).filter("hub IS NOT NULL AND n > 1").select("key", "hub")
    return emitted.join(centres.hint("merge"), "key").filter("fp <> hub").select(F.col("fp").alias("a"), F.col("hub").alias("b"))


def flagged(rows: DataFrame, keys: DataFrame, columns: list[str]) -> DataFrame:
    """rows with hit_: whether their columns may be among those of keys. The keys' hashes are a bitmap of FILTER_BITS, which bounds what is broadcast."""
    place = lambda: F.pmod(F.xxhash64(*columns), F.lit(FILTER_BITS))
    bit = F.expr("shiftleft(1L, cast(place_ % 64 AS int))")
    bitmap = keys.select(place().alias("place_")).groupBy(F.expr("place_ DIV 64").alias("word_")).agg(F.bit_or(bit).alias("bits_"))
    marked = rows.withColumn("place_", place()).withColumn("word_", F.expr("place_ DIV 64")).join(F.broadcast(bitmap), "word_", "left")
    return marked.select(*rows.columns, F.coalesce(F.col("bits_").bitwiseAND(bit) != 0, F.lit(False)).alias("hit_"))


def among(rows: DataFrame, keys: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """rows whose columns may be among those of keys, and rows for which they certainly are not. It only spares shuffles: a join of the first part decides."""
    marked = flagged(rows, keys, columns)
    return marked.filter("hit_").drop("hit_"), marked.filter("NOT hit_").drop("hit_")


def met(rows: DataFrame, values: DataFrame, key: str, hubs: DataFrame | None, how: str = "inner") -> DataFrame:
    """rows joined with values, one row a key. Rows of the keys in hubs (hub), if there are any, are dealt over SALTS tasks."""
    if hubs is None:
        return rows.join(values.hint("merge"), key, how)
    hubs = hubs.withColumnRenamed("hub", key)
    salt = F.when(F.col("hit_"), F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    salts = F.when(F.col("hit_"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    dealt = flagged(rows, hubs, [key]).select(*rows.columns, salt.alias("salt_"))
    spread = flagged(values, hubs, [key]).select(*values.columns, F.explode(salts).alias("salt_"))
    return dealt.join(spread.hint("merge"), [key, "salt_"], how).drop("salt_")


def crowded_keys(counts: DataFrame, key: str) -> DataFrame | None:
    """The keys of counts (key, n) with more than HUB rows, as hub, or None if there are none."""
    hubs = counts.filter(F.col("n") > HUB).select(F.col(key).alias("hub"))
    return None if hubs.isEmpty() else hubs


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node that each node of the links (a, b) can reach.

    In each round every node merges into the one of least hash among itself and
    its neighbours, and only links between merged nodes go on. Hashes are others
    in each round, so that the number of nodes falls by a constant factor on
    average, whatever their order. The rounds are then traced back. All plans
    are a join or two of written tables, since the driver's memory follows the
    size of a plan times its stages.
    """
    pairs = lambda e: e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edges, steps = written(pairs(links), "links"), []
    while not edges.isEmpty():
        if len(steps) == rounds:
            raise RuntimeError(f"components did not settle within {rounds} rounds")
        order = lambda c: F.xxhash64(F.lit(len(steps)), c)
        low = edges.union(edges.select("v", "u")).groupBy("u").agg(F.min_by("v", order("v")).alias("m"), F.count("*").alias("n"))
        step = written(low.select(F.col("u").alias("node"), F.when(order("m") < order("u"), F.col("m")).otherwise(F.col("u")).alias("to"), "n"), "steps")
        hubs = crowded_keys(step, "node")
        into = lambda name, to: step.select(F.col("node").alias(name), F.col("to").alias(to))  # noqa: B023, E731
        half = met(edges, into("u", "a"), "u", hubs)
        edges = written(pairs(met(half if hubs is None else written(half, "links"), into("v", "b"), "v", hubs)), "links")
        steps.append((step, hubs))
    if not steps:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    found = steps.pop()[0].select("node", F.col("to").alias("root"))
    for step, hubs in reversed(steps):
        later = met(step.select("node", "to"), found.withColumnRenamed("node", "to"), "to", hubs, "left")
        found = written(later.select("node", F.coalesce("root", "to").alias("root")), "steps")
    least = written(found.groupBy("root").agg(F.min("node").alias("least"), F.count("*").alias("n")), "least")
    placed = met(found, least.select("root", "least"), "root", crowded_keys(least, "root"))
    return written(placed.select("node", F.col("least").alias("root")), "roots")


def linked(prints: DataFrame, crowd: int = 64) -> DataFrame:
    """(fp, least, component_id) for each distinct fp of prints (doc_id, fp): the smallest doc_id of its copies, and of all that it reaches."""
    spark = prints.sparkSession
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "prints")
    with batches_of(spark, 20_000):
        close = written(meetings(distinct.select("fp"), crowd), "meetings")
    links = close.filter("b IS NOT NULL")
    active = close.filter("b IS NULL").select(F.col("a").alias("fp")).distinct()
    if not active.isEmpty():
        links = links.unionByName(crowded_links(written(active, "active")))
    roots = components(links)
    placed = distinct.join(roots.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return placed.join(lowest.hint("merge"), "root").select("fp", "root", "least", "component_id")


def shingles(text: str | None, size: int, memo: Memo) -> np.ndarray:
    """The hashes of a text's distinct shingles of `size` words; of fewer words, of all of them."""
    memo.trim()
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.unique(kgrams(np.fromiter(map(memo.__getitem__, words), np.uint64, len(words)), max(1, min(size, len(words)))))


def wide_fingerprint(h: np.ndarray) -> np.ndarray:
    """1 + WIDE words of 64 bits: a bit is 1 if set in over half of the hashes, each mixed anew for each word."""
    counts = np.zeros((8 * (1 + WIDE), 256))
    for i in range(0, len(h), 1 << 14):
        z = h[i : i + (1 << 14), None] + np.arange(1, 2 + WIDE, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        at = (z ^ (z >> np.uint64(31))).view(np.uint8).reshape(len(z), -1) + 256 * np.arange(counts.shape[0])
        counts += np.bincount(at.ravel(), minlength=counts.size).reshape(counts.shape)
    return np.packbits(counts @ BYTE_BITS * 2 > len(h), bitorder="little").view("<i8")


def spanning_links(group: np.ndarray) -> list[tuple[int, int]]:
    """Links of a group's fingerprints that are NEAR_FIRST bits apart or less: all among a few, else those of a minimum spanning forest.

    Whatever is connected by links of d bits or less is so in the forest, for
    every d; so the closest pairs stay, and the rows don't grow with the square.
    """
    if len(group) <= 4:
        return [(int(a), int(b)) for i, a in enumerate(group) for b in group[i + 1 :] if (int(a) ^ int(b)).bit_count() <= NEAR_FIRST]
    away = popcount(group ^ group[0]).astype(np.int64)  # of those outside the tree: bits to the nearest inside
    nearest, outside, out = np.zeros(len(group), np.int64), np.ones(len(group), bool), []
    far = BITS + 1
    away[0], outside[0] = far, False
    for _ in range(len(group) - 1):
        i = int(away.argmin())
        if away[i] <= NEAR_FIRST:
            out.append((int(min(group[nearest[i]], group[i])), int(max(group[nearest[i]], group[i]))))
        outside[i] = False
        bits = popcount(group ^ group[i])
        closer = outside & (bits < away)
        away[closer], nearest[closer] = bits[closer], i
        away[i] = far
    return out


def band_meetings(nodes: DataFrame, some: range = range(2 * WIDE)) -> DataFrame:
    """Distinct pairs (a, b), a < b, of fingerprints of nodes (fp, wide) that meet in one of some bands and are close on the first 64 bits."""
    low = (1 << BAND) - 1
    bands = [F.shiftrightunsigned(F.col("wide")[i], BAND * half).bitwiseAND(F.lit(low).cast("long")).bitwiseOR(F.lit((2 * i + half) << BAND).cast("long")) for i, half in (divmod(band, 2) for band in some)]
    based = nodes.select("fp", F.explode(F.array(*bands)).alias("base"))
    keys = based.select(F.explode(literal([0, *[1 << i for i in range(BAND)]])).alias("flip"), "base", "fp").select(F.col("base").bitwiseXOR(F.col("flip")).alias("key"), "fp")
    dealt = keys.repartition("key").sortWithinPartitions("key", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp = np.zeros(0, np.int64), np.zeros(0, np.int64)  # the open key's rows

        def pairs(final: bool) -> tuple[pa.RecordBatch, int]:
            """The pairs of the keys that are complete, and where the open one starts."""
            starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
            bounds = np.append(starts, len(key)) if final else starts
            sizes = np.diff(bounds)
            twos = bounds[:-1][sizes == 2]
            twos = twos[popcount(fp[twos] ^ fp[twos + 1]) <= NEAR_FIRST]
            found = list(zip(fp[twos].tolist(), fp[twos + 1].tolist(), strict=True))
            for g in np.flatnonzero(sizes > 2).tolist():
                found += spanning_links(fp[bounds[g] : bounds[g + 1]])
            found = list(dict.fromkeys(found))
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"]), int(bounds[-1]) if len(bounds) else 0

        for batch in batches:
            if batch.num_rows:
                key, fp = (np.concatenate((old, c.to_numpy(zero_copy_only=False))) for old, c in zip((key, fp), batch.columns, strict=True))
                if key[0] != key[-1]:
                    out, rest = pairs(False)
                    key, fp = key[rest:], fp[rest:]
                    yield out
        yield pairs(True)[0]

    return dealt.mapInArrow(run, "a long, b long").distinct()


def similar_links(nodes: DataFrame, keyed: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """Pairs (a, b) of sets of nodes (set_, fp, id_, text_, own_, wide) whose fingerprints meet and whose texts, those of keyed (id_, text_, own_, text), are similar."""
    alike = nodes.groupBy("fp").agg(F.min_by(F.struct("set_", "wide"), F.struct("id_", "text_")).alias("r")).select("fp", "r.*")
    alike = written(alike, "alike")
    with batches_of(nodes.sparkSession, 20_000):
        parts = [written(band_meetings(alike.select("fp", "wide"), range(i, min(i + BANDS_AT_ONCE, 2 * WIDE))), "meetings") for i in range(0, 2 * WIDE, BANDS_AT_ONCE)]
    met = reduce(DataFrame.union, parts).distinct()
    side = lambda name: alike.select(F.col("fp").alias(name), F.col("wide").alias(f"{name}_wide"), F.col("set_").alias(f"{name}_set")).hint("merge")
    apart = sum((F.bit_count(F.col("a_wide")[i].bitwiseXOR(F.col("b_wide")[i])) for i in range(WIDE)), F.lit(0))
    near = met.join(side("a"), "a").join(side("b"), "b").filter(apart <= int(NEAR_WIDE * 64 * WIDE))
    links = checked(near.select(F.col("a_set").alias("a"), F.col("b_set").alias("b")), nodes, keyed, similarity, shingle)
    discard(alike, *parts)
    return links


def checked(pairs: DataFrame, nodes: DataFrame, keyed: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """The pairs (a, b) of sets of nodes (set_, id_, text_, own_) that are similar by their texts in keyed (id_, text_, own_, text)."""
    near = written(pairs, "near")
    asked = near.select(F.col("a").alias("set_")).union(near.select("b")).distinct()
    wanted = written(nodes.select("set_", "id_", "text_", "own_").join(asked.hint("merge"), "set_", "left_semi"), "wanted")
    few, _ = among(keyed.select("id_", "text_", "own_", "text"), wanted, ["id_", "text_"])
    texts = written(few.join(wanted.hint("merge"), ["id_", "text_", "own_"]).dropDuplicates(["set_"]).select("set_", "text"), "texts")
    side = lambda name: texts.select(F.col("set_").alias(name), F.col("text").alias(f"{name}_text")).hint("merge")
    both = near.join(side("a"), "a").join(side("b"), "b")

    def start():
        memo = Memo(code)

        def jaccard(one, other):
            x, y = shingles(one, shingle, memo), shingles(other, shingle, memo)
            both = len(np.intersect1d(x, y, assume_unique=True))
            return both / max(1, len(x) + len(y) - both)

        return lambda ones, others: ([jaccard(x, y) for x, y in zip(ones, others, strict=True)],)

    rows = append_columns(both, ["a", "b"], ["a_text", "b_text"], start, [T.StructField("similarity", T.DoubleType())])
    links = written(rows.filter(F.col("similarity") >= similarity).select("a", "b"), "similar")
    discard(near, wanted, texts)
    return links


def frequent_shingles(keyed: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, of the shingles most frequent in a sample of keyed (id_, text_, text), and their numbers of documents. They only order shingles."""
    parts = max(1, keyed.count() // COUNTED)
    sample = keyed.filter(F.pmod(F.xxhash64("id_", "text_"), F.lit(parts)) == 0)

    def start():
        memo = Memo(code)
        return lambda texts: ([shingles(t, shingle, memo).view(np.int64) for t in texts],)

    each = append_columns(sample, [], ["text"], start, [T.StructField("keys", T.ArrayType(T.LongType()))]).select(F.explode("keys").alias("key"))
    rows = each.groupBy("key").agg(F.count("*").alias("n")).filter("n > 2").orderBy(F.desc("n"), "key").limit(FREQUENT).toArrow()
    keys, n = rows["key"].to_numpy().view(np.uint64), rows["n"].to_numpy()
    order = np.argsort(keys)
    return keys[order], n[order]


def first_shingles(h: np.ndarray, similarity: float, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first of a set's hashes, rare ones before frequent ones: any set that is so similar has one of them among its own first."""
    keys, n = frequent
    rank = np.zeros(len(h), np.int64)
    if len(keys):
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        rank = np.where(keys[at] == h, n[at], 0)
    ordered = h[np.lexsort((h, rank))]
    return ordered[: len(h) - int(np.ceil(similarity * len(h) - 1e-9)) + 1].view(np.int64)


def parities(h: np.ndarray) -> np.ndarray:
    """For each of SKETCH bins whether it holds an odd number of the hashes. Sets differ in no fewer hashes than bins."""
    odd = np.bincount((h >> np.uint64(20)).astype(np.int64) % SKETCH, minlength=SKETCH) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<i8")


def possible(size, place, other_size, other_place, similarity: float) -> np.ndarray:
    """Whether sets whose first common shingle has these places in their orders may share enough."""
    return np.minimum(size - place, other_size - other_place) >= similarity / (1 + similarity) * (size + other_size) - 1e-6


def whole_groups(batches: Iterator[pa.RecordBatch], columns: Callable) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Columns of batches sorted by the first of them, with the bounds of its values, none of which is split."""
    held = None
    for batch in batches:
        if batch.num_rows:
            now = columns(batch)
            held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            starts = np.flatnonzero(np.concatenate(([True], held[0][1:] != held[0][:-1])))
            if len(starts) > 1:
                yield [x[: starts[-1]] for x in held], starts
                held = [x[starts[-1] :] for x in held]
    if held is not None:
        yield held, np.array([0, len(held[0])])


def prefix_meetings(nodes: DataFrame, similarity: float, crowd: int) -> DataFrame:
    """Of nodes (set_, size, first): rows (a, b) of sets, a < b, that share a first shingle and may be similar; at crowded keys rows (a, null, key, size, place) of each set."""
    keys = nodes.select("set_", "size", F.posexplode("first").alias("place", "key")).select("key", "set_", "size", "place")
    dealt = keys.repartition("key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, node, size, place), bounds in whole_groups(batches, lambda b: [c.to_numpy(zero_copy_only=False) for c in b.columns]):
            sizes, pairs = np.diff(bounds), []
            for n in np.unique(sizes[(sizes > 1) & (sizes <= crowd)]).tolist():
                i, j = np.triu_indices(n, 1)
                starts = bounds[:-1][sizes == n][:, None]
                pairs.append(np.stack(((starts + i).ravel(), (starts + j).ravel())))
            x, y = np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), np.int64)
            fit = possible(size[x], place[x], size[y], place[y], similarity)
            x, y = node[x[fit]], node[y[fit]]
            found = np.unique(np.stack((np.minimum(x, y), np.maximum(x, y))), axis=1)
            many = np.repeat(sizes > crowd, sizes)
            none = lambda n, kind: pa.nulls(n, kind)
            yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), none(found.shape[1], pa.int64()), none(found.shape[1], pa.int32()), none(found.shape[1], pa.int32())], names=["a", "b", "key", "size", "place"])
            if many.any():
                yield pa.RecordBatch.from_arrays([pa.array(node[many], pa.int64()), none(int(many.sum()), pa.int64()), pa.array(key[many], pa.int64()), pa.array(size[many], pa.int32()), pa.array(place[many], pa.int32())], names=["a", "b", "key", "size", "place"])

    return dealt.mapInArrow(run, "a long, b long, key long, size int, place int")


def crowded_pairs(crowded: DataFrame, similarity: float, nearest: bool) -> DataFrame:
    """Pairs (a, b), a < b, of crowded (key, a, size, place, root, sketch) of one key and different roots that may be similar: all, or for each set the nearest."""
    dealt = crowded.select("key", "a", "size", "place", "root", "sketch").repartition("key").sortWithinPartitions("key")

    def columns(batch: pa.RecordBatch) -> list[np.ndarray]:
        plain = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
        return [*plain, batch.column(5).flatten().to_numpy(zero_copy_only=False).reshape(-1, SKETCH // 64)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, bounds in whole_groups(batches, columns):
            for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                _, node, size, place, root, sketch = (x[start:end] for x in held)
                if (root == root[0]).all():
                    continue
                step = max(1, (1 << 20) // len(node))
                for i in range(0, len(node), step):
                    x = slice(i, i + step)
                    fit = (root[x, None] != root) & possible(size[x, None], place[x, None], size, place, similarity)
                    if not nearest:
                        fit &= node[x, None] < node  # a pair meets from both sides
                    p, q = np.nonzero(fit)
                    if not len(p):
                        continue
                    p += i
                    apart = popcount(sketch[p] ^ sketch[q]).sum(axis=1, dtype=np.int64)
                    near = apart <= most_apart(size[p] + size[q], similarity)
                    p, q, apart = p[near], q[near], apart[near]
                    if nearest:
                        order = np.lexsort((apart, p))
                        p, q = p[order], q[order]
                        one = np.concatenate(([True], p[1:] != p[:-1]))[: len(p)]
                        p, q = p[one], q[one]
                    low, high = np.minimum(node[p], node[q]), np.maximum(node[p], node[q])
                    yield pa.RecordBatch.from_arrays([pa.array(low, pa.int64()), pa.array(high, pa.int64())], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").distinct()


def most_apart(sizes, similarity: float):
    """In how many shingles two similar sets of so many together may differ."""
    return sizes * ((1 - similarity) / (1 + similarity)) + 1e-6


def whole_links(nodes: DataFrame, keyed: DataFrame, links: DataFrame, similarity: float, shingle: int, crowd: int) -> DataFrame:
    """Links (a, b) with the components of links (a, b) of nodes (set_, id_, text_, own_, size, first, sketch), and with all that is similar and not yet joined by them."""
    spark = nodes.sparkSession
    with batches_of(spark, 20_000):
        met = written(prefix_meetings(nodes, similarity, crowd), "meetings")
    few, crowded = met.filter("b IS NOT NULL").select("a", "b").distinct(), met.filter("b IS NULL").drop("b")
    apart = sum((F.bit_count(F.col("a_sketch")[i].bitwiseXOR(F.col("b_sketch")[i])) for i in range(SKETCH // 64)), F.lit(0))
    for nearest in (False,) if crowded.isEmpty() else (True, False):
        joined = components(links)
        roots = joined.withColumnRenamed("node", "set_").hint("merge")
        placed = nodes.select("set_", "size", "sketch").join(roots, "set_", "left").withColumn("root", F.coalesce("root", "set_"))
        side = lambda name: placed.select(F.col("set_").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ("size", "sketch", "root")]).hint("merge")  # noqa: B023, E731
        near = few.join(side("a"), "a").join(side("b"), "b").filter("a_root <> b_root").filter(apart <= most_apart(F.col("a_size") + F.col("b_size"), similarity)).select("a", "b")
        pairs = near
        if not crowded.isEmpty():
            with batches_of(spark, 20_000):
                rows = crowded.join(placed.select(F.col("set_").alias("a"), "root", "sketch").hint("merge"), "a")
                pairs = near.unionByName(written(crowded_pairs(rows, similarity, nearest), "crowded")).distinct()
        links = joined.toDF("a", "b").unionByName(checked(pairs, nodes, keyed, similarity, shingle))
    discard(met)
    return links


def one_of_each(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, crowd: int = 16) -> DataFrame:
    """docs without near-duplicates: of each component of similar texts the row of smallest doc_id stays (an absent id counts as the largest).

    Texts without words, null or not, are alike. Repeated rows of one id stay
    once. Other columns stay as they are, whatever their names; an empty table
    stays empty. Of the texts only those to be compared, and rows that may have
    to go, are shuffled.
    """
    names, last = docs.columns, (1 << 63) - 1
    own = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])  # names that nothing clashes with
    doc_id, text = (F.col(f"c{names.index(c)}") for c in ("doc_id", "text"))
    keyed = own.withColumns({"id_": F.coalesce(doc_id, F.lit(last)), "text_": F.when(doc_id.isNull(), F.xxhash64(text)).otherwise(F.lit(0)), "own_": F.coalesce(F.xxhash64(text), F.lit(0)), "text": text})
    key = ["id_", "text_"]
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(keyed, shingle))

    def start():
        memo = Memo(code)

        def compute(texts):
            sets = [shingles(t, shingle, memo) for t in texts]
            found = [wide_fingerprint(h) for h in sets]
            names = [signed(xxhash.xxh64_intdigest(h.tobytes())) for h in sets]
            return names, [len(h) for h in sets], [int(x[0]) for x in found], [x[1:].tolist() for x in found], [parities(h) for h in sets], [first_shingles(h, similarity, frequent.value) for h in sets]

        return compute

    longs = T.ArrayType(T.LongType())
    fields = [T.StructField("set_", T.LongType()), T.StructField("size", T.IntegerType()), T.StructField("fp", T.LongType()), *[T.StructField(c, longs) for c in ("wide", "sketch", "first")]]
    prints = written(append_columns(keyed, [*key, "own_"], ["text"], start, fields), "fingerprints")
    first = F.min_by(F.struct(*key, "own_", "size", "fp", "wide", "sketch", "first"), F.struct(*key)).alias("r")
    nodes = written(prints.groupBy("set_").agg(first).select("set_", "r.*"), "nodes")
    copies = written(prints.groupBy(*key).agg(F.count("*").alias("n")), "copies")
    discard(prints)
    links = whole_links(nodes, keyed, similar_links(nodes, keyed, similarity, shingle), similarity, shingle, crowd)
    placed = nodes.select("set_", *key).join(components(links).withColumnRenamed("node", "set_").hint("merge"), "set_", "left").withColumn("root", F.coalesce("root", "set_"))
    kept = written(placed.groupBy("root").agg(F.min(F.struct(*key)).alias("r")).select("r.*"), "kept")
    discard(nodes)
    doubtful = copies.join(kept.withColumn("stays", F.lit(True)).hint("merge"), key, "left").filter("n > 1 OR stays IS NULL")
    some, sure = among(keyed.drop("text", "own_"), written(doubtful.select(*key), "doubtful"), key)
    rows = sure.unionByName(some.join(kept.hint("merge"), key, "left_semi").dropDuplicates(key))
    return rows.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


def near_duplicates(docs: DataFrame, shingle: int = 3, seed: int = 42, crowd: int = 64) -> DataFrame:
    """doc_id, fp and component_id of each row of docs (doc_id, text)."""
    prints = written(fingerprints(docs, ["doc_id"], shingle, seed), "fingerprints")
    return prints.join(linked(prints, crowd).select("fp", "component_id").hint("merge"), "fp")


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    rows = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
