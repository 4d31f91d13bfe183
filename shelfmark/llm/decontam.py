"""Benchmark decontamination by winnowing.

An item's windows are its runs of `window` words (an item of fewer words, but
not none, is one window). Of the k-grams within a window the rightmost one of
smallest hash is its fingerprint; documents are winnowed alike, so each
occurrence of a window carries the window's fingerprint at the same place.
Joining the two sides on fingerprints gives candidates; each is extended to
the whole window and compared word by word, so hits are exact and complete.

The benchmark's size is measured first. Up to `most_bytes` of text its
fingerprints and windows are broadcast, and documents are scanned where they
lie: no shuffle, and no hot passage meets in one task. A larger benchmark is
joined: documents and items emit their fingerprints, which meet by hash, with
documents dealt over salts so that a passage that many of them share spreads;
each pair of document and item that meets is then compared in full.

Null and empty texts have no words and no hits; items without id or words
have no windows; repeated documents each get their row; several rows of one
item_id count as one item. An empty benchmark hits nothing, and an empty table
gives no rows. Other columns are not looked at; the columns of `keep` must not
be named n_words, spans or items.
"""

from __future__ import annotations

import re
from itertools import pairwise

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.llm.common import Memo, append_columns, table, word_table, words_of, written
from shelfmark.llm.winnow import Filter, code, kgrams, select

WORDS = word_table(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b >= 128)
#: The same words in a text that is not lower-cased.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType())]))


def merged(spans) -> list[tuple[int, int]]:
    """Spans as (start, length), joined where they touch."""
    out: list[list[int]] = []
    for start, length in sorted(spans):
        if out and start <= out[-1][0] + out[-1][1]:
            out[-1][1] = max(out[-1][1], start + length - out[-1][0])
        else:
            out.append([start, length])
    return [(a, b) for a, b in out]


def build(items: list[tuple[int, str]], window: int, k: int) -> dict:
    """The windows of some items, and by window length the places within a window where a fingerprint may lie."""
    windows: dict[bytes, set[int]] = {}
    places: dict[int, dict[int, set[int]]] = {}
    for item, text in items:
        words = words_of(text, WORDS)
        if length := min(window, len(words)):
            codes = np.array([code(w) for w in words], np.uint64)
            h = kgrams(codes, min(k, length))
            for s in range(len(words) - length + 1):
                own = h[s : s + length - min(k, length) + 1]
                at = int(select(own, len(own))[0])
                windows.setdefault(b" ".join(words[s : s + length]), set()).add(item)
                places.setdefault(length, {}).setdefault(int(own[at]), set()).add(at)
    return {"windows": windows, "places": places, "k": k}


def matcher(index: dict):
    """A function from the word lists of some documents to their (span, items) hits."""
    memo = Memo(code)
    filters = {n: Filter(np.fromiter(x, np.uint64, len(x))) for n, x in index["places"].items()}

    def find(texts: list[list[bytes]]) -> dict[int, tuple[set, set]]:
        memo.trim()
        words = [w for t in texts for w in t]
        ends = np.cumsum([len(t) for t in texts])
        codes = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
        hits: dict[int, tuple[set, set]] = {}
        for length, known in filters.items():
            k = min(index["k"], length)
            h = kgrams(codes, k)
            found = known.among(h, select(h, length - k + 1))
            for p, doc in zip(found.tolist(), np.searchsorted(ends, found, side="right").tolist(), strict=True):
                first, end = int(ends[doc]) - len(texts[doc]), int(ends[doc])
                for at in index["places"][length][int(h[p])]:
                    s = p - at
                    if first <= s and s + length <= end and (items := index["windows"].get(b" ".join(words[s : s + length]))):
                        spans, seen = hits.setdefault(doc, (set(), set()))
                        spans.add((s - first, length))
                        seen |= items
        return hits

    return find


FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("spans", SPANS), T.StructField("items", T.ArrayType(T.LongType()))]
#: Over how many tasks the documents that share a fingerprint are spread.
SALTS = 16


def scan(docs: DataFrame, benchmark: DataFrame, keep: list[str], window: int = 8, k: int = 5, most_bytes: int = 8_000_000, cut: bool = False) -> DataFrame:
    """docs' `keep` columns with n_words, spans (merged runs of hit words) and items (ids with an occurring window).

    With `cut` also kept_text, the text without the hit words.
    """
    fields = [*FIELDS, *([T.StructField("kept_text", T.StringType())] if cut else [])]
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text")).filter("item_id IS NOT NULL AND text IS NOT NULL")
    if (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > most_bytes:
        return joined_scan(docs, items, keep, window, k, fields)
    shared = docs.sparkSession.sparkContext.broadcast(build([(r[0], r[1]) for r in items.collect()], window, k))  # at most most_bytes

    def start():
        find = matcher(shared.value)

        def compute(texts):
            words = [words_of(t or "", WORDS) for t in texts]
            hits = find(words)
            none = (set(), set())
            spans = [merged(hits.get(i, none)[0]) for i in range(len(words))]
            out = [len(w) for w in words], [[{"start": a, "length": n} for a, n in x] for x in spans], [sorted(hits.get(i, none)[1]) for i in range(len(words))]
            return (*out, [without_spans(t, x) for t, x in zip(texts, spans, strict=True)]) if cut else out

        return compute

    return append_columns(docs, keep, ["text"], start, fields)


def item_prints(text: str, window: int, k: int) -> list[tuple[int, int]]:
    """(window length, fingerprint) of an item's windows."""
    return [(length, h) for length, prints in build([(0, text)], window, k)["places"].items() for h in prints]


def document_prints(words: list[bytes], memo: Memo, lengths: list[int], k: int) -> list[tuple[int, int]]:
    """(window length, fingerprint) of all windows of a document that have one of the lengths."""
    codes = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    out = []
    for length in lengths:
        h = kgrams(codes, min(k, length))
        out += [(length, x) for x in set(h[select(h, length - min(k, length) + 1)].tolist())]
    return out


def joined_scan(docs: DataFrame, items: DataFrame, keep: list[str], window: int, k: int, fields: list[T.StructField]) -> DataFrame:
    """scan() for a benchmark of any size."""
    own = written(docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], "text").withColumn("row", F.monotonically_increasing_id()), "documents")
    long = lambda h: int(np.uint64(h).astype(np.int64))
    print_ = T.ArrayType(T.StructType([T.StructField("n", T.IntegerType()), T.StructField("h", T.LongType())]))
    spread = lambda df: df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int").alias("salt")

    def start_items():
        return lambda texts: ([[{"n": n, "h": long(h)} for n, h in item_prints(t, window, k)] for t in texts],)

    mine = append_columns(items, ["item_id"], ["text"], start_items, [T.StructField("p", print_)]).select("item_id", F.inline("p")).distinct()
    mine = written(mine, "items")
    lengths = sorted(r["n"] for r in mine.select("n").distinct().collect())  # at most `window`

    def start_docs():
        memo = Memo(code)

        def compute(texts):
            memo.trim()
            return ([[{"n": n, "h": long(h)} for n, h in document_prints(words_of(t or "", WORDS), memo, lengths, k)] for t in texts],)

        return compute

    theirs = append_columns(own, ["row"], ["text"], start_docs, [T.StructField("p", print_)]).select("row", salt, F.inline("p"))
    pairs = theirs.join(spread(mine).hint("merge"), ["n", "h", "salt"]).select("row", "item_id").distinct()
    texts = spread(items.select("item_id", F.col("text").alias("item")))
    compared = pairs.withColumn("salt", salt).join(texts.hint("merge"), ["item_id", "salt"]).join(own.select("row", "text").hint("merge"), "row")

    def start_pairs():
        matchers = Memo(lambda text: matcher(build([(0, text)], window, k)), 1000)

        def compute(texts, others):
            matchers.trim()
            found = [matchers[o]([words_of(t or "", WORDS)]).get(0) for t, o in zip(texts, others, strict=True)]
            return ([None if x is None else [{"start": a, "length": n} for a, n in merged(x[0])] for x in found],)

        return compute

    hits = append_columns(compared, ["row", "item_id"], ["text", "item"], start_pairs, [T.StructField("s", SPANS)]).filter("s IS NOT NULL")
    by_row = hits.groupBy("row").agg(F.flatten(F.collect_list("s")).alias("s"), F.sort_array(F.collect_set("item_id")).alias("i"))

    def start_all():
        def compute(texts, spans, found):
            all_ = [merged((s["start"], s["length"]) for s in x or ()) for x in spans]
            out = [len(words_of(t or "", WORDS)) for t in texts], [[{"start": a, "length": n} for a, n in x] for x in all_], [x or [] for x in found]
            return (*out, [without_spans(t, x) for t, x in zip(texts, all_, strict=True)]) if len(fields) > len(FIELDS) else out

        return compute

    whole = append_columns(own.join(by_row.hint("merge"), "row", "left"), [f"c{i}" for i in range(len(keep))], ["text", "s", "i"], start_all, fields)
    return whole.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], *[f.name for f in fields])


def without_spans(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text without its words in the spans and what stands between them."""
    if not spans:
        return text
    places = [m.span() for m in WORD.finditer(text)]
    cuts = [(0, 0), *((places[a][0], places[a + n - 1][1]) for a, n in spans), (len(text), len(text))]
    return "".join(text[x[1] : y[0]] for x, y in pairwise(cuts))


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["length"])
    listed = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    n_items = F.size("items").cast("long")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), n_items.alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), (n_items >= 2).alias("contaminated"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bl AS (SELECT item_id, ws, least(8, len(ws)) AS n FROM b WHERE len(ws) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(ws, s, s + n - 1), ' ') AS key FROM (SELECT item_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS s FROM bl)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, s, array_to_string(list_slice(ws, s, s + n - 1), ' ') AS key FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS s FROM d, ns WHERE len(ws) >= n)),
h AS (SELECT doc_id, dw.n, s, item_id FROM dw JOIN bw USING (n, key)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS listed FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
