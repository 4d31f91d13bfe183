"""Language identification with words first and a backoff to character n-grams.

A word seen in training scores each language by its log frequency there. A
word that was not seen falls back to its n-grams of `max_n` characters, then
to shorter ones, until some of its n-grams are known; it scores the mean of
their log frequencies. A text's language is the one with the highest sum over
all its words, and the score is that language's share after a softmax.

The model is fitted on a bounded sample: about `docs_per_language` labelled
documents of each language, chosen by a hash of their id. What it keeps are
the words and n-grams that the sample has `least_count` times in a language;
the totals behind the log frequencies count all of them. There is no other
bound on languages, words or n-grams: what is broadcast is a part of the
sample. Predicting looks at whole texts.

A null text, an empty one and one without a letter give `und` with score 0, as
does any text if no labelled document exists. Rows with null ids are predicted
too. Repeated rows get equal predictions. An empty table gives no rows. Other
columns are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.llm.common import append_columns, give_back, in_fold, small_batches, table, written

WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


def grams(word: str, n: int) -> list[str]:
    padded = f"\x02{word}\x03"
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


class Model:
    """Log frequencies by language: kinds[0] for words, kinds[n] for n-grams."""

    def __init__(self, languages: list[str], counts: list[tuple[str, int, str, int]], max_n: int, all_: dict[tuple[str, int], tuple[int, int]] | None = None):
        """all_: for each language and kind the sum of all counts and the number of entries, those included that are not in `counts`."""
        self.languages, self.max_n = languages, max_n
        place = {lang: i for i, lang in enumerate(languages)}
        self.index: list[dict[str, int]] = [{} for _ in range(max_n + 1)]
        totals = np.zeros((max_n + 1, max(1, len(languages))))
        for _, kind, gram, _ in counts:
            self.index[kind].setdefault(gram, len(self.index[kind]))
        self.logs = [np.full((len(x), max(1, len(languages))), 0.5) for x in self.index]
        for lang, kind, gram, n in counts:
            self.logs[kind][self.index[kind][gram], place[lang]] += n
            totals[kind, place[lang]] += n
        entries = np.array([[len(x)] * max(1, len(languages)) for x in self.index])
        for (lang, kind), (n, own) in (all_ or {}).items():
            totals[kind, place[lang]] = n
            entries[kind, place[lang]] = max(entries[kind, place[lang]], own)
        for kind, m in enumerate(self.logs):
            self.logs[kind] = np.log(m / (totals[kind] + 0.5 * np.maximum(1, entries[kind]))).astype(np.float32)

    def word(self, word: str) -> np.ndarray:
        if (at := self.index[0].get(word)) is not None:
            return self.logs[0][at]
        for n in range(self.max_n, 0, -1):
            index = self.index[n]
            if found := [at for g in grams(word, n) if (at := index.get(g)) is not None]:
                return self.logs[n][found].mean(axis=0)
        return np.zeros(len(self.languages), np.float32)


class Scorer:
    """Scores texts under a model; keeps the scores of words it has met, up to about `most` of them."""

    SLICE = 100_000

    def __init__(self, model: Model, most: int = 100_000):
        self.model, self.most = model, most
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.rows = np.zeros((0, len(self.model.languages)), np.float32)

    def learn(self, words: list[str]) -> None:
        """Scores words that have not been met, all at once: known ones, then by their n-grams, from long ones to short."""
        model, left = self.model, list(range(len(words)))
        made = np.zeros((len(words), len(model.languages)), np.float32)
        for n in (0, *range(model.max_n, 0, -1)):
            if not left:
                break
            pieces = [[words[i]] for i in left] if n == 0 else [grams(words[i], n) for i in left]
            sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
            at = np.fromiter(map(model.index[n].get, chain.from_iterable(pieces), repeat(-1)), np.int64, int(sizes.sum()))
            word = np.repeat(np.arange(len(left)), sizes)[at >= 0]
            at = at[at >= 0]
            found = np.bincount(word, minlength=len(left))
            here = np.flatnonzero(found)
            if len(here):
                firsts = np.cumsum(found)[here] - found[here]
                made[np.array(left)[here]] = np.add.reduceat(model.logs[n][at], firsts, axis=0) / found[here, None].astype(np.float32)
                left = [i for i, k in zip(left, found.tolist(), strict=True) if not k]
        self.at.update(zip(words, range(len(self.at), len(self.at) + len(words)), strict=True))
        self.rows = np.concatenate((self.rows, made))

    def total(self, words: list[str]) -> np.ndarray:
        """The sum of the scores of all words."""
        sums = np.zeros(len(self.model.languages))
        for i in range(0, len(words), self.SLICE):
            part = words[i : i + self.SLICE]
            if new := [w for w in dict.fromkeys(part) if w not in self.at]:
                if len(self.at) > self.most:
                    self.clear()
                    new = list(dict.fromkeys(part))
                self.learn(new)
            sums += self.rows[np.fromiter(map(self.at.__getitem__, part), np.int32, len(part))].sum(axis=0, dtype=np.float64)
        return sums

    def predict_all(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """The language and the score of each text. Their words are looked up together."""
        lists = [WORD.findall((t or "").lower()) for t in texts] if self.model.languages else [[]] * len(texts)
        for first in range(0, len(lists), 64):
            new = [w for w in dict.fromkeys(chain.from_iterable(lists[first : first + 64])) if w not in self.at]
            if new and len(self.at) + len(new) <= self.most:
                self.learn(new)
        out = []
        for words in lists:
            if not any(c.isalpha() for w in words for c in w):
                out.append((UNKNOWN, 0.0))
                continue
            total = self.total(words)
            best = int(total.argmax())
            out.append((self.model.languages[best], float(1 / np.exp(total - total[best]).sum())))
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.predict_all([text])[0]


def fit(docs: DataFrame, usable: Column, docs_per_language: int = 1500, least_count: int = 3, max_n: int = 5) -> Model:
    """Learn from the rows of docs (doc_id, text, lang) that are `usable` and have text and lang."""
    small_batches(docs.sparkSession)
    labelled = docs.filter(usable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = labelled.groupBy("lang").count().orderBy("lang").collect()  # a row for each language
    if not sizes:
        return Model([], [], max_n)
    share = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, docs_per_language / r["count"])) for r in sizes], "lang string, share double")
    ticket = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000.0
    sample = labelled.select("lang", "text", ticket.alias("ticket")).join(F.broadcast(share), "lang").filter("ticket < share").select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a few texts at a time: their n-grams are many
        for batch in (b.slice(i, 32) for b in batches for i in range(0, b.num_rows, 32)):
            words, out = {}, Counter()
            for lang, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                words.setdefault(lang, Counter()).update(WORD.findall(text.lower()))
            for lang, by_word in words.items():
                for word, k in by_word.items():
                    out[lang, 0, word] += k
                    for n in range(1, max_n + 1):
                        for g in grams(word, n):
                            out[lang, n, g] += k
            keys = list(out)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.string()), pa.array(list(out.values()), pa.int64())], names=["lang", "kind", "gram", "n"])
            del keys, words, out
        give_back()

    counted = written(sample.mapInArrow(count, "lang string, kind int, gram string, n long").groupBy("lang", "kind", "gram").agg(F.sum("n").alias("n")), "grams")
    totals = {(r["lang"], r["kind"]): (r["n"], r["kinds"]) for r in counted.groupBy("lang", "kind").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).collect()}
    rows = counted.filter(F.col("n") >= least_count).orderBy("lang", "kind", "gram").toArrow().to_pydict()  # a part of the sample
    return Model([r["lang"] for r in sizes], list(zip(rows["lang"], rows["kind"], rows["gram"], rows["n"], strict=True)), max_n, totals)


def predict(docs: DataFrame, model: Model, keep: list[str], names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs' `keep` columns with the predicted language and its score."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    def start():
        own = Model.__new__(Model)
        vars(own).update(shared.value)
        scorer = Scorer(own)

        def compute(texts):
            out = scorer.predict_all(texts)
            return [x[0] for x in out], [x[1] for x in out]

        return compute

    return append_columns(docs, keep, ["text"], start, [T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs, ~in_fold("doc_id", 5, 0))
    rows = docs.select("doc_id", "text", in_fold("doc_id", 5, 0).alias("held_out"))
    return predict(rows, model, ["doc_id", "held_out"])
