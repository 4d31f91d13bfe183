"""Toxicity scores after noisy-channel deobfuscation.

The characters of a stretch of text span a lattice. A leetspeak character may
stand for itself or for a letter, and a run of them for one or two; a sign may
be noise, at a word's edge at little cost; a run of a letter may stand for one
or two, wherever it is; a blank may end a word or be noise. Viterbi decoding
finds the path that the channel's costs and a character trigram model make
likeliest, over whole words, whose ends the model scores too.

The restored words give the score: words and word beginnings carry log-odds of
toxic against other documents, and a logistic regression turns a text's
strongest few into a probability. Only stretches that can hold such evidence
need decoding: those whose skeleton (letters with leetspeak read as letters,
alike ones as one, runs as one, signs left out) is that of a known word or
begins like a known beginning. An automaton finds all of them in the skeleton of
the text without blanks, and leaves those where a word may begin: at a token's
start or behind a sign. Tokens that these touch are looked up by their own
skeletons; words spaced out over several tokens must be a known word as a whole.
Neither tokens nor spaced words are too long for that.

The character model counts the words of all documents, each word once a
document. All counts are summed over the corpus; of the trigrams, bigrams and
single characters the `most_grams` most frequent of each are kept then, which
bounds what is broadcast whatever the alphabets. The log-odds are fitted on a
bounded sample of labelled rows (at most about `sample_toxic` and
`sample_other` documents, chosen by a hash of the id), whose words are restored
in tasks, but for tokens of over LONGEST characters; the driver receives features and a few numbers per sampled document.
The regression sees each half of the sample through the log-odds of the other
half. All texts are scored whole.

Null and empty texts, and those without a known feature, get the score of no
evidence. Without labelled rows of both kinds every score is 0. Repeated rows
get equal scores; a document of several labels counts as toxic if one says so.
An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.llm.common import Memo, append_columns, give_back, in_fold, small_batches, table, written

#: Letters that a character may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "µ": "u"}
#: What the channel charges: a leetspeak character for a letter or for itself; a sign left out inside a word or at its edge, or for a blank; a run of
#: two or of more shortened; a blank left out; a word's end between two single letters, where whoever spaces a word out sets blanks or signs anyway.
SUBSTITUTE, LITERAL, DROP, DROP_EDGE, SPLIT, SHORTEN_TWO, SHORTEN, JOIN, SPLIT_SINGLES = -1.0, -6.0, -1.5, -0.2, -0.5, -4.0, -1.0, -3.0, -6.0
EDGES = ".,;:?\"'()[]{}<>…«»„“”‘’¿!¡-_*~`"
#: Tokens beyond this length are left out of the sample that the log-odds are fitted on. When texts are scored they are decoded, but not remembered.
LONGEST = 64
#: What may end a word inside a token, and whether a token holds such a sign.
SIGN, INNER_SIGN = re.compile(r"[\W_]"), re.compile(r"[^\W_][\W_]+[^\W_]")
BLANK = re.compile(r"\s")


def trigrams(words: dict[str, int]) -> Counter:
    found: Counter = Counter()
    for word, n in words.items():
        padded = f"  {word} "
        for i in range(len(word) + 1):
            found[padded[i : i + 3]] += n
    return found


class CharModel:
    """Trigrams of characters with a backoff to bigrams and single characters; words are padded with blanks."""

    def __init__(self, three: dict[str, int], two: dict[str, int] | None = None, context: dict[str, int] | None = None, one: dict[str, int] | None = None):
        """From the counts of trigrams, and of their last two, first two and last characters (by default summed from the trigrams)."""
        self.three, self.two, self.context, self.one = dict(three), two, context, one
        if two is None:
            self.two, self.context, self.one = {}, {}, {}
            for gram, n in three.items():
                for counts, key in ((self.two, gram[1:]), (self.context, gram[:2]), (self.one, gram[2])):
                    counts[key] = counts.get(key, 0) + n
        self.total = max(1, sum(self.one.values()))
        self.cache = Memo(self.compute)

    @classmethod
    def of_words(cls, words: dict[str, int]) -> CharModel:
        return cls(trigrams(words))

    def compute(self, gram: str) -> float:
        single = (self.one.get(gram[2], 0) + 0.01) / (self.total + 1)
        two = (self.two.get(gram[1:], 0) + 2 * single) / (self.one.get(gram[1], 0) + 2)
        return math.log((self.three.get(gram, 0) + 2 * two) / (self.context.get(gram[:2], 0) + 2))

    def log(self, gram: str) -> float:
        self.cache.trim()
        return self.cache[gram]


def runs_of(token: str) -> list[tuple[str, int]]:
    out: list[tuple[str, int]] = []
    for c in token:
        if out and out[-1][0] == c:
            out[-1] = (c, out[-1][1] + 1)
        else:
            out.append((c, 1))
    return out


def token_lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each run of a token the strings that it may stand for and their costs; a blank ends a word."""
    runs = runs_of(token)
    letters = [i for i, (c, _) in enumerate(runs) if c.isalnum()]
    among = set(letters)
    doubled = sum(n > 1 for c, n in runs if c.isalpha()) * 2 > len(letters) > 1  # who doubles most letters does not mean them
    steps = []
    for i, (c, run) in enumerate(runs):
        if c.isalpha():
            shorter = SHORTEN if run > 2 or doubled else SHORTEN_TWO
            options = [(c, 0.0)] if run == 1 else [(c * 2, SHORTEN if run > 2 else 0.0), (c, shorter)]
        else:
            options = [(c * min(run, 2), LITERAL)]
            for x in LEET.get(c, ""):
                options += [(x, SUBSTITUTE)] if run == 1 else [(x * 2, SUBSTITUTE + (SHORTEN if run > 2 else SUBSTITUTE / 2)), (x, SUBSTITUTE + SHORTEN)]
            if not c.isalnum():
                if letters and letters[0] < i < letters[-1]:
                    alone = all(k + 1 not in among and k - 1 not in among for k in (i - 1, i + 1))
                    options += [("", 0.0), (" ", SPLIT_SINGLES)] if alone else [("", DROP), (" ", SPLIT)]
                else:
                    options.append(("", DROP_EDGE))
        steps.append(options)
    return steps


def lattice(stretch: str) -> list[list[tuple[str, float]]]:
    """The lattice of tokens with blanks between them, each of which ends a word or is noise."""
    steps: list[list[tuple[str, float]]] = []
    before = 0
    for token in stretch.split():
        size = sum(c.isalnum() for c in token)
        if steps:
            steps.append([(" ", SPLIT_SINGLES), ("", 0.0)] if before == size == 1 else [(" ", 0.0), ("", JOIN)])
        steps += token_lattice(token)
        before = size
    return steps


def viterbi(steps: list[list[tuple[str, float]]], model: CharModel) -> str:
    """The likeliest path's text. A blank ends a word; the model knows words with two blanks before and one after them."""
    paths: dict[str, tuple[float, tuple | None]] = {"  ": (0.0, None)}  # by the last two characters: score and what was read, as a linked list
    for options in [*steps, [(" ", 0.0)]]:
        after: dict[str, tuple[float, tuple | None]] = {}
        for last, (score, read) in paths.items():
            for text, cost in options:
                now, tail = score + cost, last
                for c in text:
                    if c != " " or tail != "  ":
                        now += model.log(tail + c)
                    tail = "  " if c == " " else tail[1] + c
                if tail not in after or now > after[tail][0]:
                    after[tail] = (now, (read, text))
        paths = after
    out, read = [], max(paths.values(), key=lambda x: x[0])[1]
    while read is not None:
        read, text = read
        out.append(text)
    return "".join(reversed(out))


def decode(stretch: str, model: CharModel) -> list[str]:
    """The words of the likeliest restoration of one or more tokens."""
    steps = lattice(stretch)
    if all(len(x) == 1 for x in steps):
        return stretch.split()
    return viterbi(steps, model).split()


class Restorer:
    """The restored distinct words of texts, each token by itself; remembers what a token became."""

    def __init__(self, model: CharModel):
        self.memo = Memo(lambda token: decode(token, model) if len(token) <= LONGEST else [])

    def words(self, text: str | None) -> set[str]:
        self.memo.trim()
        return {w for t in set((text or "").lower().split()) for w in self.memo[t]}


def features(word: str) -> list[str]:
    """The word, and its beginnings of 4 to 8 characters."""
    return [f"={word}", *(word[:n] for n in range(4, 9) if len(word) > n)]


def strength(word: str, odds: dict[str, float]) -> float:
    return max((odds.get(f, 0.0) for f in features(word)), default=0.0)


STRONGEST = 3


def summary(words: set[str], odds: dict[str, float]) -> list[float]:
    """One, and the strongest evidence of a text's words."""
    found = sorted((v for w in words if (v := strength(w, odds))), reverse=True)[:STRONGEST]
    return [1.0, *found, *[0.0] * (STRONGEST - len(found))]


def log_odds(counts: list[tuple[str, int, int, int]], toxic: int, other: int, least: int = 3, odds: float = 2.0, endings: int = 3) -> dict[str, float]:
    """The features that tell toxic documents from others, of rows (feature, toxic documents, other documents, different toxic words).

    A word's beginning is evidence of its own only if `endings` different words of toxic documents begin so.
    """
    found = {}
    for f, bad, good, words in counts:
        value = math.log((bad + 0.5) / (toxic + 1)) - math.log((good + 0.5) / (other + 1))
        if bad >= least and value >= odds and (f.startswith("=") or words >= endings):
            found[f] = value * bad / (bad + 4)  # the rarer, the less it counts
    return found


def regression(x: np.ndarray, y: np.ndarray, share: float, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton's method, with the share of toxic documents that all labels have."""
    toxic = max(1.0, y.sum())
    by = np.where(y > 0, share / toxic, (1 - share) / max(1.0, len(y) - toxic)) * len(y)
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (by * (p - y)) + ridge * np.array([0.0, *w[1:]])
        hessian = (x * (by * p * (1 - p))[:, None]).T @ x + (ridge + 1e-6) * np.eye(len(w))
        w -= np.clip(np.linalg.solve(hessian, gradient), -5, 5)
    return w


def skeleton_table() -> np.ndarray:
    """For each code point of the basic plane: its place in a skeleton; 0 where it has none. A newline keeps tokens apart."""
    out = np.arange(1 << 16, dtype=np.uint32)
    out[[i for i in range(1 << 16) if not chr(i).isalnum() and chr(i) not in LEET]] = 0
    for c, letters in LEET.items():
        out[ord(c)] = ord(letters[0])
    out[out == ord("l")] = ord("i")
    out[ord("\n")] = ord("\n")
    return out


class Skeletons:
    """The skeletons of strings, with the places of their characters."""

    TABLE = skeleton_table()
    LATIN = TABLE[:256].astype(np.uint8).tobytes()

    def read(self, text: str) -> tuple[str, np.ndarray, np.ndarray]:
        """The skeleton, and where the run of each of its characters starts and ends."""
        try:
            mapped, code = np.frombuffer(text.encode("latin-1").translate(self.LATIN), np.uint8), "latin-1"
        except UnicodeEncodeError:
            points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
            mapped, code = np.where(points < len(self.TABLE), self.TABLE[np.minimum(points, len(self.TABLE) - 1)], points).astype("<u4"), "utf-32-le"
        places = np.flatnonzero(mapped != 0)
        mapped = mapped[places]
        if not len(mapped):
            return "", places, places
        kept = np.flatnonzero(np.concatenate(([True], (mapped[1:] != mapped[:-1]) | (mapped[1:] == 10))))
        return mapped[kept].tobytes().decode(code, "surrogatepass"), places[kept], places[np.append(kept[1:], len(places)) - 1]

    def letter(self, c: str) -> int:
        return int(self.TABLE[ord(c)]) if ord(c) < len(self.TABLE) else ord(c)


def tokens_at(text: str, spans: list[tuple[int, int]]) -> list[str]:
    """The distinct tokens that spans of a text, from a token's character to a token's character, touch."""
    out: set[str] = set()
    done = 0  # where the last token read ends
    for first, last in sorted(spans):
        if last < done:
            continue
        first = max(first, done)
        while first > done and not text[first - 1].isspace():
            first -= 1
        blank = BLANK.search(text, last + 1)
        done = blank.start() if blank else len(text)
        out.update(text[first:done].split())
    return list(out)


class Scorer:
    """Scores texts: finds what can be evidence by its skeleton, restores it, and weighs the restored words."""

    def __init__(self, model: dict):
        self.odds, self.weights = model["odds"], model["weights"]
        chars = CharModel(*model["chars"])
        self.chars, self.memo = chars, Memo(lambda stretch: decode(stretch, chars))
        self.skeletons = Skeletons()
        own = {f: self.skeletons.read(f.removeprefix("="))[0] for f in self.odds}
        self.words = {s for f, s in own.items() if f.startswith("=") and s}
        # a disguised word may end in what reads as letters, so words are looked up as beginnings too
        known = sorted({s for s in own.values() if s})
        self.sizes = sorted({min(len(s), 4) for s in known})
        self.heads = {n: {h: tuple(s for s in known if s.startswith(h)) for h in {s[:n] for s in known if min(len(s), 4) == n}} for n in self.sizes}
        self.known = ahocorasick.Automaton()
        for s in known:
            self.known.add_word(s, (len(s), len(s) >= 4 and s in self.words))
        if known:
            self.known.make_automaton()

    def restored(self, stretch: str) -> list[str]:
        return self.memo[stretch] if len(stretch) <= 2 * LONGEST else decode(stretch, self.chars)

    def begins(self, skeleton: str, at: int = 0) -> bool:
        """Whether what can be evidence begins at a place of a skeleton."""
        return any((known := heads.get(skeleton[at : at + n])) and skeleton.startswith(known, at) for n, heads in self.heads.items())

    def inside(self, token: str) -> bool:
        """Whether what can be evidence begins behind a sign of the token."""
        skeleton, _, ends = self.skeletons.read(token)
        behind = [m.end() for m in SIGN.finditer(token)]
        return any(self.begins(skeleton, at) for at in dict.fromkeys(np.searchsorted(ends, behind).tolist()))

    def token_words(self, tokens: list[str]) -> set[str]:
        """Restored words of single tokens."""
        skeletons = self.skeletons.read("\n".join(tokens))[0].split("\n") if tokens else []
        out: set[str] = set()
        for token, skeleton in zip(tokens, skeletons, strict=True):
            if self.begins(skeleton) or (INNER_SIGN.search(token) and self.inside(token)):
                out.update(self.restored(token))
        return out

    def spaced_words(self, text: str, matches: list[tuple[int, int]]) -> set[str]:
        """Restored words of known words that blanks are set into; matches: the places of their first and last letters."""
        out: set[str] = set()
        for first, last in matches:
            if len(text[first : last + 1].split(maxsplit=1)) < 2:
                continue
            letter, whole = self.skeletons.letter(text[first]), True
            while whole and first and not text[first - 1].isspace():
                first -= 1
                whole &= self.skeletons.letter(text[first]) in (0, letter)
            while whole and last + 1 < len(text) and not text[last + 1].isspace():
                last += 1
            if whole:
                out.update(w for w in self.restored(" ".join(text[first : last + 1].split())) if f"={w}" in self.odds)
        return out

    def words_of(self, text: str) -> set[str]:
        """Restored words of what can be evidence in a text."""
        if not text or not len(self.known):
            return set()
        skeleton, starts, ends = self.skeletons.read(text.replace("\n", " "))
        touched, spaced = [], []
        for end, (size, is_word) in self.known.iter(skeleton):
            at = end - size + 1
            # a token's skeleton is in that of the text, though runs may reach into its neighbours
            if not at or SIGN.search(text, ends[at - 1], ends[at]):
                touched.append((int(starts[at]), int(ends[end])))
                if is_word:
                    # the first letter may be the last of a run that the token before it ends in
                    spaced.append((int(ends[at]), int(ends[end])))
        return self.token_words(tokens_at(text, touched)) | self.spaced_words(text, spaced) if touched else set()

    def score(self, text: str | None) -> float:
        self.memo.trim()
        found = self.words_of((text or "").lower())
        return float(1 / (1 + math.exp(-max(-30.0, min(30.0, float(np.dot(self.weights, summary(found, self.odds))))))))


def corpus_trigrams(docs: DataFrame, held: int = 200_000) -> DataFrame:
    """(gram, n): trigrams of the plain words of all docs (text), counted once for each document that has the word.

    A task sums up before the shuffle and holds at most about `held` words or trigrams besides a batch's.
    """
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        found: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["gram", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                words.update({w for t in set(text.lower().split()) if (w := t.strip(EDGES)).isalpha()})
                if len(words) > held:
                    found.update(trigrams(words))
                    words.clear()
                    if len(found) > held:
                        yield out()
                        found.clear()
        found.update(trigrams(words))
        yield out()
        words.clear()
        found.clear()
        give_back()

    return docs.filter("text IS NOT NULL").select("text").mapInArrow(count, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def corpus_model(docs: DataFrame, most_grams: int = 200_000, held: int = 200_000) -> tuple[dict, dict, dict, dict]:
    """What CharModel is made of. Bigrams, contexts and single characters are summed over all trigrams before the most frequent are chosen."""
    counted = written(corpus_trigrams(docs, held), "trigrams")

    def kept(first: int, size: int) -> dict[str, int]:
        rows = counted.groupBy(F.substring("gram", first, size).alias("gram")).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "gram").limit(most_grams).toArrow()
        return dict(zip(rows["gram"].to_pylist(), rows["n"].to_pylist(), strict=True))

    return kept(1, 3), kept(2, 2), kept(1, 2), kept(3, 1)


def fit(docs: DataFrame, labels: DataFrame, usable: Column, sample_toxic: int = 2000, sample_other: int = 4000, most_grams: int = 200_000, most_features: int = 100_000) -> dict | None:
    """Character model and evidence as plain data, from docs (doc_id, text) and labels (doc_id, toxic); None without labels of both kinds.

    most_features: of the features that at least three toxic documents have,
    how many of those in most of them are weighed.
    """
    spark = docs.sparkSession
    marked = labels.filter(usable & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("bad"))
    sizes = {r["bad"]: r["count"] for r in marked.groupBy("bad").count().collect()}
    if len(sizes) < 2:
        return None
    ticket = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000.0
    chosen = marked.filter(ticket < F.when(F.col("bad") == 1, min(1.0, sample_toxic / sizes[1])).otherwise(min(1.0, sample_other / sizes[0])))
    # bounded by the sample's size
    ids = chosen.orderBy(F.xxhash64("doc_id")).limit(2 * (sample_toxic + sample_other)).select("doc_id", "bad")
    chars = corpus_model(docs, most_grams)
    shared = spark.sparkContext.broadcast(chars)
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("bad", F.coalesce("text", F.lit("")).alias("text")).distinct()  # a copy adds nothing

    def start():
        restorer = Restorer(CharModel(*shared.value))
        return lambda texts: ([sorted(restorer.words(t)) for t in texts],)

    halved = sample.withColumn("half", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int"))
    restored = written(append_columns(halved, ["bad", "half"], ["text"], start, [T.StructField("words", T.ArrayType(T.StringType()))]).withColumn("doc", F.monotonically_increasing_id()), "restored")
    word = restored.select("doc", "bad", "half", F.explode("words").alias("word"))
    beginnings = F.transform(F.filter(F.array(*[F.lit(n) for n in range(4, 9)]), lambda n: n < F.char_length("word")), lambda n: F.substr(F.col("word"), F.lit(1), n))
    feature = word.select("doc", "bad", "half", "word", F.explode(F.concat(F.array(F.concat(F.lit("="), F.col("word"))), beginnings)).alias("f"))
    # the toxic side first: only its features are looked for on the other
    wide = feature.filter("bad = 1").groupBy("f").agg(*[F.count_distinct(F.when(F.col("half") == h, F.col("doc"))).alias(f"b{h}") for h in (0, 1)], *[F.count_distinct(F.when(F.col("half") == h, F.col("word"))).alias(f"w{h}") for h in (0, 1)], F.count_distinct("word").alias("w"))
    wide = written(wide.filter("b0 + b1 >= 3").orderBy(F.desc(F.col("b0") + F.col("b1")), "f").limit(most_features), "features")
    others = feature.filter("bad = 0").join(F.broadcast(wide.select("f")), "f").groupBy("f").agg(*[F.count_distinct(F.when(F.col("half") == h, F.col("doc"))).alias(f"g{h}") for h in (0, 1)])
    rows = wide.join(others, "f", "left").fillna(0).collect()  # at most most_features
    n = {(r["bad"], r["half"]): r["count"] for r in restored.groupBy("bad", "half").count().collect()}
    halves = [log_odds([(r["f"], r[f"b{h}"], r[f"g{h}"], r[f"w{h}"]) for r in rows], n.get((1, h), 0), n.get((0, h), 0)) for h in (0, 1)]
    odds = log_odds([(r["f"], r["b0"] + r["b1"], r["g0"] + r["g1"], r["w"]) for r in rows], n.get((1, 0), 0) + n.get((1, 1), 0), n.get((0, 0), 0) + n.get((0, 1), 0))

    def weigh():
        return lambda half, words: ([summary(set(w), halves[1 - h]) for h, w in zip(half, words, strict=True)],)

    weighed = append_columns(restored, ["bad", "doc"], ["half", "words"], weigh, [T.StructField("x", T.ArrayType(T.DoubleType()))]).orderBy("doc").collect()  # a row for each sampled document
    x, y = np.array([r["x"] for r in weighed]), np.array([float(r["bad"]) for r in weighed])
    return {"chars": chars, "odds": odds, "weights": regression(x, y, sizes[1] / (sizes[0] + sizes[1]))}


def scorer(model: dict | None):
    """A function from a text to its score."""
    return Scorer(model).score if model is not None else lambda text: 0.0


def scored(docs: DataFrame, model: dict | None, keep: list[str], name: str = "score") -> DataFrame:
    """docs' `keep` columns with the toxicity score of `text`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        score = scorer(shared.value)
        return lambda texts: ([score(t) for t in texts],)

    return append_columns(docs, keep, ["text"], start, [T.StructField(name, T.DoubleType())])


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), ~in_fold("doc_id", 4, 2))
    rows = docs.withColumn("held_out", in_fold("doc_id", 4, 2))
    return scored(rows, model, ["doc_id", "held_out"]).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
