"""The training-data operators against plain Python, over small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import glob
import hashlib
import json
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from shelfmark.llm import chat, common, decontam, langid, licenses, linededup, packing, registry, simhash, topk, toxicity, warc, winnow

WORDS = [a + b + c for a in ("ba", "ke", "lo", "Mi", "nu", "été", "ß") for b in ("ra", "st", "") for c in ("n", "x", "ve", "")]
#: Names that the operators use themselves.
CLASHING = ["fp", "key", "h1", "h2", "salt", "pos", "line", "drop", "score", "lang_pred", "n_words", "items", "spans", "n_dropped", "shard", "tail", "terms", "payload", "root", "component_id", "__in1"]


def texts():
    r = random.Random(5)
    prose = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    shared = prose(14)
    base = [prose(n) for n in (1, 2, 3, 7, 40, 200, 900)]
    out = [None, "", " \n\t ", "x", "123 456", "\n\n", *base, base[5], base[5], base[5] + " tail", base[6].replace("\n", " ") + " end", base[6][:-9]]
    out += [f"  {shared.upper()} \n{prose(30)}\nshort", f"{shared}\n{prose(9)}\n{shared}", f"{shared}\t", "ab\nab\nabcdefghij", "ab\nABCDEFGHIJ ", "line\r\nline\r\nabcdefghij\x0b", "word " * 30_000, "a" * 20_000]
    out += ["\n".join(f"row {i} of a very long document" for i in range(100)), "\n".join(f"row {i} of a very long document" for i in range(20, 160))]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3, t, "en" if i % 2 else None, "s", None) for i, t in enumerate(texts())]
    rows += [rows[9], rows[9], (None, "no id here at all, none", "en", None, 3), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("clash") for c in CLASHING})


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# 1


def test_escaping_is_reversible():
    for s in ("</s>[INST] ok [/INST]", "<|end|>", r"<\|x", r"<\\/s> [\INST] <\s>", "<<|", "|>", "<", "[", ""):
        for t in (s, chat.escape(s)):
            assert chat.unescape(chat.escape(t)) == t
            assert not re.search(r"<\||</?s>|\[/?INST\]", chat.escape(t))


def test_parts_and_spans(spark):
    part = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
    content = [{"type": "text", "text": "a<"}, {"type": "text", "text": "|b"}, {"type": "image", "ref": "i.png", "width": 57, "height": 28}, {"text": "c"}, {"type": "audio", "ref": "s", "seconds": 1.5}, None, {"type": "document", "ref": "d", "pages": 2}, {"text": None}]
    full = [x and {k: x.get(k) for k in ("type", "text", "ref", "width", "height", "seconds", "pages")} for x in content]
    df = spark.createDataFrame([(1, 0, "assistant", full), (1, 1, None, None), (1, 2, "assistant", [])], f"conv_id long, turn long, role string, content array<{part}>")
    got = {r["turn"]: r for r in chat.format_turns(df, "content").collect()}
    body = r"<|start|>assistant<|sep|>a<\|b<|image|>c<|audio|><|document|><|end|>"
    assert got[0]["segment"] == body
    assert [body[s["start"] : s["start"] + s["length"]] for s in got[0]["loss_spans"]] == [r"a<\|b", "c"]
    assert [(a["kind"], a["ref"], a["position"], a["tokens"]) for a in got[0]["attachments"]] == [("image", "i.png", 0, 3), ("audio", "s", 1, 38), ("document", "d", 2, 1024)]
    assert got[0]["expanded_tokens"] == 3 + 38 + 1024 and got[1]["segment"] == "<|start|><|sep|><|end|>" and got[2]["loss_spans"] == []
    assert chat.read_segment(got[0]["segment"]) == ("assistant", "a<|bc")
    with pytest.raises(ValueError):
        chat.PartVisitor().flatten([{"type": "video"}])


def test_conversation_digests(spark):
    turns = [(7, 1, "assistant", "yes </s>"), (7, 0, "user", None), (7, 0, "user", None), (8, 5, "assistant", ""), (None, 0, None, "<|end|>"), (7, 2, "assistant", "é" * 9)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("segment", F.lit("clash"))
    got = {r["conv_id"]: r for r in chat.conversation_digests(chat.format_turns(df)).collect()}
    by = defaultdict(list)
    for c, t, role, text in sorted(turns, key=lambda x: (x[1], x[2] or "")):
        by[c].append((role or "", text or ""))
    for c, x in by.items():
        loss = "".join(t for role, t in x if role == "assistant")
        assert got[c]["n_turns"] == len(x) and got[c]["loss_chars"] == len(loss)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in x).encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.conversation_digests(chat.format_turns(df.limit(0))).count() == 0


# 2


def test_language_backoff_and_edges(spark, docs):
    train = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([("the cat sat", "en"), ("the dog ran", "en"), ("der hund schläft", "de"), ("die katze schläft", "de"), (None, "fr"), ("x", None)])], "doc_id long, text string, lang string")
    model = langid.fit(train, F.lit(True), least_count=1)
    scorer = langid.Scorer(model)
    assert scorer.predict("the dogs")[0] == "en" and scorer.predict("schläfst")[0] == "de"
    assert scorer.predict("the")[1] > 0.5
    assert (model.word("the") == model.logs[0][model.index[0]["the"]]).all()
    n = max(k for k in range(1, 6) if any(g in model.index[k] for g in langid.grams("schläfst", k)))
    known = [model.index[n][g] for g in langid.grams("schläfst", n) if g in model.index[n]]
    assert np.allclose(model.word("schläfst"), model.logs[n][known].mean(axis=0))
    for t in (None, "", " ", "12 _ 3", "Ⅷ"):
        assert scorer.predict(t) == ("und", 0.0)
    out = langid.predict(docs, model, ["doc_id"]).collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 for r in out)
    empty = langid.fit(train.limit(0), F.lit(True))
    assert langid.Scorer(empty).predict("the cat") == ("und", 0.0)


def test_language_memo_is_bounded_and_does_not_change_scores():
    model = langid.Model(["a", "b"], [("a", 0, "x", 3), ("b", 0, "y", 3), ("a", 1, "q", 1), ("b", 1, "z", 2)], 5)
    small, large = langid.Scorer(model, most=5), langid.Scorer(model)
    for text in ("x q zz", "y y x", "abc qqq z " * 20):
        assert small.predict(text) == large.predict(text)


def plain_language(train, texts, least, max_n=5):
    """Words first, then n-grams from long to short, by plain dictionaries."""
    word = re.compile(r"[^\W\d_]+")
    counts = defaultdict(Counter)
    for text, lang in train:
        for w in word.findall(text.lower()):
            counts[lang, 0][w] += 1
            for n in range(1, max_n + 1):
                padded = f"\x02{w}\x03"
                counts[lang, n].update(padded[i : i + n] for i in range(len(padded) - n + 1))
    langs = sorted({lang for _, lang in train})
    known = [{g for lang in langs for g, k in counts[lang, n].items() if k >= least} for n in range(max_n + 1)]

    def log(lang, n, g):
        own = counts[lang, n]
        return np.log(((own[g] if own[g] >= least else 0) + 0.5) / (sum(own.values()) + 0.5 * max(len(known[n]), len(own))))

    out = []
    for text in texts:
        words = word.findall((text or "").lower())
        if not any(c.isalpha() for w in words for c in w):
            out.append(("und", 0.0))
            continue
        sums = np.zeros(len(langs))
        for w in words:
            padded = f"\x02{w}\x03"
            for n in (0, *range(max_n, 0, -1)):
                pieces = [w] if n == 0 else [padded[i : i + n] for i in range(len(padded) - n + 1)]
                if some := [g for g in pieces if g in known[n]]:
                    sums += [np.mean([log(lang, n, g) for g in some]) for lang in langs]
                    break
        out.append((langs[int(sums.argmax())], float(1 / np.exp(sums - sums.max()).sum())))
    return out


@pytest.mark.parametrize("least", [1, 3])
def test_language_against_plain_python(spark, docs, least):
    r = random.Random(9)
    syllables = {"a": ["ka", "ro", "mi", "st"], "b": ["lu", "ro", "ven", "st"], "c": ["été", "mi", "ßo", "ka"]}
    train = [(" ".join("".join(r.choice(syllables[lang]) for _ in range(r.randint(1, 3))) for _ in range(40)), lang) for lang in "abc" for _ in range(8)]
    rows_ = [(i, t, lang) for i, (t, lang) in enumerate(train)]
    texts_ = [*[" ".join("".join(r.choice(syllables[lang]) for _ in range(r.randint(1, 5))) for _ in range(r.randint(1, 9))) for lang in "abc" for _ in range(15)], None, "", "12", "xyz qq", "KARO Mist"]
    model = langid.fit(spark.createDataFrame(rows_, "doc_id long, text string, lang string"), F.lit(True), least_count=least)
    expected = plain_language(train, texts_, least)
    for got in (langid.Scorer(model).predict_all(texts_), [langid.Scorer(model, most=3).predict(t) for t in texts_]):
        assert [x for x, _ in got] == [x for x, _ in expected] and [s for _, s in got] == pytest.approx([s for _, s in expected], rel=1e-3)


def test_language_held_out_accuracy(spark):
    truth = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang")
    got = registry.QUERIES["op2_language_id"](spark, "/root/testdata/sf0.001").join(truth, "doc_id").filter("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() >= 0.95


# 3


def check_pieces(pieces, texts_by_row):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for t in texts_by_row]
    expected, got = Counter(), Counter()
    for i, own in enumerate(ids):
        expected[len(own)] += len(own)
    for p in pieces:
        got[p["doc_tokens"]] += p["length"]
    assert got == expected
    by_doc = defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
    by_sequence = defaultdict(list)
    for p in pieces:
        by_sequence[p["sequence_id"]].append((p["offset"], p["length"]))
    for x in by_sequence.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at and length > 0
            at += length
        assert at <= 2048
    return ids, by_doc


def test_packing(spark, docs):
    ids, by_doc = check_pieces(packing.pack(docs, shard_rows=8).collect(), [r["text"] for r in docs.select("text").collect()])
    doc_ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
    for doc, own in zip(doc_ids, ids, strict=True):
        if doc is not None and doc_ids.count(doc) == 1:
            at = 0
            for p in sorted(by_doc[doc], key=lambda p: p["start"]):
                assert p["start"] == at and p["ids_crc32"] == zlib.crc32(own[at : at + p["length"]].tobytes())
                at += p["length"]
            assert at == len(own)
    assert packing.pack(docs.limit(0)).count() == 0


def test_packing_wastes_little(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    pieces = packing.pack(df).collect()
    check_pieces(pieces, [r["text"] for r in df.select("text").collect()])
    sizes = Counter()
    for p in pieces:
        sizes[p["sequence_id"]] += p["length"]
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in sizes.values())
    assert padding / (padding + sum(sizes.values())) < 0.03


def test_packing_finds_companions_in_the_whole_corpus(spark):
    r = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    topics = [["".join(r.choice(letters) for _ in range(5)) for _ in range(40)] for _ in range(60)]
    rows = [(i, " ".join(r.choice(topics[i % 60]) for _ in range(150))) for i in range(240)]
    windows = defaultdict(list)
    for p in packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), shard_rows=8).collect():
        windows[p["sequence_id"]].append((p["offset"], p["doc_id"] % 60))
    same = [topic == sorted(x)[0][1] for x in windows.values() for _, topic in sorted(x)[1:2]]
    assert sum(same) > 0.5 * len(same)


def random_shard(seed, n=300, most=400):
    r = np.random.default_rng(seed)
    terms = [np.unique(r.zipf(1.3, r.integers(1, 60)) % most) for _ in range(n)]
    counts, lengths = [r.integers(1, 900, len(t)) for t in terms], r.integers(5, 300, n).astype(float)
    df = np.bincount(np.concatenate(terms), minlength=packing.VOCABULARY)
    weights = packing.Weights(np.where(df > 0, np.maximum(0.0, np.log((n - df + 0.5) / (df + 0.5))), 0.0), 90.0)
    return terms, counts, lengths, weights


def plain_bm25(terms, counts, lengths, weights, seed):
    own = set(terms[seed].tolist())
    return [sum(weights.idf[t] * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * n / weights.mean_length)) for t, c in zip(x.tolist(), k.tolist(), strict=True) if t in own) for x, k, n in zip(terms, counts, lengths, strict=True)]


def test_scores_are_bm25():
    terms, counts, lengths, weights = random_shard(4)
    shard = packing.Shard(terms, counts, lengths, weights)
    assert len(shard.matrix) and len(shard.doc)
    for seed in range(0, 300, 20):
        assert shard.scores(seed) == pytest.approx(plain_bm25(terms, counts, lengths, weights, seed), rel=1e-5)


def plain_fill(lengths, scores, window, cell):
    """Greedy packing by full sorting: the reference for fill()."""
    used, windows, rest = set(), [], None
    while len(used) < len(lengths) or rest:
        seed, begin = rest or (min(set(range(len(lengths))) - used), 0)
        used.add(seed)
        pieces, room, rest = [(seed, begin, lengths[seed] - begin)], window - lengths[seed] + begin, None
        for other in sorted(set(range(len(lengths))) - used, key=lambda x: (-round(scores[seed][x], 3), x)):
            if room < cell:
                break
            took = lengths[other] if lengths[other] <= room else room // cell * cell
            pieces.append((other, 0, took))
            used.add(other)
            room -= took
            if took < lengths[other]:
                rest = (other, took)
        windows.append(pieces)
    return windows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_filling_is_greedy_by_bm25(seed):
    terms, counts, lengths, weights = random_shard(seed)
    shard = packing.Shard(terms, counts, lengths, weights)
    sizes = np.random.default_rng(seed).integers(1, 200, 300)
    scores = [shard.scores(i) for i in range(300)]
    assert list(packing.fill(sizes, shard, 256, 32)) == plain_fill(sizes.tolist(), scores, 256, 32)


def test_router_parts_clusters_and_keeps_copies_together():
    r = np.random.default_rng(5)
    centres = r.normal(size=(6, packing.SKETCH)) * 4
    label = r.integers(0, 6, 3000)
    x = (centres[label] + r.normal(size=(3000, packing.SKETCH))).astype(np.float32)
    router = packing.Router(x, 700)
    leaf = router.leaf(x)
    assert np.bincount(leaf).max() <= 700 and leaf.max() + 1 == router.leaves
    assert np.mean([np.bincount(leaf[label == k]).max() / (label == k).sum() for k in range(6)]) > 0.9
    same = np.ones((500, packing.SKETCH), np.float32)
    assert packing.Router(same, 10).leaves == 1 and set(packing.Router(x, 700).leaf(same)) == {router.leaf(same)[0]}
    assert packing.Router(x[:0], 10).leaf(x[:3]).tolist() == [0, 0, 0]


def test_special_tokens_are_those_of_tokenizers():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encoder = packing.Encoder()
    for text in ("a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|> x", "<|endoftext", "", None, "don't  stop\n\n x1 é ß 漢字"):
        assert encoder.ids(text).tolist() == [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def test_checksums_of_spans():
    ids = np.random.default_rng(1).integers(0, 50_000, 333).astype("<u4")
    running = np.frombuffer(packing.describe(ids, 2048, 32)[1], "<u4")
    for a, b in ((0, 333), (32, 333), (32, 64), (320, 333), (0, 32), (64, 256)):
        assert packing.span_crc(running, a, b, 32) == zlib.crc32(ids[a:b].tobytes())


# 4


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


@pytest.mark.parametrize("most_bytes", [8_000_000, 60])
def test_decontamination(spark, docs, most_bytes):
    long = [r["text"] for r in docs.select("text").collect() if r["text"] and 14 <= len(r["text"].split()) < 2000]
    items = [(1, " ".join(long[0].split()[:12])), (2, " ".join(long[1].split()[2:30]).upper()), (3, "X"), (4, "123, 456"), (5, None), (6, ""), (None, "x"), (7, " ".join(long[1].split()[5:13])), (7, "ab\nab"), (8, "not there at all")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("n_words", F.lit(0))
    got = rows(decontam.scan(docs, bench, ["doc_id"], most_bytes=most_bytes), "doc_id", "n_words", "spans", "items")
    expected = []
    for r in docs.select("doc_id", "text").collect():
        w, hit, found = plain_words(r["text"]), set(), set()
        for item, text in items:
            x = plain_words(text)
            n = min(8, len(x))
            if item is not None and n:
                windows = {tuple(x[s : s + n]) for s in range(len(x) - n + 1)}
                for s in range(len(w) - n + 1):
                    if tuple(w[s : s + n]) in windows:
                        hit |= set(range(s, s + n))
                        found.add(item)
        expected.append((r["doc_id"], len(w), sorted(hit), sorted(found)))
    flat = [(d, n, sorted({p for s in spans for p in range(s["start"], s["start"] + s["length"])}), i) for d, n, spans, i in got]
    assert sorted(flat, key=repr) == sorted(expected, key=repr)
    assert decontam.scan(docs, bench.limit(0), ["doc_id"]).filter("size(items) > 0").count() == 0


def test_winnowing_guarantee():
    rng = np.random.default_rng(2)
    h = rng.integers(0, 6, 300).astype(np.uint64)
    for w in (1, 2, 4):
        chosen = set(winnow.select(h, w).tolist())
        for s in range(len(h) - w + 1):
            window = h[s : s + w]
            assert s + max(i for i in range(w) if window[i] == window.min()) in chosen


def test_spans_are_cut_out():
    assert decontam.without_spans("One, two three; four!", [(1, 2)]) == "One, ; four!"


# 5


def test_warc(spark, tmp_path):
    html = ["<p>a</p>", None, "", "<p>a</p>", "é" * 70_000, "<p>a</p>", "b", "b"]
    pages = [(i, "http://x/\r\ny" if i else None, h) for i, h in zip((5, 6, 2, 3, 4, 9, 1, 1), html, strict=True)] + [(None, "u", "<p>a</p>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("payload", "sha1", "first")})
    for least in (0, 5):
        folder = f"file://{tmp_path}/{least}"
        got = warc.read_archives(warc.write_archives(df, folder, least, archive_bytes=300), folder, payloads=True).collect()
        expected = []
        for page, _, h in pages:
            data = (h or "").encode()
            same = [p for p, _, o in pages if (o or "").encode() == data and p is not None]
            first = min(same) if len(data) >= least and len(same) > 0 else page
            expected.append((page, len(data), warc.digest(data), "response" if first == page else "revisit", None if first == page else first))
        assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=repr) == sorted(expected, key=repr)
        assert all(r["payload"] == next((h or "").encode() for p, _, h in pages if p == r["page_id"]) for r in got if r["record_type"] == "response")


def test_warc_reader_takes_any_chunks_and_finds_damage():
    data = b"".join(warc.page_record(i, "u", b"x" * n, None) for i, n in enumerate((0, 5, 200_000)))
    for size in (1, 7, 1000, len(data)):
        records = list(warc.WarcReader(data[i : i + size] for i in range(0, len(data), size)))
        assert [len(warc.payload_of(b)) for _, b in records] == [0, 5, 200_000]
    assert list(warc.WarcReader([])) == []
    with pytest.raises(warc.WarcError):
        list(warc.WarcReader([data[:-3]]))
    wrong = warc.record([("WARC-Type", "response"), ("WARC-Payload-Digest", "sha1:A")], warc.HTTP + b"x")
    with pytest.raises(warc.WarcError, match="payload"):
        list(warc.WarcReader([wrong]))
    with pytest.raises(warc.WarcError):
        list(warc.WarcReader([b"not gzip at all"]))


# 6


def test_top_k(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, [float(x) for x in v]) for i, v in enumerate(np.round(rng.normal(size=(120, 6)), 1))]
    vectors += [(200 + i, vectors[0][1]) for i in range(8)] + [(0, [9.0] * 6), (300, None), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (302, [float("nan")] * 6), (303, [float("inf")] * 6), (304, [1.0, 2.0]), (305, [2.0, 1.0]), (306, []), (None, [1.0] * 6), (307, [0.0] * 6)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    usable = [(i, [int(np.floor(256 * np.float64(np.float32(x)))) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    queries = {}
    for i, v in sorted(((i, v) for i, v in usable if i % 4 == 0), reverse=True):
        queries[i] = v
    for settings in ({}, {"shard_rows": 16, "block_rows": 7}):
        got = rows(topk.top_k(df, df.filter("vec_id % 4 = 0"), **settings), "query_id", "rank", "vec_id", "score")
        expected = []
        for q, v in queries.items():
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in usable if i != q and len(w) == len(v))[:5]
            expected += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
        assert got == sorted(expected, key=repr)
    assert topk.top_k(df.limit(0), df).count() == 0 and topk.top_k(df, df.limit(0)).count() == 0


def test_top_k_of_large_components(spark):
    values = {0: [1.0] * 4, 1: [70000.0] * 4, 2: [80000.0] * 4, 3: [3e6, -3e6, 1.0, 2.0], 4: [3e8, 1.0, 0.0, 0.5], 5: [-3e8, 2.0, 1.0, 0.0], 6: [1e30] * 4, 7: [-1e30, 1.0, 2.0, 3.0], 8: [0.0] * 4, 9: [0.25, 1.5, -7.0, 2.0]}
    df = spark.createDataFrame([(i, v) for i, v in values.items()], "vec_id long, embedding array<double>")
    whole = {i: [int(np.floor(256 * x)) for x in v] for i, v in values.items()}
    clip = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
    for few in (None, 6):  # with the largest in the shard, and without
        own = df if few is None else df.filter("vec_id <> 6 AND vec_id <> 7")
        ids = [i for i in values if few is None or i not in (6, 7)]
        expected = []
        for q in ids:
            scored = sorted((-clip(sum(a * b for a, b in zip(whole[q], whole[i], strict=True))), i) for i in ids if i != q)[:5]
            expected += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
        assert rows(topk.top_k(own, own), "query_id", "rank", "vec_id", "score") == sorted(expected, key=repr)


def test_threshold_search_stops_early():
    r = np.random.default_rng(1)
    x = np.floor(256 * r.exponential(size=(2000, 3)) ** 3)
    q = np.floor(256 * r.exponential(size=(20, 3)))
    for (places, scores, met), w in zip(topk.threshold_search(x, np.arange(2000), q, np.full(20, -1), 5), q, strict=True):
        all_ = x @ w
        assert scores == sorted(all_.astype(int).tolist(), reverse=True)[:5] and [all_[p] for p in places] == scores
        assert met < 1000


# 7


WORDS_OF_MODEL = {"idiot": 50, "clown": 50, "moron": 50, "the": 500, "trash": 30, "look": 40, "cat": 60, "sat": 60, "loser": 20}


def test_deobfuscation():
    model = toxicity.CharModel.of_words(WORDS_OF_MODEL)
    for token, words in (
        ("1d10t", "idiot"), ("cl0wn", "clown"), ("m.o.r.o.n", "moron"), ("idiiiiot", "idiot"), ("tr@$h", "trash"), ("the", "the"), ("look", "look"), ("looook", "look"), ("l00k", "look"), ("", ""),
        ("iddiot", "idiot"), ("ttrraasshh", "trash"), ("ttraaash", "trash"), ("trash###", "trash"), ("***trash!!", "trash"), ("$%&", ""), ("t r a s h", "trash"), ("tr ash", "trash"), ("the cat sat", "the cat sat"), ("the-cat", "the cat"), ("m o r o n, t r a s h", "moron trash"),
    ):
        assert toxicity.decode(token, model) == words.split(), token
    restorer = toxicity.Restorer(model)
    assert restorer.words("you 1d10t !") >= {"idiot"} and restorer.words(None) == set() and restorer.words("x" * 1000) == set()


def test_no_stretch_is_too_long():
    odds = {"=idiot": 3.0, "=moron": 3.0, "tras": 2.0}
    scorer = toxicity.Scorer({"odds": odds, "weights": [-3.0, 2.0, 0.0, 0.0], "chars": (toxicity.trigrams(WORDS_OF_MODEL),)})
    words = (
        "idiot" + "!" * 100, "-".join(["idiot"] * 30), "i" + "d" * 90 + "iot", "-".join(["cat"] * 30) + "-m0r0n", "cat-trash", "the" + "." * 80 + "tr@$h", "i" + " " * 50 + "d i o" + "\n" * 200 + "t", " " * 9 + "m" + "-" * 90 + " o r o n",
        "id iot" + "#" * 200, "the_idiot", "a" * 300 + "_" + "idiot",
    )
    for text in words:
        assert scorer.score(text) >= 0.3, text[:40]
    for text in ("the-cat-sat-" * 30, "look" * 100, "the" + " " * 200 + "cat", "x" * 100_000, "-" * 100_000):
        assert scorer.score(text) < 0.3, text[:40]
    r = random.Random(6)
    for _ in range(300):
        token = "".join(r.choice([disguised(r.choice(["idiot", "moron", "trash"]), r).replace(" ", ""), "the", "cat", *"-._!|0a1"]) for _ in range(r.randrange(1, 30)))
        assert {w for w in toxicity.decode(token, scorer.chars) if toxicity.strength(w, odds)} <= scorer.token_words([token]), token


def test_only_tokens_around_matches_are_looked_up(monkeypatch):
    odds = {"=idiot": 3.0, "=moron": 3.0, "tras": 2.0, "=as": 2.0, "=лох": 2.0, "=noon": 2.0}
    scorer = toxicity.Scorer({"odds": odds, "weights": [-3.0, 2.0, 0.0, 0.0], "chars": (toxicity.trigrams(WORDS_OF_MODEL),)})
    looked, begins = [], scorer.begins
    with monkeypatch.context() as patch:
        patch.setattr(scorer, "begins", lambda skeleton, at=0: looked.append(skeleton) or begins(skeleton, at))
        many = "the cat sat " * 50 + " ".join(f"cat{i}" for i in range(500))
        assert scorer.score(many) < 0.3 and not looked
        assert scorer.score(many + " 1d10t sat") >= 0.3 and looked == ["idiot"]

    def plain(text):
        """By all tokens, and wherever the skeleton of a known word is."""
        skeleton, _, ends = scorer.skeletons.read(text.replace("\n", " "))
        places = [(int(ends[i]), int(ends[i + len(s) - 1])) for s in scorer.words if len(s) >= 4 for i in range(len(skeleton)) if skeleton.startswith(s, i)]
        return scorer.token_words(list(set(text.split()))) | scorer.spaced_words(text, places)

    r, seen = random.Random(8), 0
    for _ in range(1500):
        text = "".join(x for _ in range(r.randrange(1, 12)) for x in (r.choice([disguised(r.choice([*odds, "trash"]).strip("="), r), "the", "cat", "i", "d", "a"]), r.choice([" ", "  ", "\n", "-", "_", ".", "$", "\xa0", "\u3000", "", "é", "€"])))
        text = text if r.random() < 0.5 else text.encode("latin-1", "ignore").decode("latin-1")
        assert scorer.words_of(text) == plain(text), text
        seen += bool(plain(text))
    assert seen > 500 and scorer.words_of("") == scorer.words_of(" \n.") == set()


def plain_path(steps, model):
    """The best path of a lattice by trying all."""
    import itertools

    def score(options):
        total, tail = 0.0, "  "
        for text, cost in [*options, (" ", 0.0)]:
            total += cost
            for c in text:
                total += model.log(tail + c) if c != " " or tail != "  " else 0.0
                tail = "  " if c == " " else tail[1] + c
        return total, "".join(t for t, _ in options)

    return max(score(path) for path in itertools.product(*steps))


def test_viterbi_is_exact():
    model = toxicity.CharModel.of_words({"abba": 3, "bob": 5, "isis": 2, "lilo": 4, "a": 9})
    for stretch in ("b0bbb", "1s1.s", "l1l0", "aaa|o", "a b b a", "bo b", "$$a-b", "bb oo bb", "#a# l1"):
        steps = toxicity.lattice(stretch)
        assert toxicity.viterbi(steps, model).split() == plain_path(steps, model)[1].split()


@pytest.mark.parametrize("held", [1, 300_000])
def test_corpus_counts_every_document(spark, docs, held):
    words = Counter(w for r in docs.collect() for w in {t.strip(toxicity.EDGES) for t in (r["text"] or "").lower().split()} if w.isalpha())
    expected = toxicity.trigrams(words)
    three, two, context, one = toxicity.corpus_model(docs, held=held)
    plain = toxicity.CharModel(expected)
    assert three == expected and expected["  w"] >= 1 and (two, context, one) == (plain.two, plain.context, plain.one)
    few = toxicity.corpus_model(docs, most_grams=5)
    assert few[0] == dict(sorted(expected.items(), key=lambda x: (-x[1], x[0]))[:5])
    assert few[1] == dict(sorted(plain.two.items(), key=lambda x: (-x[1], x[0]))[:5])  # summed over all trigrams
    assert toxicity.corpus_model(docs.limit(0)) == ({}, {}, {}, {})


def test_beginnings_need_several_endings():
    odds = toxicity.log_odds([("=loser", 3, 0, 1), ("lose", 3, 0, 1), ("vileman", 3, 0, 3), ("vile", 4, 30, 4)], 6, 60)
    assert toxicity.strength("loser", odds) > 0 and toxicity.strength("losebo", odds) == 0 and toxicity.strength("vilemanukke", odds) > 0
    assert set(odds) == {"=loser", "vileman"}


def disguised(word, r):
    """The word in leetspeak, spaced, with repeated letters or between signs."""
    leet = {"o": "0", "i": "1", "a": "@", "e": "3", "s": "$"}
    at = r.randrange(len(word))
    return r.choice([
        "".join(leet.get(c, c) for c in word), " ".join(word), ".".join(word), word[:at] + word[at] * r.randint(2, 5) + word[at + 1 :], f"{word}{r.choice('#%&*$') * 3}", f"**{word}**", "".join(c * 2 for c in word),
    ])


def toxic_corpus(r, bad, n, disguise):
    rows_, labels = [], []
    for i in range(n):
        words = [r.choice(WORDS) for _ in range(30)]
        if i % 4 == 0:
            word = r.choice(bad)
            words[r.randrange(30)] = disguised(word, r) if disguise(i) else word
        rows_.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    return rows_, labels


def test_toxicity(spark, docs, monkeypatch):
    r = random.Random(1)
    bad = ["idiot", "scum", "moron", "loser"]
    rows_, labels = toxic_corpus(r, bad, 480, lambda i: i >= 320)
    labels += [(5, None), (None, 1), (7, 0)]
    df, marks = spark.createDataFrame(rows_, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(df, marks, F.col("doc_id") < 320)
    score = toxicity.scorer(model)
    assert score("ba m0r0n ke") >= 0.3 > score("bara kestn") and score(None) == score("") < 0.3
    held = [(score(t) >= 0.3, i % 4 == 0) for i, t in rows_[320:]]
    found = sum(s and y for s, y in held)
    assert found >= 0.9 * 40 and not any(s and not y for s, y in held)
    out = toxicity.scored(docs, model, ["doc_id"], "own").collect()
    assert len(out) == docs.count() and all(0 <= x["own"] <= 1 for x in out)
    assert toxicity.fit(df, marks.filter("toxic = 0"), F.lit(True)) is None and toxicity.scorer(None)("x") == 0.0
    # a score is that of all restored stretches, whatever the look-up leaves out
    plain = toxicity.Scorer(model)
    for _, text in rows_[320:]:
        restored = {w for t in text.lower().split() for w in toxicity.decode(t, toxicity.CharModel(*model["chars"]))}
        assert {w for w in restored if toxicity.strength(w, model["odds"])} <= plain.token_words(list(set(text.lower().split())))
    # without the decoder far fewer are found
    monkeypatch.setattr(toxicity, "decode", lambda stretch, chars: stretch.split())
    score = toxicity.scorer(model)
    assert sum(score(t) >= 0.3 and i % 4 == 0 for i, t in rows_[320:]) <= 0.5 * found


# 8


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """prints: (id, fingerprint); the smallest id that each fingerprint reaches."""
    parent = {f: f for _, f in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    values = list(parent)
    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 3:
                parent[find(a)] = find(b)
    least = {}
    for doc, f in prints:
        if doc is not None:
            least[find(f)] = min(doc, least.get(find(f), doc))
    return [(doc, f, least.get(find(f))) for doc, f in prints]


def test_near_duplicates(spark, docs):
    expected = plain_components([(r["doc_id"], plain_fingerprint(r["text"])) for r in docs.select("doc_id", "text").collect()])
    got = [(d, f % (1 << 64), c) for d, f, c in rows(simhash.near_duplicates(docs), "doc_id", "fp", "component_id")]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("crowd", [2, 5, 64])
def test_links_of_planted_fingerprints(spark, crowd):
    r = random.Random(4)
    values = [r.getrandbits(64) for _ in range(40)] + [0, (1 << 64) - 1]
    for centre in values[:6]:
        x = centre
        for _ in range(25):  # chains and crowds
            y = centre if r.random() < 0.6 else x
            for _ in range(r.randint(1, 4)):
                y ^= 1 << r.randrange(64)
            values.append(y)
            x = y
    prints = [(i, v) for i, v in enumerate(values)] + [(900 + i, v) for i, v in enumerate(values[:5])]
    df = spark.createDataFrame([(i, simhash.signed(v)) for i, v in prints], "doc_id long, fp long")
    found = {r["fp"] % (1 << 64): r["component_id"] for r in simhash.linked(df, crowd).collect()}
    assert [(i, v, found[v]) for i, v in prints] == plain_components(prints)


def plain_similar(pairs, similarity=0.8):
    """The smallest id of each component of texts whose sets of five-word shingles are similar; pairs: (id, text) with ids."""
    def shingle_set(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = {}
    for doc, text in pairs:
        sets.setdefault(shingle_set(text), set()).add(doc)
    parent = {x: x for x in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    values = list(sets)
    for i, a in enumerate(values):
        for b in values[:i]:
            if len(a & b) >= similarity * len(a | b) and a and b:
                parent[find(a)] = find(b)
    least = {}
    for x, ids in sets.items():
        least[find(x)] = min(min(ids), least.get(find(x), 1 << 63))
    return set(least.values())


def test_one_of_each(spark, docs):
    clashing = docs.withColumns({c: F.lit("clash") for c in ("id_", "text_", "c0", "wide", "__id", "a", "b", "r")})
    kept = simhash.one_of_each(clashing)
    assert kept.columns == clashing.columns
    pairs = [(1 << 62 if r["doc_id"] is None else r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = [1 << 62 if r["doc_id"] is None else r["doc_id"] for r in kept.select("doc_id").collect()]
    assert sorted(got) == sorted(plain_similar(pairs)) and kept.filter("id_ <> 'clash'").count() == 0
    assert simhash.one_of_each(clashing.limit(0)).count() == 0


def test_similar_texts_of_wide_radius(spark):
    r = random.Random(11)
    rows_, near = [], []
    for i in range(60):
        words = [r.choice(WORDS) + str(r.randrange(300)) for _ in range(r.randrange(60, 400))]
        rows_.append((10 * i, " ".join(words)))
        for j in range(1, 4):  # some words changed: similar, or not quite
            changed = list(words)
            for _ in range(max(1, int(len(words) * r.choice([0.004, 0.015, 0.06])))):
                changed[r.randrange(len(words))] = "other" + str(r.randrange(10**6))
            rows_.append((10 * i + j, " ".join(changed)))
    expected = plain_similar(rows_)
    got = {x["doc_id"] for x in simhash.one_of_each(spark.createDataFrame(rows_, "doc_id long, text string")).collect()}
    assert expected <= got and len(got - expected) <= 0.1 * (len(rows_) - len(expected))


@pytest.mark.parametrize("crowd", [1, 3, 16])
def test_no_similar_pair_is_left_out(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "COUNTED", 200)  # a sample
    r = random.Random(12)
    prose = lambda n: [r.choice(WORDS) + str(r.randrange(300)) for _ in range(n)]
    shared, texts_ = prose(30), []
    for i in range(12):
        words = prose(r.choice([12, 40, 150, 300]))
        texts_.append(" ".join(words))
        for _ in range(30):  # crowds and chains about the threshold; many share a passage
            changed = list(words)
            for _ in range(max(1, int(len(words) * r.choice([0.005, 0.01, 0.015, 0.02, 0.03])))):
                changed[r.randrange(len(words))] = "other" + str(r.randrange(10**6))
            changed = changed[: len(changed) - r.randrange(1 + len(words) // 8)] + (shared if i % 4 == 1 else [])
            words = changed if r.random() < 0.3 else words
            texts_.append(" ".join(changed))
    r.shuffle(texts_)
    rows_ = list(enumerate(texts_))
    got = {x["doc_id"] for x in simhash.one_of_each(spark.createDataFrame(rows_, "doc_id long, text string"), crowd=crowd).collect()}
    assert got == plain_similar(rows_)


def on_disk(spark):
    """Shuffle files, and tables in the shared folder."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ").split()
    return {f for f in files if "/shuffle_" in f}, set(glob.glob(common.shared_dir(spark).removeprefix("file:") + "/*"))


def test_written_tables_leave_no_shuffle_behind(spark):
    before, _ = on_disk(spark)
    rows_ = common.written(spark.range(1000).repartition(3, "id"), "rows")
    assert on_disk(spark)[0] <= before and rows_.count() == 1000
    common.discard(rows_)
    assert not [p for p in on_disk(spark)[1] if "/rows-" in p]


def test_near_duplicates_give_their_disk_back(spark, docs, monkeypatch):
    bands, meetings = [], simhash.band_meetings
    monkeypatch.setattr(simhash, "band_meetings", lambda nodes, some: (bands.append(list(some)), meetings(nodes, some))[1])
    _, before = on_disk(spark)
    simhash.one_of_each(docs).count()
    large = {p for p in on_disk(spark)[1] - before if re.search(r"/(fingerprints|nodes|alike|meetings|near|wanted|texts)-", p)}
    assert not large
    assert sum(bands, []) == list(range(2 * simhash.WIDE)) and max(map(len, bands)) <= simhash.BANDS_AT_ONCE


def test_the_exact_pass_goes_on_from_the_components(spark, monkeypatch):
    sizes, components = [], simhash.components
    monkeypatch.setattr(simhash, "components", lambda links: (sizes.append(links.count()), components(links))[1])
    nodes = spark.createDataFrame([(i, i, 0, 0, 9, [100 + i], [0] * 8) for i in range(6)], "set_ long, id_ long, text_ long, own_ long, size int, first array<long>, sketch array<long>")
    keyed = spark.createDataFrame([(i, 0, 0, f"text {i}") for i in range(6)], "id_ long, text_ long, own_ long, text string")
    links = spark.createDataFrame([(i, j) for i in range(5) for j in range(i)], "a long, b long")
    found = simhash.whole_links(nodes, keyed, links, 0.8, 5, 16)
    assert {r["node"]: r["root"] for r in components(found).collect()} == dict.fromkeys(range(5), 0)
    assert sizes == [10] and found.count() == 5


@pytest.mark.parametrize("hub", [1, 256])
def test_components_of_hubs_and_chains(spark, monkeypatch, hub):
    monkeypatch.setattr(simhash, "HUB", hub)
    links = [(0, i) for i in range(1, 30)] + [(100 + i, 101 + i) for i in range(12)] + [(5, 200), (300, 301)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(links, "a long, b long")).collect()}
    expected = {i: 0 for i in [*range(1, 30), 200]} | {i: 100 for i in range(101, 113)} | {301: 300}
    assert {k: v for k, v in got.items() if k != v} == expected


def largest_plan(spark, action):
    """The most exchanges that a query of the action has: the driver holds all of them, and plans anew after each."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    action()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    ran = store.executionsList()
    plans = [ran.apply(i).physicalPlanDescription().partition("== Initial Plan ==")[0] for i in range(before, ran.size())]
    return max(len(re.findall(r"\b(?:Broadcast)?Exchange \(\d+\)", x)) for x in plans)


@pytest.mark.parametrize("hub", [1, 256])
def test_components_come_in_small_plans(spark, monkeypatch, hub):
    monkeypatch.setattr(simhash, "HUB", hub)
    links = spark.createDataFrame([(0, i) for i in range(1, 300)] + [(1000 + i, 1001 + i) for i in range(500)], "a long, b long")
    found = {}
    assert 0 < largest_plan(spark, lambda: found.update({r["node"]: r["root"] for r in simhash.components(links, rounds=20).collect()})) <= 8
    assert found == {i: 0 for i in range(300)} | {i: 1000 for i in range(1000, 1501)}


@pytest.mark.parametrize("bits", [64, 1 << 24])
def test_rows_that_certainly_are_not_among_the_keys(spark, monkeypatch, bits):
    monkeypatch.setattr(simhash, "FILTER_BITS", bits)
    rows_ = spark.range(2000).selectExpr("id AS x", "concat('t', id) AS y")
    maybe, never = simhash.among(rows_, spark.range(0, 2000, 40).selectExpr("id AS x"), ["x"])
    found, rest = {r["x"] for r in maybe.collect()}, {r["x"] for r in never.collect()}
    assert found >= set(range(0, 2000, 40)) and found | rest == set(range(2000)) and not found & rest and maybe.columns == ["x", "y"]
    assert simhash.among(rows_, spark.range(0).selectExpr("id AS x"), ["x"])[0].count() == 0


def test_links_at_a_key_span_what_is_close():
    r = random.Random(2)
    centre = r.getrandbits(63)
    for size in (2, 4, 5, 60):
        group = np.unique(np.array([centre ^ sum({1 << r.randrange(63) for _ in range(r.randrange(1, 25))}) for _ in range(size)], np.int64))
        links = simhash.spanning_links(group)
        assert all(a < b and (a ^ b).bit_count() <= simhash.NEAR_FIRST for a, b in links) and (len(group) <= 4 or len(links) < len(group))
        for d in range(1, simhash.NEAR_FIRST + 1):

            def parts(pairs, members=group.tolist()):
                parent = {x: x for x in members}

                def find(x):
                    while parent[x] != x:
                        x = parent[x]
                    return x

                for a, b in pairs:
                    if (a ^ b).bit_count() <= d:
                        parent[find(a)] = find(b)
                return {frozenset(y for y in members if find(y) == find(x)) for x in members}

            assert parts(links) == parts([(a, b) for i, a in enumerate(group.tolist()) for b in group.tolist()[i + 1 :]])


# 9


def plain_line_dedup(pairs):
    strip = lambda s: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", s)
    key = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in strip(s))
    last = 1 << 63
    holders = defaultdict(set)
    for doc, text in pairs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                holders[key(line)].add(last if doc is None else doc)
    out = []
    for doc, text in pairs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(holders[key(x)]) > 1 and (last if doc is None else doc) > min(holders[key(x)]))]
        out.append((doc, "\n".join(kept), len(lines) - len(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("salts", [None, 1, 7])
def test_line_dedup(spark, docs, salts):
    pairs = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert rows(linededup.deduplicated(docs, salts=salts), "doc_id", "__kept", "__n_dropped") == plain_line_dedup(pairs)
    assert linededup.deduplicated(docs.limit(0)).count() == 0


def test_line_dedup_runs_no_python(spark):
    plan = registry.QUERIES["op9_line_dedup"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# 10


def test_alignment_is_the_banded_longest_common_subsequence():
    r = random.Random(6)
    for _ in range(200):
        a, b = [r.choice("abc") for _ in range(r.randint(1, 8))], [r.choice("abc") for _ in range(r.randint(0, 9))]
        table_ = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table_[i + 1][j + 1] = max(table_[i][j + 1], table_[i + 1][j], table_[i][j] + (x == y))
        matched, first, last = licenses.align(a, b, -20, 20)
        assert matched == table_[-1][-1]
        if matched:
            within = licenses.align(a, b[first : last + 1], -20, 20)
            assert within == (matched, 0, last - first)


def test_alignment_on_bands_with_gaps():
    r = random.Random(12)
    for _ in range(100):
        a, b = ([r.choice("abc") for _ in range(r.randrange(1, 12))] for _ in range(2))
        assert licenses.align_bands(a, b, list(range(-20, 21))) == licenses.align(a, b, -20, 20)
    t = [str(i) for i in range(60)]
    assert licenses.align_bands(t, t[:30] + ["x"] * 40 + t[30:], [-1, 0, 1, 39, 40, 41]) == (60, 0, 99)
    assert licenses.align_bands(t, t[:20] + t[45:], [-26, -25, -24, -1, 0, 1]) == (35, 0, 34)


@pytest.mark.parametrize("extra", [10, 20, 50])
@pytest.mark.parametrize("share", [0.3, 0.5, 0.7])
def test_license_with_words_inserted(extra, share):
    mit = "\n".join(licenses.templates()["MIT"])
    find = licenses.finder(licenses.build({("MIT", 0): mit}, 3, 3), 8, 0.6)
    own = plain_words(mit)
    cut = int(len(own) * share)
    inserted = [f"page{i}" for i in range(extra)]
    text = ["before", *own[:cut], *inserted, *own[cut:], "after", *own, "end"]
    (match,) = [m for m in find([[w.encode() for w in text]])[0] if m["license"] == "MIT"]
    assert match["coverage"] == 1.0 and match["spans"] == [{"start": 1, "length": len(own) + extra}, {"start": len(own) + extra + 2, "length": len(own)}]
    text = ["before", *own[:cut], *inserted, *own[cut:], "after"]
    (match,) = [m for m in find([[w.encode() for w in text]])[0] if m["license"] == "MIT"]
    assert match["coverage"] == 1.0 and match["spans"] == [{"start": 1, "length": len(own) + extra}]


@pytest.mark.parametrize("block_bytes", [2_000_000, 60_000])
def test_license_scan(spark, docs, block_bytes):
    mit, isc = licenses.templates()["MIT"][0], licenses.templates()["ISC"][0]
    changed = mit.replace("furnished", "given").replace("publish, ", "")
    half = " ".join(mit.split()[: len(mit.split()) // 2])
    planted = [
        (1001, f"intro words here {changed} and more"), (1002, mit.upper()), (1003, mit[:60]), (1004, "all rights; reserved. x all RIGHTS reserved"), (1005, "the software is sold"),
        (1006, "This work is released under the MIT License, as is."), (1007, "released under the WTF License"), (1008, "Licensed under CC BY-NC 4.0."), (1009, half), (1010, f"{mit} {isc} {mit}"),
        (1011, "Released under the GNU General Public License, version 3."),
    ]
    df = spark.createDataFrame(planted, "doc_id long, text string")
    got = {(r["doc_id"], r["license"]): r for r in licenses.scan(df.unionByName(docs.select("doc_id", "text")), ["doc_id"], block_bytes=block_bytes).collect()}
    n = len(plain_words(mit))
    assert got[1002, "MIT"]["coverage"] == 1.0 and got[1002, "MIT"]["spans"][0]["start"] == 0 and got[1002, "MIT"]["spans"][0]["length"] == n
    assert got[1001, "MIT"]["matched_words"] == n - 2 and got[1001, "MIT"]["spans"][0]["start"] == 3
    assert [s["start"] for s in got[1004, "All-rights-reserved"]["spans"]] == [0, 4]
    assert got[1006, "MIT-reference"]["coverage"] == 1.0 and got[1006, "MIT-reference"]["spans"][0]["start"] == 3
    assert (1008, "CC-BY-NC-4.0-reference") in got and (1011, "GPL-3-reference") in got and (1011, "GPL-2-reference") not in got
    assert [s["start"] for s in got[1010, "MIT"]["spans"]] == [0, n + len(plain_words(isc))] and got[1010, "ISC"]["coverage"] == 1.0
    assert not [k for k in got if k[0] in (1003, 1005, 1007, 1009)]
    assert licenses.scan(docs, ["doc_id"], {}).count() == 0 and licenses.scan(docs.limit(0), ["doc_id"]).count() == 0


def test_whole_licenses_are_known():
    known = licenses.templates()
    assert {"MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "Unlicense", "AGPL-3.0-notice"} <= set(known)
    for name, texts_ in known.items():
        find = licenses.finder(licenses.build({(name, i): t for i, t in enumerate(texts_)}, 3, 3), 8, 0.6)
        found = {m["license"]: m["coverage"] for m in find([["before"] + [w.encode() for w in plain_words(texts_[0])] + ["after"]])[0]}
        assert found[name] == 1.0


def test_retrieval_loses_no_match_of_changed_copies():
    r = random.Random(7)
    known = {n: licenses.templates()[n][0] for n in ("MIT", "ISC", "Zlib", "BSD-3-Clause", "Apache-2.0-notice", "GPL-3.0-notice", "MPL-2.0-notice", "Unlicense")}
    find = licenses.finder(licenses.build({(n, 0): t for n, t in known.items()}, 3, 3), 8, 0.6)
    kept = []
    for share in (0.05, 0.15, 0.3):
        for name, text in known.items():
            own = [w.encode() for w in plain_words(text)]
            for _ in range(4):
                changed = [b"other%d" % r.randrange(10**6) if r.random() < share else w for w in own]
                expected = licenses.align(own, changed, -8, 8)[0]
                found = {m["license"]: m["matched_words"] for m in find([[b"x"] * 5 + changed + [b"y"] * 5])[0]}
                if expected >= 0.67 * len(own):
                    kept.append(found[name] / expected)
    assert np.mean(kept) > 0.98 and min(kept) > 0.8  # words beside a repeated phrase may fall between two regions


# Pipeline


def test_pipeline_against_plain_python(spark, docs, tmp_path):
    folder = str(tmp_path / "sf")
    r = random.Random(8)
    bench = [(i, " ".join(r.choice(WORDS) for _ in range(15))) for i in range(4)]
    extra = [(800, "zz " + bench[0][1] + " mid " + bench[1][1]), (801, "start " + bench[2][1] + " finish of it"), (802, "clean text of plain words and nothing else")]
    more = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in extra], "doc_id long, text string, lang string, source string, n_chars long")
    names = ["items", "spans", "n_words", "__id", "__text", "__body", "__kept", "__lang", "__score", "__cut", "id_", "text_", "c0", "column_0", "__in0", "row", "word"]
    own = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(more)
    own.withColumns({c: F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in names}).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    state = spark.read.parquet(f"{folder}/documents.parquet")
    pairs = [(x["doc_id"], x["text"]) for x in state.collect()]
    columns = state.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, state, folder)
        got = sorted(((x["doc_id"], x["text"]) for x in out.collect()), key=repr) if "text" in out.columns else out.collect()
        if name == "language_id":
            assert set(got) <= set(pairs) and all(any(c.isalpha() for c in t or "") for _, t in got)
            assert {d for d, _ in got} >= {800, 801, 802}
        elif name == "line_dedup":
            assert got == sorted([(d, t) for d, t, _ in plain_line_dedup(pairs)], key=repr)
        elif name == "simhash_near_dedup":
            with_ids = [(1 << 62 if d is None else d, t) for d, t in pairs]
            assert sorted(1 << 62 if d is None else d for d, _ in got) == sorted(plain_similar(with_ids)) and set(got) <= set(pairs)
        elif name == "decontamination":
            assert 800 not in dict(got) and dict(got)[801] == "start  finish of it" and dict(got)[802] == dict(pairs)[802]
        else:
            check_pieces(got, [t for _, t in pairs])
            break
        assert out.columns == columns
        for c in names:  # columns of any name stay as they are
            assert out.filter(F.col(f"`{c}`") != F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")))).count() == 0
        assert stage(spark, state.limit(0), folder).count() == 0
        out.write.parquet(path := str(tmp_path / name))
        state = spark.read.parquet(path)
        pairs = got
    ran = Counter((x["doc_id"], x["doc_tokens"]) for x in corpus_pipeline.run(spark, folder).collect())
    assert ran == Counter((x["doc_id"], x["doc_tokens"]) for x in got)
    assert json.dumps([n for n, _ in corpus_pipeline.STAGES])
