import json
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.operators import annotate, blocks, clean, dense, hybrid, metrics, quality, serving, setsim, sparse
from shelfmark.operators.topk import priority_union, top_k
from shelfmark.sources import catalog, nested, paged
from shelfmark.sources.store import stored
from shelfmark.streaming.append import append_new


def items(spark, rows):
    columns = ["id", "title_romaji", "title_english", "title_native", "format", "source", "genres", "tags", "studios", "description", "popularity", "episodes", "averageScore", "cover_image"]
    full = [{c: r.get(c, "") for c in columns} | {"popularity": r.get("popularity", 0)} for r in rows]
    return spark.createDataFrame([tuple(r[c] for c in columns) for r in full], ", ".join(f"{c} {'long' if c == 'popularity' else 'string'}" for c in columns))


@pytest.fixture(scope="module")
def small(spark):
    return items(spark, [
        {"id": "1", "title_romaji": "Sea Wolf", "genres": "Drama|Action", "tags": "sea|wolf|war|crew", "description": "a lonely captain sails", "popularity": 50, "averageScore": "70"},
        {"id": "2", "title_romaji": "Sea Wolf 2", "genres": "Drama|Action", "tags": "sea|wolf|war|crew", "description": "the captain sails again", "popularity": 40, "episodes": "1501"},
        {"id": "3", "title_romaji": "Garden", "genres": "Romance", "tags": "flower", "description": "quiet flowers bloom", "popularity": 30},
        {"id": "3", "title_romaji": "Garden!", "genres": " Romance ||", "tags": "flower", "description": "quiet &amp; old", "popularity": 20},
        {"id": "4", "title_romaji": "Void", "popularity": 10},
    ])


def test_cleaning(small):
    rows = {r["id"]: r for r in clean.clean(small).collect()}
    assert set(rows) == {"1", "2", "3"}
    assert rows["2"]["episodes_outlier"] and not rows["1"]["episodes_outlier"]
    assert rows["1"]["has_score"] and not rows["3"]["has_score"]
    changed = {r["step"]: r["changed"] for r in clean.changes(small).collect()}
    assert changed["drop_empty_core"] == 1 and changed["remove_duplicate_ids"] == 1 and changed["decode_entities"] == 1 and changed["standardize_lists"] == 1


def test_empty_profile_and_report(spark, small, tmp_path):
    assert quality.snapshot(small.limit(0)).first()["genres_pct"] == 0.0
    full = small.withColumns({c: F.lit("") for c in ("meanScore", "seasonYear", "duration", "status", "season", "end_date", "favourites", "cover_image")})
    profile = quality.profile(full, ["id", "genres"])
    assert {r["check"]: r["count"] for r in profile.collect()}["duplicate ids"] == 1
    quality.write_report(profile, str(tmp_path / "r.md"))
    assert "| duplicate ids | 1 | 20.0% |" in (tmp_path / "r.md").read_text()


def test_bm25f_by_hand(spark):
    docs = items(spark, [{"id": "a", "description": "red red blue"}, {"id": "b", "description": "red"}, {"id": "c", "description": "green"}])
    got = {(r["seed_id"], r["rec_id"]): r["score"] for r in sparse.bm25f_best(docs, docs.filter("id = 'b'"), 3).collect()}
    idf, average = math.log(1 + (3 - 2 + 0.5) / 2.5), 5 / 3
    wtf = 2 / (1 - 0.75 + 0.75 * 3 / average)
    assert got["b", "a"] == pytest.approx(idf * 2.5 * wtf / (1.5 + wtf + 1e-9))
    assert ("b", "c") not in got


def test_tfidf_by_hand(spark):
    docs = items(spark, [{"id": "a", "description": "red red blue"}, {"id": "b", "description": "red blue"}, {"id": "c", "description": "green"}])
    w = {(r["id"], r["term"]): r["w"] for r in sparse.tfidf(docs, sparse.field_text("description")).collect()}
    idf = math.log(4 / 3) + 1
    raw = {"red": (1 + math.log(2)) * idf, "blue": idf, "red blue": idf}
    norm = math.sqrt(sum(x * x for x in raw.values()))
    assert w["a", "red"] == pytest.approx(raw["red"] / norm)
    assert ("a", "red red") not in w and not any(k[0] == "c" for k in w)


def test_candidates_order_and_limits(small):
    p = setsim.prepared(small.filter("title_romaji <> 'Garden!'"))
    assert [r["id"] for r in p.orderBy("pos").collect()] == ["1", "2", "3"]
    rows = setsim.candidates(p).collect()
    assert ("1", "2", "same_franchise_candidate") in {(r["seed_id"], r["rec_id"], r["candidate_source"]) for r in rows}
    assert len({(r["seed_id"], r["rec_id"]) for r in rows}) == len(rows)


def test_jaccard_and_min_max(spark):
    sets = spark.createDataFrame([("x", ["a", "b"]), ("y", ["b", "c"]), ("z", [])], "id string, s array<string>")
    got = {(r["seed_id"], r["rec_id"]): r["score"] for r in setsim.jaccard_best(sets, sets, "s", 5).collect()}
    assert got["x", "y"] == pytest.approx(1 / 3) and ("x", "x") not in got and ("z", "x") not in got
    x = np.array([[1.0, 5.0], [3.0, 5.0], [2.0, 5.0]])
    assert hybrid.scale(x, x.min(axis=0), x.max(axis=0)).tolist() == [[0.0, 0.0], [1.0, 0.0], [0.5, 0.0]]


def test_blocks_against_plain_python(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 7)
    r = np.random.default_rng(1)
    terms = [f"t{i}" for i in range(12)]
    rows = []
    for i in range(60):
        own = sorted(r.choice(terms, r.integers(0, 6), replace=False).tolist())
        rows.append((f"i{i:02d}", own, np.round(r.random(len(own)), 1).tolist(), None if i % 9 == 0 else np.round(r.normal(size=3), 1).tolist()))
    df = spark.createDataFrame(rows, "id string, a_t array<string>, a_w array<double>, d_w array<double>").repartition(3)
    seeds = [x for x in rows if int(x[0][1:]) % 3 == 0]
    own = df.filter("cast(substr(id, 2) as int) % 3 = 0")

    def best(score, positive):
        out = {}
        for s in seeds:
            scored = sorted((-np.floor(score(s, x) * 1e6 + 0.5), x[0]) for x in rows if x[0] != s[0] and (not positive or score(s, x) > 0))[:4]
            out[s[0]] = [i for _, i in scored]
        return out

    dot = lambda s, x: sum(w * dict(zip(s[1], s[2], strict=True)).get(t, 0.0) for t, w in zip(x[1], x[2], strict=True))
    dense = lambda s, x: float(np.dot(s[3] or [0, 0, 0], x[3] or [0, 0, 0]))

    def got(frame):
        out = {s[0]: [] for s in seeds}
        for x in top_k(frame, 4).orderBy("seed_id", "rank").collect():
            out[x["seed_id"]].append(x["rec_id"])
        return out

    assert got(blocks.best_of(df, own, {"a": "dot"}, 4)) == best(dot, True)
    both = lambda *_: lambda ids, scores: scores["a"] + 0.5 * scores["d"]
    assert got(blocks.best_of(df, own, {"a": "dot", "d": "dense"}, 4, both)) == best(lambda s, x: dot(s, x) + 0.5 * dense(s, x), False)
    assert blocks.best_of(df, own.limit(0), {"a": "dot"}, 4).count() == 0 and blocks.best_of(df.limit(0), own, {"a": "dot"}, 4).count() == 0


def test_judged_and_audit_rows(spark, small, tmp_path):
    p = setsim.prepared(small.filter("title_romaji <> 'Garden!'"))
    rows = setsim.candidate_rows(small, setsim.candidates(p))
    assert set(catalog.CANDIDATE_COLUMNS) <= set(rows.columns) and rows.filter("seed_title IS NULL OR candidate_title IS NULL").count() == 0
    first = rows.orderBy("seed_id", "rank").first()
    reply = json.dumps({"recommendations": [{"candidate_id": "nobody", "rank": 1, "similarity_label": 2, "similarity_score_10": 10, "reason": "x"}, {"candidate_id": first["candidate_id"], "rank": 3, "similarity_label": 0, "similarity_score_10": 12, "reason": " good "}, {"candidate_id": first["candidate_id"], "rank": 1, "similarity_score_10": 0}]})
    replies = spark.createDataFrame([(first["seed_id"], "noise " + reply)], "seed_id string, reply string")
    lists = annotate.judged(replies, rows.select("seed_id", F.col("candidate_id").alias("rec_id"), F.col("rank").alias("pos")).filter(F.col("seed_id") == first["seed_id"]))
    full = annotate.judged_rows(lists, rows)
    assert full.columns == catalog.JUDGED_COLUMNS
    got = full.orderBy("rank").collect()
    assert (got[0]["recommended_id"], got[0]["similarity_label"], got[0]["similarity_score_10"], got[0]["reason"]) == (first["candidate_id"], 2, 10, "good")
    assert all(x["reason"] == annotate.BACKUP and x["similarity_score_10"] == 4 for x in got[1:])
    catalog.append_audit(annotate.audit_records(full), str(tmp_path / "audit"))
    (record,) = spark.read.json(str(tmp_path / "audit")).collect()
    assert record["seed_id"] == first["seed_id"] and [x["rank"] for x in record["recommendations"]] == list(range(1, len(got) + 1))
    prompt = annotate.verify_prompt("the pool", reply, 2)
    assert "pass 2" in prompt and "the pool" in prompt and "score: 12" in prompt


def test_evaluation_reports(spark):
    judged = spark.createDataFrame([("a", "x", 2), ("a", "y", 1), ("gone", "x", 2)], "seed_id string, rec_id string, label int")
    predicted = spark.createDataFrame([("a", 1, "x"), ("a", 2, "z")], "seed_id string, rank int, rec_id string")
    items_ = spark.createDataFrame([("a",), ("x",)], "id string")
    strict = metrics.precision_recall(predicted, judged, catalog=items_)
    assert strict.filter("k = 10").first()["seeds"] == 1 and metrics.precision_recall(predicted, judged).filter("k = 10").first()["seeds"] == 2
    assert "| Precision@10 | 0.1000 |" in metrics.model_report("m", strict) and "| Evaluated seeds | 0 |" in metrics.model_report("m", strict.limit(0))
    report = metrics.comparison_report("NDCG", {"m": metrics.ndcg(predicted, judged, catalog=items_)}, {"ndcg": "NDCG"})
    assert "| Model | NDCG@3 | NDCG@5 | NDCG@10 | NDCG@15 |" in report
    both = metrics.strict_lenient_report("All", {"m": strict}, {"m": metrics.precision_recall(predicted, judged, threshold=1, catalog=items_)})
    assert "## Strict" in both and "## Lenient" in both and "P@3 | R@3" in both


def test_metrics_by_hand(spark):
    predicted = spark.createDataFrame([("s", 1, "a"), ("s", 2, "b")], "seed_id string, rank int, rec_id string")
    judged = spark.createDataFrame([("s", "a", 1), ("s", "b", 2), ("t", "a", 0)], "seed_id string, rec_id string, label int")
    assert metrics.ndcg(predicted, judged, [2]).first()["ndcg"] == pytest.approx(0.796708, abs=1e-6)
    relevant = spark.createDataFrame([("s", r, 2) for r in "bwxy"], "seed_id string, rec_id string, label int")
    row = metrics.precision_recall(predicted, relevant, [10]).first()
    assert (row["precision"], row["recall"], row["seeds"]) == (0.1, 0.25, 1)
    twice = spark.createDataFrame([("s", "a", 2, 1), ("s", "a", 0, 2)], "seed_id string, rec_id string, label int, pos int")
    assert metrics.judged_once(twice).first()["label"] == 0


def test_priority_union_keeps_the_first_source(spark):
    rows = lambda *r: spark.createDataFrame([("s", i + 1, x) for i, x in enumerate(r)], "seed_id string, rank int, rec_id string")
    got = priority_union([("one", rows("a", "b", "c"), 2), ("two", rows("b", "d"), 2)], 3).orderBy("rank").collect()
    assert [(r["rec_id"], r["candidate_source"]) for r in got] == [("a", "one"), ("b", "one"), ("d", "two")]


def test_top_k_ties_go_to_the_smaller_id(spark):
    scores = spark.createDataFrame([("s", "b", 1.0), ("s", "a", 1.0), ("s", "s", 9.0)], "seed_id string, rec_id string, score double")
    assert [r["rec_id"] for r in top_k(scores, 2).orderBy("rank").collect()] == ["a", "b"]


def test_judged_lists(spark):
    reply = json.dumps({"recommendations": [{"candidate_id": "b", "similarity_score_10": 3}, {"candidate_id": "a", "similarity_score_10": 99}, {"candidate_id": "q", "similarity_score_10": 9}, {"candidate_id": "a", "similarity_score_10": 1}]})
    replies = spark.createDataFrame([("s", f"Sure: {reply} done")], "seed_id string, reply string")
    pool = spark.createDataFrame([("s", x, i) for i, x in enumerate("abcd")], "seed_id string, rec_id string, pos int")
    rows = annotate.judged(replies, pool, 3).orderBy("rank").collect()
    assert [(r["rec_id"], r["score_10"], r["label"]) for r in rows] == [("a", 10, 2), ("c", 4, 1), ("b", 3, 0)]


def test_prompts_client_and_wide(spark):
    rows = spark.createDataFrame([("s", "Seed", "X|Y", 2, "b", "B", "", "", "t"), ("s", "Seed", "X|Y", 1, "a", "A", "g|h", "t", "u")], "seed_id string, seed_title string, seed_genres string, rank int, rec_id string, title string, genres string, tags string, description string")
    prompt = annotate.prompts(rows).first()["prompt"]
    assert prompt.index("id: a") < prompt.index("id: b") and "X, Y" in prompt and "g, h" in prompt
    slept, answers = [], [(429, {"Retry-After": "3"}, ""), (500, {}, "oops"), (200, {}, "fine")]
    assert annotate.ChatClient(lambda p: answers.pop(0), sleep=slept.append).call("x") == "fine" and slept == [3.0, 16.0]
    with pytest.raises(RuntimeError):
        annotate.ChatClient(lambda p: (500, {}, ""), tries=2, sleep=slept.append).call("x")
    assert annotate.extract_json('noise {"a":1} tail') == {"a": 1}
    told = spark.createDataFrame([("s", "S", 1, "old", 1, 4, "r", 1), ("s", "S", 1, "new", 2, 8, "r", 2)], "seed_id string, seed_title string, rank int, title string, label int, score_10 int, reason string, pos int")
    wide = annotate.wide(told, range(1, 3)).first()
    assert (wide["rec_1_title"], wide["rec_1_label"], wide["rec_2_title"]) == ("new", "2", "")
    echo = annotate.ask(annotate.prompts(rows), lambda: annotate.ChatClient(lambda p: (200, {}, "ok")))
    assert echo.first()["reply"] == "ok"
    assert annotate.unfinished(rows, rows.limit(1)).count() == 0


def test_serving(spark, small):
    ranked = setsim.ranked(small)
    assert [r["id"] for r in serving.search_titles(ranked, "SEA w").collect()] == ["1", "2"]
    assert serving.search_titles(ranked, "c++ (").count() == 0 and serving.search_titles(ranked, " ").count() == 0
    models = {"one": lambda: lambda seed, k: spark.createDataFrame([("1", 1, "2", 0.123456)], "seed_id string, rank int, rec_id string, score double")}
    api = serving.Recommender(ranked, models)
    row = api.recommend("one", q="sea wolf").first()
    assert (row["id"], row["score"]) == ("2", 0.1235)
    with pytest.raises(serving.BadRequest):
        api.recommend("none", id="1")
    with pytest.raises(KeyError):
        api.recommend("one", id="99")
    with pytest.raises(KeyError):
        api.recommend("one")
    with pytest.raises(ValueError):
        api.recommend("one", id="1", top_k="x")


def test_catalog_files(spark, tmp_path):
    path = str(tmp_path / "items")
    rows = spark.createDataFrame([("1", 'He said "hi", twice\nand left', "N/A", "12"), ("x", "", "b", "7")], "id string, title_romaji string, title_english string, popularity string")
    catalog.append(rows, path)
    catalog.append(rows.filter("id = '1'"), path)
    assert catalog.count_rows(spark, path) == 3 and catalog.size_mb(path) > 0
    back = catalog.read_catalog(spark, path).first()
    assert (back["title_romaji"], back["title_english"], back["popularity_num"]) == ('He said "hi", twice\nand left', "", 12.0)
    assert [r["id"] for r in catalog.existing_ids(spark, path).collect()] == ["1"]
    assert catalog.existing(spark, str(tmp_path / "none")).count() == 0
    judged = spark.createDataFrame([("s", "S", 1, "a", 2, 8, "r")], "seed_id string, seed_title string, rank int, recommended_id string, similarity_label int, similarity_score_10 int, reason string")
    catalog.append_audit(annotate.audit_records(judged), str(tmp_path / "audit"))
    assert spark.read.json(str(tmp_path / "audit")).first()["recommendations"][0]["candidate_id"] == "a"


def body(page, n, more, first=0):
    media = [{"id": first + i, "title": {"romaji": f"T{first + i}"}, "popularity": 1000 - first - i, "startDate": {"year": 2001, "month": 2}, "genres": ["a", "", "b"], "tags": [{"name": "t", "rank": 1}], "studios": {"nodes": [{"name": "s"}]}, "description": "x<br>y"} for i in range(n)]
    return json.dumps({"data": {"Page": {"pageInfo": {"currentPage": page, "hasNextPage": more}, "media": media}}})


def test_flatten(spark):
    rows = nested.flatten(nested.parse_pages(spark.createDataFrame([(body(1, 1, False),), ("{}",)], "body string"))).collect()
    assert len(rows) == 1 and (rows[0]["start_date"], rows[0]["genres"], rows[0]["tags"], rows[0]["studios"], rows[0]["description"], rows[0]["end_date"]) == ("2001-02", "a|b", "t", "s", "x y", "")


def test_scrape_resumes_and_stops(spark):
    pages, saved, slept = [(200, {}, body(1, 2, True)), (429, {"Retry-After": "2"}, ""), (200, {}, body(2, 2, False, first=2))], [], []
    client = paged.PagedClient(lambda v: pages.pop(0), delay=0, sleep=slept.append)
    known = spark.createDataFrame([("1",)], "id string")
    assert paged.scrape(spark, client, known, lambda df: saved.extend(r["id"] for r in df.collect())) == 2
    assert saved == ["0", "2", "3"] and slept == [2.0]


def test_scrape_raises_if_the_bound_does_not_move(spark, monkeypatch):
    monkeypatch.setattr(paged, "PAGES_PER_WINDOW", 1)
    client = paged.PagedClient(lambda v: (200, {}, body(1, 1, True)), delay=0, sleep=lambda s: None)
    with pytest.raises(RuntimeError, match="does not move"):
        paged.scrape(spark, client, spark.createDataFrame([], "id string"), lambda df: None, max_pages=5)


def test_pages_data_source_partitions():
    reader = paged.PagesReader({"first": "2", "last": "4", "fetch": "x:y"})
    assert [p.value for p in reader.partitions()] == [2, 3, 4]


def test_vector_cache(spark, small, tmp_path):
    built = []

    def build(df):
        built.append(1)
        return dense.encode(df, "title_romaji", lambda texts: [[float(len(t)), 1.0] for t in texts])

    ids = small.dropDuplicates(["id"])
    first = dense.cached(ids, str(tmp_path / "v"), "m", build)
    assert dense.cached(ids, str(tmp_path / "v"), "m", build).count() == first.count() == 4 and len(built) == 1
    dense.cached(ids, str(tmp_path / "v"), "other", build)
    assert len(built) == 2
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.6, 0.8])], "id string, embedding array<float>")
    assert {(r["seed_id"], r["rec_id"]): round(r["score"], 3) for r in dense.dot_best(v, v, 9).collect()}["a", "b"] == 0.6


def test_streamed_append_is_idempotent(spark, tmp_path):
    rows = spark.range(10).withColumnRenamed("id", "k")
    for _ in range(2):
        rows.write.mode("append").parquet(str(tmp_path / "in"))
        append_new(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), "k", str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("head, most", [(0.0, 1024), (0.3, 3), (2.0, 1024)])
def test_matrices_and_postings_agree_with_plain_products(monkeypatch, head, most):
    monkeypatch.setattr(blocks, "HEAD", head)
    monkeypatch.setattr(blocks, "MOST_HEAD", most)
    monkeypatch.setattr(blocks, "PRODUCTS", 50)
    r = np.random.default_rng(3)

    def made(n, first):
        full = np.where(r.random((n, 30)) < r.random(30), r.random((n, 30)), 0.0)
        full[1] = 0.0
        rows = [np.flatnonzero(x) for x in full]
        at = np.concatenate(rows)
        return full, (np.array([len(x) for x in rows]), np.concatenate([x[i] for x, i in zip(full, rows, strict=True)]), [f"t{first + i}" for i in range(30)], at)

    seeds, own = made(17, 0)
    items_, other = made(23, 5)  # some terms are known on one side only
    expected = items_[:, :25] @ seeds[:, 5:].T
    assert np.allclose(blocks.Seeds(*own).dot(*other), expected, atol=1e-12)
    sets = (items_[:, :25] > 0).astype(float) @ (seeds[:, 5:] > 0).T
    union = (items_ > 0).sum(1)[:, None] + (seeds > 0).sum(1) - sets
    ones = lambda x: (x[0], np.ones(len(x[1])), *x[2:])
    assert np.allclose(blocks.Seeds(*ones(own)).jaccard(*ones(other)), sets / np.maximum(union, 1), atol=1e-12)


def test_a_task_returns_the_best_of_all_its_items_and_reads_them_once(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 7)
    monkeypatch.setattr(blocks, "SLICE", 50)
    written = []
    monkeypatch.setattr(blocks, "stored", lambda df, name: (written.append(name), stored(df.coalesce(1), name))[1])
    df = spark.range(3000).selectExpr("lpad(cast(id as string), 4, '0') as id", "array('x', concat('y', id % 10)) as a_t", "array(1.0D, 1.0D) as a_w")
    own = df.filter("id < '0020'")
    found = blocks.best_of(df, own, {"a": "dot"}, 4).collect()
    expected = {(s, x) for s in range(20) for x in [i for i in range(s % 10, 60, 10) if i != s][:4]}  # ties go to smaller ids
    assert {(int(x["seed_id"]), int(x["rec_id"])) for x in found} == expected and len(found) == 80  # not four of each slice
    assert written == ["chunks", "seeds"]


def test_norms_are_not_summed_for_each_element(spark):
    docs = items(spark, [{"id": "a", "description": "red red blue"}, {"id": "b", "description": "red blue"}])
    plan = sparse.tfidf_vectors(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"transform\([^\n]*aggregate\(", plan)


def test_document_frequencies_hold_no_pairs_of_item_and_term(spark):
    rows = [{"id": "a", "title_romaji": "red blue", "description": "red red"}, {"id": "b", "description": "red"}, {"id": "c", "description": "green"}]
    df = lambda frame: {r["term"]: r["df"] for r in frame.collect()}
    plain = sparse.bm25_idf(items(spark, rows))
    plan = plain._jdf.queryExecution().optimizedPlan().toString()
    keys = re.findall(r"Aggregate \[([^\]]*)\]", plan)
    assert keys and not any("id#" in k for k in keys)
    assert df(plain) == {"red": 2, "blue": 1, "green": 1}
    assert df(sparse.bm25_idf(items(spark, [*rows, {"id": "a", "description": "red green"}]))) == {"red": 2, "blue": 1, "green": 2}
