"""For each query the SQL (DuckDB) that computes the same rows."""

from __future__ import annotations

from shelfmark.operators import quality as Q
from shelfmark.operators import setsim, sparse
from shelfmark.operators.annotate import BACKUP
from shelfmark.operators.hybrid import WEIGHTS
from shelfmark.plans import dialect as D
from shelfmark.plans.catalog import ITEM
from shelfmark.plans.queries import EVERY, K, PROFILED

SQL: dict[str, str] = {}
SEED = f"seed AS (SELECT * FROM item WHERE CAST(id AS BIGINT) % {EVERY} = 0)"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def ranked(scores: str, k: int = K) -> str:
    return f"""SELECT seed_id, rank, rec_id, score FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY seed_id ORDER BY score DESC, rec_id) AS INTEGER) AS rank
  FROM (SELECT seed_id, rec_id, round(score, 6) AS score FROM ({scores}) WHERE seed_id <> rec_id)) WHERE rank <= {k}"""


# Text

for _name, _c in (("clean_text", D.clean("html")), ("strip_markup", D.markup("html"))):
    SQL[_name] = f"SELECT page_id, length(c) AS n_chars, md5(c) AS digest FROM (SELECT page_id, {_c} AS c FROM pages)"
SQL["entity_detect"] = rf"SELECT page_id, regexp_matches(html, '&(?:[a-zA-Z]+|#\d+);') AS has_entity, {D.blank('html')} AS blank FROM pages"
SQL["tokenize_counts"] = f"""WITH t AS (SELECT doc_id, unnest({D.tokens(D.clean('text'))}) AS term FROM documents),
c AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL)
SELECT term, CAST(sum(tf) AS BIGINT) AS total, count(*) AS df, max(tf) AS max_tf FROM c GROUP BY term"""
SQL["split_list_roundtrip"] = with_(ITEM) + f"""SELECT id, array_to_string({D.items('genres')}, ' ') AS genres_text, array_to_string({D.items('genres')}, '|') AS genres_list,
  array_to_string({D.items('tags')}, '|') AS tags_list, array_to_string(list_slice({D.items('tags')}, 1, 3), ', ') AS top_tags, len({D.item_set('genres')}) AS n_genres FROM item"""
SQL["normalize_title"] = with_(ITEM) + f"SELECT id, {D.normal_title('title_romaji')} AS title, {D.normal_title('title_native')} AS native FROM item"
SQL["franchise_key"] = with_(ITEM, f"f AS (SELECT id, {D.PREFERRED} AS preferred, {D.franchise(D.PREFERRED)} AS key, {D.franchise('title_romaji')} AS romaji_key FROM item)") + f"SELECT *, {D.useful('key')} AS useful FROM f"
SQL["truncate_text"] = f"SELECT doc_id, {D.shorten('text', 450)} AS shortened, CASE WHEN length(text) > 28 THEN substring(text, 1, 25) || '...' ELSE text END AS cell FROM documents"
SQL["lenient_number"] = with_(ITEM) + f"SELECT id, {D.number('episodes')} AS episodes, {D.number('\"averageScore\"')} AS score, {D.number('status')} AS status FROM item"
SQL["partial_date"] = """SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN '' WHEN o_orderkey % 5 <> 0 AND o_orderkey % 3 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d')
  WHEN o_orderkey % 5 <> 0 THEN strftime(o_orderdate, '%Y-%m') ELSE strftime(o_orderdate, '%Y') END AS date FROM orders"""

# Quality


def counted(section: str, checks: dict[str, str], source: str = "item", extra: str = "") -> str:
    parts = [f"SELECT '{section}' AS section, '{name}' AS \"check\", CAST(count_if(coalesce({c}, false)) AS BIGINT) AS count, count(*) AS n FROM {source}" for name, c in checks.items()]
    return f"SELECT section, \"check\", count, round(count * 100.0 / n, 6) AS pct{extra} FROM ({' UNION ALL '.join(parts)})"


def _n(c: str) -> str:
    return "(" + D.number(f'"{c}"') + ")"


def _unknown(c: str, known) -> str:
    return f"(NOT {D.blank(c)} AND {c} NOT IN ({D.words(known)}))"


SQL["quality_completeness"] = with_(ITEM) + counted("completeness", {c: D.blank(f'"{c}"') for c in PROFILED}, extra=f", \"check\" IN ({D.words(Q.EXPECTED_MISSING)}) AS expected")
SQL["quality_validity"] = with_(ITEM) + counted("validity", {
    "averageScore out of range": f"({_n('averageScore')} < 0 OR {_n('averageScore')} > 100)", "meanScore out of range": f"({_n('meanScore')} < 0 OR {_n('meanScore')} > 100)",
    "episodes negative": f"{_n('episodes')} < 0", "duration not positive": f"{_n('duration')} <= 0", "seasonYear out of range": f"({_n('seasonYear')} < 1940 OR {_n('seasonYear')} > 2027)",
    "format unknown": _unknown("format", Q.FORMATS), "status unknown": _unknown("status", Q.STATUSES), "season unknown": _unknown("season", Q.SEASONS),
})
SQL["quality_consistency"] = with_(ITEM) + counted("consistency", {
    "finished without end date": f"(status = 'FINISHED' AND {D.blank('end_date')})", "finished with no episodes": f"(status = 'FINISHED' AND {_n('episodes')} = 0)",
    "season set for a movie": f"(NOT {D.blank('season')} AND format = 'MOVIE')", "one score without the other": f"({D.blank('\"averageScore\"')} <> {D.blank('\"meanScore\"')})",
})
SQL["quality_outliers"] = with_(ITEM) + counted("outliers", {"episodes over 1500": f"{_n('episodes')} > 1500", "duration over 180": f"{_n('duration')} > 180", "popularity zero": "popularity = 0", "favourites zero": f"{_n('favourites')} = 0"})
SQL["quality_text"] = with_(ITEM) + counted("text", {
    "description blank": f"{D.strip('description')} = ''", "description short": f"({D.strip('description')} <> '' AND length({D.strip('description')}) < 20)",
    "description with entities": r"regexp_matches(description, '&(?:[a-zA-Z]+|#\d+);')", "description placeholder": f"lower({D.strip('description')}) IN ('no description', 'n/a', 'none', 'tba', 'to be announced')", "cover blank": D.blank("cover_image"),
})
SQL["quality_uniqueness"] = with_(ITEM) + f"""SELECT 'uniqueness' AS section, "check", count, round(count * 100.0 / n, 6) AS pct FROM (
  SELECT 'duplicate ids' AS "check", count(*) - count(DISTINCT id) AS count, count(*) AS n FROM item
  UNION ALL SELECT 'near-duplicate titles', count(*) - count(DISTINCT {D.normal_title('title_romaji')}), count(*) FROM item)"""

CORE = f"core AS (SELECT * FROM item WHERE NOT ({D.blank('genres')} AND {D.blank('description')}))"
_list = lambda c: f"array_to_string({D.items(c)}, '|')"
TIDY = f"""tidy AS (SELECT * REPLACE ({D.strip('title_romaji')} AS title_romaji, {D.strip('title_english')} AS title_english, {D.strip('title_native')} AS title_native,
  {D.strip(D.unescape('description'))} AS description, {_list('genres')} AS genres, {_list('tags')} AS tags, {_list('studios')} AS studios) FROM core)"""
ONCE = f"""ids AS (SELECT * FROM tidy QUALIFY row_number() OVER (PARTITION BY id ORDER BY popularity DESC, id, title_romaji) = 1),
titles AS (SELECT * FROM ids QUALIFY row_number() OVER (PARTITION BY {D.normal_title('title_romaji')} ORDER BY popularity DESC, id, title_romaji) = 1)"""


def _snapshot(source: str, stage: str) -> str:
    return f"SELECT '{stage}' AS stage, count(*) AS n_rows, " + ", ".join(f"round(count_if(NOT {D.blank(f'\"{c}\"')}) * 100.0 / count(*), 6) AS \"{c}_pct\"" for c in Q.SNAPSHOT) + f" FROM {source}"


SQL["snapshot_before_after"] = with_(ITEM, CORE, TIDY, ONCE) + _snapshot("item", "before") + " UNION ALL " + _snapshot("titles", "after")
SQL["cleaned_items"] = with_(ITEM, CORE, TIDY, ONCE) + f"""SELECT id, title_romaji, title_native, NOT {D.blank('"averageScore"')} AS has_score, genres, tags, coalesce({_n('episodes')} > 1500, false) AS episodes_outlier,
  md5(description) AS description_digest FROM titles"""
_cells = lambda cs, new: " + ".join(f"count_if(coalesce({c}, '') <> {new(c)})" for c in cs)
SQL["cleaning_changes"] = with_(ITEM, CORE, TIDY, ONCE) + f"""SELECT step, CAST(changed AS BIGINT) AS changed FROM (
  SELECT 'drop_empty_core' AS step, (SELECT count(*) FROM item) - (SELECT count(*) FROM core) AS changed
  UNION ALL SELECT 'decode_entities', (SELECT {_cells(['description'], D.unescape)} FROM core)
  UNION ALL SELECT 'trim_text', (SELECT {_cells(['title_romaji', 'title_english', 'title_native'], D.strip)} + count_if({D.unescape('description')} <> {D.strip(D.unescape('description'))}) FROM core)
  UNION ALL SELECT 'standardize_lists', (SELECT {_cells(['genres', 'tags', 'studios'], _list)} FROM core)
  UNION ALL SELECT 'add_has_score', (SELECT count_if(NOT {D.blank('"averageScore"')}) FROM tidy)
  UNION ALL SELECT 'remove_duplicate_ids', (SELECT count(*) FROM tidy) - (SELECT count(*) FROM ids)
  UNION ALL SELECT 'remove_near_duplicate_titles', (SELECT count(*) FROM ids) - (SELECT count(*) FROM titles)
  UNION ALL SELECT 'flag_outliers', (SELECT count_if(coalesce({_n('episodes')} > 1500, false)) FROM titles))"""
SQL["drop_empty_core"] = with_(ITEM, CORE) + "SELECT id, genres FROM core"
SQL["dedup_by_key_max_pop"] = with_(ITEM) + "SELECT studios, id, popularity FROM item QUALIFY row_number() OVER (PARTITION BY studios ORDER BY popularity DESC, id) = 1"
SQL["near_dup_titles"] = with_(ITEM) + f"SELECT {D.normal_title('title_english')} AS title, id, popularity FROM item QUALIFY row_number() OVER (PARTITION BY {D.normal_title('title_english')} ORDER BY popularity DESC, id) = 1"
SQL["flag_outlier"] = with_(ITEM) + f"SELECT id, coalesce({_n('episodes')} > 1500, false) AS episodes_outlier FROM item"
SQL["title_search"] = with_(ITEM) + """SELECT id, title_romaji AS title, title_english, pos FROM (SELECT *, row_number() OVER (ORDER BY popularity DESC, id) AS pos FROM item)
WHERE contains(lower(title_romaji || ' ' || title_english), 'blue bo') ORDER BY pos LIMIT 10"""

# Sparse


def field(name: str) -> str:
    if name == "title":
        return D.clean("(title_romaji || ' ' || title_english)")
    return D.clean(f"array_to_string({D.items(name)}, ' ')") if name in ("genres", "tags", "studios") else D.clean(name)


FIELD = "fields AS (SELECT id, popularity, " + ", ".join(f"{field(f)} AS c_{f}" for f in sparse.FIELDS) + " FROM item)"
POST = "post AS (SELECT id, field, term, count(*) AS tf FROM (" + " UNION ALL ".join(f"SELECT id, '{f}' AS field, unnest({D.tokens(f'c_{f}')}) AS term FROM fields" for f in sparse.FIELDS) + ") GROUP BY ALL)"
IDF = "idf AS (SELECT term, df, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM (SELECT term, count(DISTINCT id) AS df FROM post GROUP BY term), (SELECT count(*) AS n FROM item))"
SQL["doc_frequency_idf"] = with_(ITEM, FIELD, POST, IDF) + "SELECT term, df, round(idf, 6) AS idf FROM idf"


def _query_field(i: int, name: str, repeats: int) -> str:
    t = D.tokens(f"c_{name}")
    t = f"list_slice({t}, 1, {sparse.QUERY_DESCRIPTION_TOKENS})" if name == "description" else t
    return f"SELECT seed_id, term, {repeats} AS repeats, CAST({i} AS BIGINT) * 1000000000 + pos AS place FROM (SELECT id AS seed_id, unnest({t}) AS term, unnest(range(len({t}))) AS pos FROM fields SEMI JOIN seed USING (id))"


QUERY = "query AS (SELECT * FROM (SELECT seed_id, term, CAST(sum(repeats) AS BIGINT) AS weight, min(place) AS first_pos FROM (" + " UNION ALL ".join(_query_field(i, n, r) for i, (n, r) in enumerate(sparse.QUERY_FIELDS.items())) + f") GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY seed_id ORDER BY weight DESC, first_pos) <= {sparse.QUERY_TERMS})"
SQL["bm25f_query_terms"] = with_(ITEM, SEED, FIELD, QUERY) + "SELECT seed_id, term, weight, first_pos FROM query"
_case = lambda at: "CASE field " + " ".join(f"WHEN '{f}' THEN CAST({v[at]} AS DOUBLE)" for f, v in sparse.FIELDS.items()) + " END"
BM25F = f"""flen AS (SELECT id, field, sum(tf) AS len FROM post GROUP BY ALL),
favg AS (SELECT field, CAST(sum(len) AS DOUBLE) / (SELECT count(*) FROM item) AS avg_len FROM flen GROUP BY field),
wtf AS (SELECT seed_id, id, term, sum({_case(0)} * tf / (1 - {_case(1)} + {_case(1)} * len / avg_len)) AS wtf FROM query JOIN post USING (term) JOIN flen USING (id, field) JOIN favg USING (field) GROUP BY ALL),
bm25f AS (SELECT seed_id, id AS rec_id, sum(idf * {sparse.K1 + 1} * wtf / ({sparse.K1} + wtf + 1e-9)) AS score FROM wtf JOIN idf USING (term) GROUP BY ALL)"""
SQL["bm25f_topk"] = with_(ITEM, SEED, FIELD, POST, IDF, QUERY, BM25F) + ranked("SELECT * FROM bm25f WHERE score > 0")
CONTENT = " || ' ' || ".join(f"array_to_string([c_{f} FOR z IN range({n})], ' ')" for f, n in sparse.TEXT_REPEATS.items())


def tfidf(text: str, name: str = "tfidf") -> str:
    return f"""words AS (SELECT id, {D.word_tokens(text)} AS w FROM fields),
counts AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(w) AS term FROM words UNION ALL SELECT id, unnest([w[j] || ' ' || w[j + 1] FOR j IN range(1, len(w))]) FROM words) GROUP BY ALL),
vocab AS (SELECT term, df FROM (SELECT term, count(*) AS df, sum(tf) AS total FROM counts GROUP BY term) WHERE df >= {sparse.MIN_DF} ORDER BY total DESC, term LIMIT {sparse.MAX_FEATURES}),
raw AS (SELECT id, term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM item)) / (1.0::DOUBLE + df)) + 1) AS w FROM counts JOIN vocab USING (term)),
unit AS (SELECT id, term, w / norm AS w FROM raw JOIN (SELECT id, sqrt(sum(w * w)) AS norm FROM raw GROUP BY id) USING (id)),
{name} AS (SELECT a.id AS seed_id, b.id AS rec_id, sum(a.w * b.w) AS score FROM unit a JOIN unit b USING (term) WHERE a.id IN (SELECT id FROM seed) GROUP BY ALL)"""


SQL["tfidf_topk"] = with_(ITEM, SEED, FIELD, tfidf("(c_title || ' ' || c_description)")) + ranked("SELECT * FROM tfidf")
SQL["tfidf_bigram_topk"] = with_(ITEM, SEED, FIELD, tfidf(CONTENT)) + ranked("SELECT * FROM tfidf")

# Dense, sets, hybrid

DOT = "CAST(coalesce(list_sum([CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE) FOR p IN list_zip(s.embedding, v.embedding)]), 0) AS DOUBLE)"
VSEED = f"vseed AS (SELECT vec_id, embedding, label FROM embeddings WHERE vec_id % {EVERY} = 0)"
DENSE = f"dense AS (SELECT s.vec_id AS seed_id, v.vec_id AS rec_id, {DOT} AS score FROM vseed s, embeddings v)"


def dense_ranked(k: int) -> str:
    return "SELECT seed_id, rank, rec_id, score FROM (" + ranked("SELECT * FROM dense", k) + ")"


SQL["dense_topk"] = with_(VSEED, DENSE) + dense_ranked(K)


def jaccard(column: str, name: str) -> str:
    return f"""{name}_x AS (SELECT id, len(s) AS n, unnest(s) AS x FROM (SELECT id, {D.item_set(column)} AS s FROM item)),
{name} AS (SELECT a.id AS seed_id, b.id AS rec_id, count(*) / CAST(any_value(a.n) + any_value(b.n) - count(*) AS DOUBLE) AS score FROM {name}_x a JOIN {name}_x b USING (x) WHERE a.id IN (SELECT id FROM seed) GROUP BY ALL)"""


SQL["jaccard_topk"] = with_(ITEM, SEED, jaccard("tags", "tag_overlap")) + ranked("SELECT * FROM tag_overlap")
_signals = {"bm25f": "bm25f", "tfidf": "tfidf", "embedding": "embedding", "tag_overlap": "tag_overlap", "genre_overlap": "genre_overlap"}
_scaled = lambda c: f"CASE WHEN max({c}) OVER w > min({c}) OVER w THEN ({c} - min({c}) OVER w) / (max({c}) OVER w - min({c}) OVER w) ELSE 0 END"
HYBRID = f"""embedding AS (SELECT CAST(s.vec_id AS STRING) AS seed_id, CAST(v.vec_id AS STRING) AS rec_id, {DOT} AS score FROM embeddings s, embeddings v
  WHERE CAST(s.vec_id AS STRING) IN (SELECT id FROM seed) AND CAST(v.vec_id AS STRING) IN (SELECT id FROM item)),
pairs AS (SELECT s.id AS seed_id, i.id AS rec_id, {', '.join(f'coalesce({t}.score, 0) AS {c}' for c, t in _signals.items())} FROM seed s CROSS JOIN item i
  {' '.join(f'LEFT JOIN {t} ON {t}.seed_id = s.id AND {t}.rec_id = i.id' for t in _signals.values())}),
scaled AS (SELECT seed_id, rec_id, {', '.join(f'{_scaled(c)} AS {c}' for c in ('bm25f', 'tfidf', 'embedding'))}, tag_overlap, genre_overlap FROM pairs WINDOW w AS (PARTITION BY seed_id))"""
SQL["hybrid_topk"] = with_(ITEM, SEED, FIELD, POST, IDF, QUERY, BM25F, tfidf(CONTENT), jaccard("tags", "tag_overlap"), jaccard("genres", "genre_overlap"), HYBRID) + ranked("SELECT seed_id, rec_id, " + " + ".join(f"CAST({w} AS DOUBLE) * {c}" for c, w in WEIGHTS.items()) + " AS score FROM scaled")
SQL["ui_relative_score"] = with_(VSEED, DENSE) + f"""SELECT seed_id, rank, rec_id, score, CAST(CASE WHEN best > 0 THEN least(100.0, round(100 * score / best)) ELSE 0 END AS INTEGER) AS relative_pct
FROM (SELECT *, max(score) OVER (PARTITION BY seed_id) AS best FROM ({dense_ranked(50)}) WHERE score >= 0.12) WHERE rank <= 15"""

# Candidates

PREPARED = f"""prep AS (SELECT id, popularity, {D.franchise(D.PREFERRED)} AS title_key, {D.item_set('genres')} AS g, {D.item_set('tags')} AS t, row_number() OVER (ORDER BY popularity DESC, id) AS pos
  FROM item WHERE NOT {D.blank('genres')} AND NOT {D.blank('description')} AND NOT {D.blank('title_romaji')}),
cseed AS (SELECT * FROM prep WHERE pos <= {setsim.SEEDS}), pool AS (SELECT * FROM prep WHERE pos <= {setsim.POOL})"""


def overlap(name: str, g: int, t: int, weight: int, limit: int) -> str:
    return f"""{name} AS (SELECT seed_id, CAST(rank AS INTEGER) AS rank, rec_id FROM (SELECT s.id AS seed_id, p.id AS rec_id,
  row_number() OVER (PARTITION BY s.id ORDER BY {weight} * len(list_intersect(s.g, p.g)) + len(list_intersect(s.t, p.t)) DESC, p.popularity DESC, p.pos) AS rank
  FROM cseed s JOIN pool p ON s.id <> p.id AND s.title_key <> p.title_key WHERE len(list_intersect(s.g, p.g)) >= {g} AND len(list_intersect(s.t, p.t)) >= {t}) WHERE rank <= {limit})"""


def nearest(name: str, source: str, on: str, limit: int) -> str:
    return f"""{name} AS (SELECT seed_id, CAST(rank AS INTEGER) AS rank, rec_id FROM (SELECT s.id AS seed_id, p.id AS rec_id, row_number() OVER (PARTITION BY s.id ORDER BY p.pos) AS rank
  FROM cseed s JOIN {source} p ON s.id <> p.id AND {on}) WHERE rank <= {limit})"""


SOURCES = [overlap("thematic", 2, 4, 12, 28), nearest("franchise", "prep", f"s.title_key = p.title_key AND {D.useful('s.title_key')}", 5), overlap("partial", 1, 1, 8, 12), nearest("popular", "pool", "s.title_key <> p.title_key", 12)]
for _name, _cte in zip(("thematic", "franchise", "partial", "popular"), SOURCES, strict=True):
    SQL[f"candidates_{_name}"] = with_(ITEM, PREPARED, _cte) + f"SELECT * FROM {_name}"
_union = " UNION ALL ".join(f"SELECT seed_id, rec_id, {i} AS source_order, rank AS source_rank, '{label}' AS candidate_source FROM {t}" for i, (label, t) in enumerate(zip(setsim.LIMITS, ("thematic", "franchise", "partial", "popular"), strict=True)))
UNION = f"""offered AS (SELECT * FROM ({_union}) QUALIFY row_number() OVER (PARTITION BY seed_id, rec_id ORDER BY source_order, source_rank) = 1),
chosen AS (SELECT seed_id, CAST(rank AS INTEGER) AS rank, rec_id, candidate_source FROM (SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY source_order, source_rank, rec_id) AS rank FROM offered) WHERE rank <= {setsim.KEEP})"""
SQL["candidates_union"] = with_(ITEM, PREPARED, *SOURCES, UNION) + "SELECT * FROM chosen"
SQL["candidate_source_counts"] = with_(ITEM, PREPARED, *SOURCES, UNION) + "SELECT candidate_source, count(*) AS n, count(DISTINCT seed_id) AS n_seeds FROM chosen GROUP BY 1"

_side = lambda name: f"SELECT id AS {name}_id, {D.PREFERRED} AS {name}_title, genres AS {name}_genres, tags AS {name}_tags, {D.shorten('description', 450)} AS {name}_description FROM item"
PAIRS = f"""pairs AS (SELECT rank, s.*, c.*, candidate_source FROM chosen JOIN ({_side('seed')}) s USING (seed_id) JOIN ({_side('candidate')}) c ON candidate_id = rec_id)"""
SQL["candidate_rows"] = with_(ITEM, PREPARED, *SOURCES, UNION, PAIRS) + "SELECT * FROM pairs"
LISTED = f"""picked AS (SELECT seed_id, rec_id, rank, CAST(greatest(0, least(10, (rank * 7) % 13 - 1)) AS INTEGER) AS score_10, 'why ' || rank AS reason FROM chosen WHERE rank <= 12 AND rank % 3 <> 0),
backup AS (SELECT seed_id, rec_id, n + row_number() OVER (PARTITION BY seed_id ORDER BY rank) AS rank, 4 AS score_10, '{BACKUP}' AS reason
  FROM (SELECT * FROM chosen ANTI JOIN picked USING (seed_id, rec_id)) JOIN (SELECT seed_id, count(*) AS n FROM picked GROUP BY 1) USING (seed_id)),
listed AS (SELECT *, CASE WHEN score_10 >= 7 THEN 2 WHEN score_10 >= 4 THEN 1 ELSE 0 END AS label FROM (SELECT * FROM picked UNION ALL SELECT * FROM backup WHERE rank <= 15)),
reranked AS (SELECT * EXCLUDE (rank), CAST(row_number() OVER (PARTITION BY seed_id ORDER BY score_10 DESC, label DESC, rank, rec_id) AS INTEGER) AS rank FROM listed QUALIFY rank <= 15),
judgedrows AS (SELECT l.seed_id, seed_title, l.rank, l.rec_id AS recommended_id, candidate_title AS recommended_title, l.label AS similarity_label, l.score_10 AS similarity_score_10, l.reason,
  seed_genres, candidate_genres AS recommended_genres, seed_tags, candidate_tags AS recommended_tags FROM reranked l JOIN pairs p ON p.seed_id = l.seed_id AND p.candidate_id = l.rec_id)"""
SQL["judged_rows"] = with_(ITEM, PREPARED, *SOURCES, UNION, PAIRS, LISTED) + "SELECT * FROM judgedrows"
SQL["audit_records"] = with_(ITEM, PREPARED, *SOURCES, UNION, PAIRS, LISTED) + """SELECT seed_id, seed_title, '[' || string_agg('{"candidate_id":"' || recommended_id || '","rank":' || rank || ',"similarity_label":' || similarity_label
  || ',"similarity_score_10":' || similarity_score_10 || ',"reason":"' || reason || '"}', ',' ORDER BY rank) || ']' AS recommendations FROM judgedrows GROUP BY ALL"""

# Evaluation

JUDGED = """judged AS (SELECT * FROM (SELECT s.vec_id AS seed_id, v.vec_id AS rec_id, CASE WHEN s.label = v.label THEN 2 ELSE 1 END AS label FROM vseed s JOIN embeddings v ON v.label BETWEEN s.label - 1 AND s.label + 1 AND s.vec_id <> v.vec_id)
  QUALIFY row_number() OVER (PARTITION BY seed_id ORDER BY label DESC, rec_id) <= 15)"""
PRED = f"pred AS ({dense_ranked(15)})"
IDEAL = "ideal AS (SELECT seed_id, rec_id, label, row_number() OVER (PARTITION BY seed_id ORDER BY label DESC, rec_id) AS rank FROM judged)"
KS = "ks AS (SELECT CAST(unnest([3, 5, 10, 15]) AS INTEGER) AS k)"


def precision(pred: str, threshold: int) -> str:
    return f"""SELECT k, round(avg(hits / CAST(k AS DOUBLE)), 6) AS precision, round(avg(hits / CAST(n_relevant AS DOUBLE)), 6) AS recall, count(*) AS seeds FROM (
  SELECT r.seed_id, k, n_relevant, count(p.rec_id) FILTER (p.rank <= k) AS hits
  FROM (SELECT seed_id, count(*) AS n_relevant FROM judged WHERE label >= {threshold} GROUP BY 1) r CROSS JOIN ks
  LEFT JOIN (SELECT p.* FROM {pred} p JOIN judged j USING (seed_id, rec_id) WHERE j.label >= {threshold}) p ON p.seed_id = r.seed_id GROUP BY ALL) GROUP BY k"""


def ndcg(pred: str) -> str:
    return f"""SELECT k, round(avg(dcg / best), 6) AS ndcg, count(*) AS seeds FROM (
  SELECT i.seed_id, k, sum((pow(2, label) - 1) / log2(rank + 1)) AS best FROM ideal i, ks WHERE rank <= k GROUP BY ALL) JOIN (
  SELECT s.vec_id AS seed_id, k, coalesce(sum((pow(2, coalesce(j.label, 0)) - 1) / log2(p.rank + 1)), 0) AS dcg FROM vseed s CROSS JOIN ks
  LEFT JOIN {pred} p ON p.seed_id = s.vec_id AND p.rank <= k LEFT JOIN judged j ON j.seed_id = p.seed_id AND j.rec_id = p.rec_id GROUP BY ALL) USING (seed_id, k) WHERE best > 0 GROUP BY k"""


_base = with_(VSEED, DENSE, JUDGED, PRED, IDEAL, KS)
SQL["precision_recall_at_k"] = _base + precision("pred", 2)
SQL["precision_recall_lenient"] = _base + precision("pred", 1)
SQL["ndcg_at_k"] = _base + ndcg("pred")
SQL["metric_grid"] = _base + " UNION ALL ".join(f"SELECT '{m}' AS model, k, ndcg, precision, recall FROM ({ndcg(p)}) JOIN ({precision(p, 2)}) USING (k)" for m, p in (("dense", "pred"), ("ideal", "ideal")))
_label = lambda s: f"CASE WHEN {s} >= 7 THEN 2 WHEN {s} >= 4 THEN 1 ELSE 0 END"
LISTS = f"ten AS (SELECT seed_id, rank, rec_id, CAST(greatest(0, least(10, floor(score * 12))) AS INTEGER) AS score_10 FROM pred), lists AS (SELECT *, {_label('score_10')} AS label FROM ten)"
_lists = with_(VSEED, DENSE, PRED, LISTS)
SQL["label_distribution"] = _lists + "SELECT label, count(*) AS n FROM lists GROUP BY 1"
SQL["score_describe"] = _lists + """SELECT count(score_10) AS n, round(avg(score_10), 2) AS mean, round(stddev_samp(score_10), 2) AS std, min(score_10) AS least, CAST(quantile_cont(score_10, 0.25) AS DOUBLE) AS q1,
  CAST(quantile_cont(score_10, 0.5) AS DOUBLE) AS median, CAST(quantile_cont(score_10, 0.75) AS DOUBLE) AS q3, max(score_10) AS most FROM lists"""
SQL["mean_score_by_rank"] = _lists + "SELECT rank, round(avg(score_10), 6) AS mean_score, round(avg(label), 6) AS mean_label FROM lists GROUP BY 1"
_cell = lambda r: ", ".join(f"coalesce(max({e}) FILTER (rank = {r}), '') AS rec_{r}_{c}" for c, e in (("title", "'item ' || rec_id"), ("label", "CAST(label AS STRING)"), ("score_10", "CAST(score_10 AS STRING)"), ("reason", "'near'")))
SQL["rank_pivot_wide"] = _lists + f"SELECT seed_id, 'seed ' || seed_id AS seed_title, {_cell(1)}, {_cell(2)}, {_cell(3)} FROM lists WHERE rank <= 3 GROUP BY seed_id"

# Sets of rows, lists, nested data

SQL["resume_anti_join"] = with_(ITEM, PREPARED, *SOURCES, UNION) + "SELECT seed_id, rank, rec_id FROM chosen WHERE CAST(seed_id AS BIGINT) % 3 <> 0"
SQL["semi_restrict"] = with_(VSEED, DENSE, JUDGED) + f"SELECT p.seed_id, p.rank, p.rec_id FROM ({dense_ranked(50)}) p SEMI JOIN judged j USING (seed_id, rec_id)"
SQL["rank_fill_to_k"] = with_(VSEED, DENSE, JUDGED.replace("judged AS (SELECT *", "judged AS (SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY label DESC, rec_id) AS pos"), PRED, LISTS) + """, few AS (SELECT * FROM lists WHERE label > 0 AND rank <= 5)
SELECT seed_id, CAST(rank AS INTEGER) AS rank, rec_id, label, score_10 FROM (
  SELECT seed_id, rank, rec_id, label, score_10 FROM few
  UNION ALL SELECT j.seed_id, coalesce(h.have, 0) + row_number() OVER (PARTITION BY j.seed_id ORDER BY pos, rec_id), rec_id, 1, 4 FROM judged j ANTI JOIN few USING (seed_id, rec_id)
  LEFT JOIN (SELECT seed_id, max(rank) AS have FROM few GROUP BY 1) h ON h.seed_id = j.seed_id) WHERE rank <= 8"""
SQL["rerank_labels"] = with_(VSEED, DENSE, PRED, LISTS) + f""", m AS (SELECT seed_id, rank, rec_id, CAST(greatest(0, least(10, (rec_id * 7 + rank) % 15 - 2)) AS INTEGER) AS score_10 FROM lists)
SELECT seed_id, CAST(row_number() OVER (PARTITION BY seed_id ORDER BY score_10 DESC, {_label('score_10')} DESC, rank, rec_id) AS INTEGER) AS rank, rec_id, {_label('score_10')} AS label, score_10 FROM m"""
SQL["json_extract"] = "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"
SQL["json_flatten"] = with_(ITEM) + f"""SELECT id, title_romaji, title_english, format,
  CASE WHEN n % 13 <> 0 AND n % 29 <> 0 THEN printf('%04d-%02d-%02d', n % 30 + 1990, n % 13, n % 29) WHEN n % 13 <> 0 THEN printf('%04d-%02d', n % 30 + 1990, n % 13) ELSE CAST(n % 30 + 1990 AS STRING) END AS start_date, '' AS end_date,
  CAST(popularity AS STRING) AS popularity, {_list('genres')} AS genres, {_list('tags')} AS tags, studios, {D.markup("('<b>x</b>&amp;' || description)")} AS description FROM (SELECT *, CAST(id AS BIGINT) AS n FROM item)"""
SQL["popularity_cursor"] = with_(ITEM) + "SELECT min(popularity) + 1 AS next_ceiling FROM item WHERE popularity > 0"
SQL["streamed_append"] = "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS ids FROM events GROUP BY 1"
