"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from shelfmark.plans import queries, registry
from shelfmark.plans.sql import JUDGED, VSEED

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def rows_of(frame, columns):
    return sorted(map(tuple, frame[columns].astype(str).itertuples(index=False)))


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_matches_sql(name, spark, duck):
    got, expected = registry.QUERIES[name](spark, SF_DIR).toPandas(), duck.execute(registry.SQL[name]).df()
    columns = sorted(expected.columns)
    assert sorted(got.columns) == columns
    assert rows_of(got, columns) == rows_of(expected, columns)


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.SQL)


@pytest.mark.parametrize("name", ["bm25f_topk", "tfidf_topk", "dense_topk", "hybrid_topk"])
def test_ranker_properties(name, spark):
    rows = registry.QUERIES[name](spark, SF_DIR).toPandas()
    assert (rows.seed_id.astype(str) != rows.rec_id.astype(str)).all()
    assert not rows.duplicated(["seed_id", "rec_id"]).any()
    for _, g in rows.sort_values("rank").groupby("seed_id"):
        assert g["rank"].tolist() == list(range(1, len(g) + 1))
        assert g.score.is_monotonic_decreasing


def test_judged_lists_come_from_the_first_of_each_label(spark, tmp_path):
    rows = [(i, i % 3, [1.0]) for i in range(200)] + [(20, 2, [1.0])] * 30 + [(7, 1, [1.0])] * 20 + [(180, 0, [1.0]), (3, None, [1.0])]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    v = queries.vectors(spark, str(tmp_path))
    assert queries.first_of_label(v.filter("label IS NOT NULL"), 15).count() <= 3 * 16 + 2 * 14  # not all items of a label
    got = sorted((x["seed_id"], x["pos"], x["rec_id"], x["label"]) for x in queries.judged_lists(spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    ranked = JUDGED.replace("SELECT *", "SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY label DESC, rec_id) AS pos", 1)
    expected = sorted(con.execute(f"WITH {VSEED}, {ranked} SELECT seed_id, pos, rec_id, label FROM judged").fetchall())
    assert got == expected and len(got) > 100
