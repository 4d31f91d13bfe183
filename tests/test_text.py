import html

import duckdb
import pytest
from pyspark.sql import functions as F

from shelfmark.functions import text as X
from shelfmark.plans import registry


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first()["y"]


CASES = [
    (lambda: X.is_blank("x"), "", True), (lambda: X.is_blank("x"), " ", True), (lambda: X.is_blank("x"), "\t", True), (lambda: X.is_blank("x"), " ", True), (lambda: X.is_blank("x"), None, True), (lambda: X.is_blank("x"), "a", False),
    (lambda: X.to_num("x"), "12", 12.0), (lambda: X.to_num("x"), " 12 ", 12.0), (lambda: X.to_num("x"), "1e3", 1000.0), (lambda: X.to_num("x"), "", None), (lambda: X.to_num("x"), "abc", None), (lambda: X.to_num("x"), "1d", None), (lambda: X.to_num("x"), "nan", None),
    (lambda: X.normalize_title("x"), 'Ab-Cd!  "E", f.', "abcd e f"), (lambda: X.standard_list("x"), " A ||b|", "A|b"), (lambda: X.clean_text("x"), "Foo &amp; <b>Bar</b>'s X_Y", "foo bar 's x y"),
    (lambda: X.strip_markup("x"), "a<BR/>b<i>c</i>d", "a bcd"), (lambda: X.strip_markup("x"), "&lt;b&gt;x", "x"), (lambda: X.unescape_html("x"), "&amp;lt;", "&lt;"), (lambda: X.unescape_html("x"), "no & such; &nosuch; &", "no & such; &nosuch; &"),
    (lambda: X.has_entity("x"), "&amp;", True), (lambda: X.has_entity("x"), "&#65;", True), (lambda: X.has_entity("x"), "&#x41;", False), (lambda: X.has_entity("x"), "& x;", False),
    (lambda: F.array_join(X.tokens(F.col("x")), ","), "nar-uto's x2 -z", "nar-uto's,x2,z"), (lambda: X.franchise_key(F.col("x")), "Foo Bar: Season 2 (TV)", "foo bar"),
    (lambda: F.array_join(F.array_sort(X.list_set("x")), ","), "A|a | B|", "a,b"), (lambda: X.truncate_words("x", 10), "abcdef ghijklm", "abcdef..."), (lambda: X.truncate("x", 10), "abcdefghijklm", "abcdefg..."), (lambda: X.json_object("x"), 'noise {"a":1} tail', '{"a":1}'), (lambda: X.json_object("x"), "none", None),
    (lambda: F.array_join(X.with_bigrams(F.split("x", " ")), ","), "a b c", "a,b,c,a b,b c"), (lambda: F.array_join(X.with_bigrams(F.split("x", " ")), ","), "a", "a"),
]


@pytest.mark.parametrize("column, value, expected", CASES, ids=range(len(CASES)))
def test_text(spark, column, value, expected):
    assert one(spark, column(), value) == expected


def test_unescape_agrees_with_the_standard_library(spark):
    texts = ["&copy x", "&#65;&#x42;", "&#128;", "&#0;", "&#xD800;", "&notit;", "&frac12;&hearts;", "a&lt", "&&amp;&", "&#1114112;", "&NotEqualTilde;", "x &amp;amp; y", "&#38;lt;"]
    rows = spark.createDataFrame([(t,) for t in texts], "x string").select("x", X.unescape_html("x").alias("y")).collect()
    assert {r["x"]: r["y"] for r in rows} == {t: html.unescape(t) for t in texts}


@pytest.mark.parametrize("score, label", [(10, 2), (7, 2), (6, 1), (4, 1), (3, 0), (-5, 0), (99, 2)])
def test_labels(spark, score, label):
    assert one(spark, X.label_from_score(X.clamp(F.col("x"), 0, 10)), score, "int") == label


@pytest.mark.parametrize("date, expected", [((2001, 2, 3), "2001-02-03"), ((2001, 2, None), "2001-02"), ((2001, None, 3), "2001"), ((None, 2, 3), "")])
def test_partial_date(spark, date, expected):
    row = spark.createDataFrame([date], "y int, m int, d int").select(X.partial_date(F.col("y"), F.col("m"), F.col("d")).alias("x")).first()
    assert row["x"] == expected


def test_references_without_a_semicolon_stay_if_asked(spark):
    row = spark.createDataFrame([("a &amp;&amp</h1>&lt;i&gt; &#65;&#65 &#x42;&#x42 &copy &copy; &am",)], "x string")
    plain, whole = row.select(X.strip_markup("x"), X.strip_markup("x", open_ended=False)).first()
    assert plain == "a && AA BB © © &am" and whole == "a &&amp A&#65 B&#x42 &copy © &am"
    assert row.select(X.clean_text("x", open_ended=False)).first()[0] == "a amp i a 65 b x42 copy am".replace(" i ", " ")


def test_pages_that_cut_a_reference_match_their_sql(spark, tmp_path):
    pages = spark.createDataFrame([(1, "<title>Ly &amp;&amp</title> a&quot b&copy;"), (2, "x &a")], "page_id long, html string")
    pages.coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    for name in ("clean_text", "strip_markup"):
        got = sorted((r["page_id"], r["n_chars"], r["digest"]) for r in registry.QUERIES[name](spark, str(tmp_path)).collect())
        assert got == sorted(con.execute(f"SELECT page_id, n_chars, digest FROM ({registry.SQL[name]})").fetchall())
