"""The cleaning pipeline: eight steps, each a DataFrame transform; and how many rows or cells each changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import text as X
from shelfmark.operators.topk import first_per_key

TRIMMED = ["title_romaji", "title_english", "title_native", "description"]
LISTS = ["genres", "tags", "studios"]


def drop_empty_core(df: DataFrame) -> DataFrame:
    return df.filter(~(X.is_blank("genres") & X.is_blank("description")))


def decode_entities(df: DataFrame) -> DataFrame:
    return df.withColumn("description", X.unescape_html("description"))


def trim_text(df: DataFrame) -> DataFrame:
    return df.withColumns({c: X.strip(c) for c in TRIMMED})


def standardize_lists(df: DataFrame) -> DataFrame:
    return df.withColumns({c: X.standard_list(c) for c in LISTS})


def add_has_score(df: DataFrame) -> DataFrame:
    at = df.columns.index("averageScore") + 1
    return df.withColumn("has_score", ~X.is_blank("averageScore")).select(*df.columns[:at], "has_score", *df.columns[at:])


def _popular():
    return [F.desc(F.coalesce(X.to_num("popularity"), F.lit(0.0))), F.asc("id"), F.asc("title_romaji")]


def remove_duplicate_ids(df: DataFrame) -> DataFrame:
    return first_per_key(df, ["id"], *_popular())


def remove_near_duplicate_titles(df: DataFrame) -> DataFrame:
    return first_per_key(df.withColumn("__title", X.normalize_title("title_romaji")), ["__title"], *_popular()).drop("__title")


def flag_outliers(df: DataFrame) -> DataFrame:
    return df.withColumn("episodes_outlier", F.coalesce(X.to_num("episodes") > 1500, F.lit(False)))


STEPS = [drop_empty_core, decode_entities, trim_text, standardize_lists, add_has_score, remove_duplicate_ids, remove_near_duplicate_titles, flag_outliers]


def clean(df: DataFrame) -> DataFrame:
    for step in STEPS:
        df = df.transform(step)
    return df


def changes(df: DataFrame) -> DataFrame:
    """(step, changed): rows dropped, cells rewritten or rows flagged by each step."""
    rows = []
    cells = lambda a, b, columns: sum((F.count_if(X.text(f"__old_{c}") != F.col(c)) for c in columns), F.lit(0))
    for step in STEPS:
        after = step(df)
        columns = {decode_entities: ["description"], trim_text: TRIMMED, standardize_lists: LISTS}.get(step)
        if columns:
            old = df.withColumns({f"__old_{c}": F.col(c) for c in columns})
            n = step(old).agg(cells(df, after, columns).alias("n"))
        elif step in (add_has_score, flag_outliers):
            n = after.agg(F.count_if("has_score" if step is add_has_score else "episodes_outlier").alias("n"))
        else:
            n = df.agg(F.count(F.lit(1)).alias("a")).crossJoin(after.agg(F.count(F.lit(1)).alias("b"))).select((F.col("a") - F.col("b")).alias("n"))
        rows.append(n.select(F.lit(step.__name__).alias("step"), F.col("n").cast("long").alias("changed")))
        df = after
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out
