"""Quality profile: declarative checks, all counted in one aggregate, then unpivoted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import text as X

#: Fixed values.
FORMATS = ["TV", "TV_SHORT", "MOVIE", "SPECIAL", "OVA", "ONA", "MUSIC"]
STATUSES = ["FINISHED", "RELEASING", "NOT_YET_RELEASED", "CANCELLED"]
SEASONS = ["SPRING", "SUMMER", "FALL", "WINTER"]
EXPECTED_MISSING = ["title_english", "averageScore"]
SNAPSHOT = ["title_english", "averageScore", "genres", "tags", "description"]


def counted(df: DataFrame, section: str, checks: dict[str, Column]) -> DataFrame:
    """(section, check, count, pct) with one row per check; pct of an empty frame is null."""
    total = F.count(F.lit(1))
    wide = df.agg(total.alias("__n"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in checks.items()])
    return unpivoted(wide, section, list(checks))


def unpivoted(wide: DataFrame, section: str, names: list[str]) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(f"`{n}`").cast("long").alias("count")) for n in names]))
    rows = wide.select("__n", pairs.alias("p"))
    return rows.select(F.lit(section).alias("section"), "p.check", "p.count", F.round(F.try_divide(F.col("p.count") * 100.0, F.col("__n")), 6).alias("pct"))


def completeness(df: DataFrame, columns: list[str]) -> DataFrame:
    rows = counted(df, "completeness", {c: X.is_blank(c) for c in columns})
    return rows.withColumn("expected", F.col("check").isin(EXPECTED_MISSING))


def _num(c: str) -> Column:
    return X.to_num(c)


def _not_in(c: str, known: list[str]) -> Column:
    return ~X.is_blank(c) & ~X.text(c).isin(known)


def validity(df: DataFrame) -> DataFrame:
    score, mean, year = _num("averageScore"), _num("meanScore"), _num("seasonYear")
    return counted(df, "validity", {
        "averageScore out of range": (score < 0) | (score > 100), "meanScore out of range": (mean < 0) | (mean > 100),
        "episodes negative": _num("episodes") < 0, "duration not positive": _num("duration") <= 0, "seasonYear out of range": (year < 1940) | (year > 2027),
        "format unknown": _not_in("format", FORMATS), "status unknown": _not_in("status", STATUSES), "season unknown": _not_in("season", SEASONS),
    })


def consistency(df: DataFrame) -> DataFrame:
    finished = X.text("status") == "FINISHED"
    return counted(df, "consistency", {
        "finished without end date": finished & X.is_blank("end_date"), "finished with no episodes": finished & (_num("episodes") == 0),
        "season set for a movie": ~X.is_blank("season") & (X.text("format") == "MOVIE"), "one score without the other": X.is_blank("averageScore") != X.is_blank("meanScore"),
    })


def uniqueness(df: DataFrame, key: str = "id", title: str = "title_romaji") -> DataFrame:
    dup = lambda c: F.count(F.lit(1)) - F.count_distinct(c)
    wide = df.agg(F.count(F.lit(1)).alias("__n"), dup(X.text(key)).alias("duplicate ids"), dup(X.normalize_title(title)).alias("near-duplicate titles"))
    return unpivoted(wide, "uniqueness", ["duplicate ids", "near-duplicate titles"])


def outliers(df: DataFrame) -> DataFrame:
    return counted(df, "outliers", {"episodes over 1500": _num("episodes") > 1500, "duration over 180": _num("duration") > 180, "popularity zero": _num("popularity") == 0, "favourites zero": _num("favourites") == 0})


def text_quality(df: DataFrame) -> DataFrame:
    d = X.strip("description")
    return counted(df, "text", {
        "description blank": d == "", "description short": (d != "") & (F.char_length(d) < 20), "description with entities": X.has_entity("description"),
        "description placeholder": F.lower(d).isin(X.PLACEHOLDERS), "cover blank": X.is_blank("cover_image"),
    })


def snapshot(df: DataFrame) -> DataFrame:
    """One row: the number of rows and the share of filled values of some columns."""
    share = lambda c: F.coalesce(F.round(F.try_divide(F.count_if(~X.is_blank(c)) * 100.0, F.count(F.lit(1))), 6), F.lit(0.0))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), *[share(c).alias(f"{c}_pct") for c in SNAPSHOT])


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    out = completeness(df, columns).drop("expected")
    for part in (validity(df), consistency(df), uniqueness(df), outliers(df), text_quality(df)):
        out = out.unionByName(part)
    return out


def markdown(rows: list, headers: list[str]) -> str:
    """A Markdown table of a few rows."""
    lines = ["| " + " | ".join(headers) + " |", "|" + "---|" * len(headers)]
    return "\n".join([*lines, *("| " + " | ".join(str(v) for v in r) + " |" for r in rows)])


def write_report(profile_rows: DataFrame, path: str) -> None:
    """The profile, a few rows per section, as a Markdown file on the driver."""
    rows = profile_rows.collect()
    pct = lambda r: "-" if r["pct"] is None else f"{r['pct']:.1f}%"
    parts = ["# Quality report"]
    for section in dict.fromkeys(r["section"] for r in rows):
        parts.append(f"## {section}\n\n" + markdown([(r["check"], r["count"], pct(r)) for r in rows if r["section"] == section], ["check", "count", "share"]))
    with open(path, "w", encoding="utf-8") as file:
        file.write("\n\n".join(parts) + "\n")
