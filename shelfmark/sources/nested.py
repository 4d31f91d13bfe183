"""Nested pages of items: parsing and flattening."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import text as X

DATE = "struct<year:int,month:int,day:int>"
MEDIA = (
    "struct<id:long,idMal:long,title:struct<romaji:string,english:string,native:string>,type:string,format:string,source:string,episodes:int,duration:int,status:string,season:string,"
    f"seasonYear:int,startDate:{DATE},endDate:{DATE},averageScore:int,meanScore:int,popularity:long,favourites:long,genres:array<string>,tags:array<struct<name:string,rank:int>>,"
    "studios:struct<nodes:array<struct<name:string>>>,description:string,coverImage:struct<large:string>,isAdult:boolean>"
)
PAGE = f"struct<data:struct<Page:struct<pageInfo:struct<currentPage:int,hasNextPage:boolean>,media:array<{MEDIA}>>>>"


def parse_pages(df: DataFrame, column: str = "body") -> DataFrame:
    """(current_page, has_next_page, m): a row per item; missing parts are no error."""
    page = df.select(F.from_json(column, PAGE).alias("p")).select(F.col("p.data.Page").alias("p"))
    return page.select(F.col("p.pageInfo.currentPage").alias("current_page"), F.coalesce("p.pageInfo.hasNextPage", F.lit(False)).alias("has_next_page"), F.explode("p.media").alias("m"))


def flatten(df: DataFrame, m: str = "m") -> DataFrame:
    """The flat columns of an item struct, all as strings."""
    own = lambda c: X.text(f"{m}.{c}")
    date = lambda c: X.partial_date(F.col(f"{m}.{c}.year"), F.col(f"{m}.{c}.month"), F.col(f"{m}.{c}.day"))
    plain = lambda *names: [own(c).alias(c) for c in names]
    return df.select(
        *plain("id", "idMal"), own("title.romaji").alias("title_romaji"), own("title.english").alias("title_english"), own("title.native").alias("title_native"),
        *plain("type", "format", "source", "episodes", "duration", "status", "season", "seasonYear"), date("startDate").alias("start_date"), date("endDate").alias("end_date"),
        *plain("averageScore", "meanScore", "popularity", "favourites"), F.coalesce(X.join_list(F.col(f"{m}.genres")), F.lit("")).alias("genres"),
        F.coalesce(X.join_list(F.transform(f"{m}.tags", lambda t: t["name"])), F.lit("")).alias("tags"), F.coalesce(X.join_list(F.transform(f"{m}.studios.nodes", lambda t: t["name"])), F.lit("")).alias("studios"),
        X.strip_markup(f"{m}.description").alias("description"), own("coverImage.large").alias("cover_image"), own("isAdult").alias("isAdult"),
    )
