"""Search and recommend as functions that return rows, with the errors a service would map to statuses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import text as X

#: Model names, what they are shown as, and the least score that is shown.
LABELS = {"hybrid": "Hybrid", "tfidf": "TF-IDF", "bm25f": "BM25F", "embedding": "Embedding", "embedding_minilm": "Embedding (MiniLM)", "embedding_bge": "Embedding (BGE)"}
LEAST_SCORE = {"hybrid": 0.04, "tfidf": 0.02, "bm25f": 0.01, "embedding": 0.12, "embedding_minilm": 0.12, "embedding_bge": 0.12}


class BadRequest(ValueError):
    """Status 400."""


def search_titles(items: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """The first items, by pos, whose titles contain the query literally, whatever its case; none for a blank query."""
    wanted = (query or "").strip().lower()
    blob = F.lower(F.concat_ws(" ", X.text("title_romaji"), X.text("title_english")))
    hits = items.filter(F.lit(bool(wanted)) & blob.contains(F.lit(wanted)))
    return hits.orderBy("pos").limit(limit).select("id", F.col("title_romaji").alias("title"), "title_english", "cover_image", "pos")


def best_match(items: DataFrame, query: str) -> str:
    found = search_titles(items, query, 1).first()
    if found is None:
        raise KeyError(f"no title contains {query!r}")
    return found["id"]


class Recommender:
    """Models by name over items with pos, made when first asked for; a model maps (seeds, k) to ranked rows."""

    def __init__(self, items: DataFrame, models: dict[str, Callable[[], Callable[[DataFrame, int], DataFrame]]]):
        self.items, self.makers, self.made = items, models, {}

    def model(self, name: str):
        if name not in self.makers:
            raise BadRequest(f"unknown model {name!r}; one of {', '.join(self.makers)}")
        if name not in self.made:
            self.made[name] = self.makers[name]()
        return self.made[name]

    def recommend(self, model: str = "hybrid", id: str | None = None, q: str | None = None, top_k: int = 10) -> DataFrame:
        """The source item's recommendations with their attributes, the score to 4 places. KeyError (404) if there is no such item."""
        ranker, k = self.model(model), int(top_k)
        wanted = id or best_match(self.items, q or "")
        seed = self.items.filter(F.col("id") == wanted)
        if seed.isEmpty():
            raise KeyError(f"no item {wanted!r}")
        about = self.items.select(F.col("id").alias("rec_id"), F.col("title_romaji").alias("title"), "title_english", "genres", "tags", "cover_image")
        return ranker(seed, k).join(about, "rec_id").select("rank", F.col("rec_id").alias("id"), "title", "title_english", F.round("score", 4).alias("score"), "genres", "tags", "cover_image").orderBy("rank")


def page(ranked: DataFrame, shown: int = 10, more: int = 0, step: int = 5) -> DataFrame:
    return ranked.filter(F.col("rank") <= shown + step * more)
