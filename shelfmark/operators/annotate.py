"""Judged lists: prompts, an injected language-model client, parsing with checks, filling, re-ranking, and the wide table."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions import text as X
from shelfmark.operators.topk import rerank
from shelfmark.sources.catalog import JUDGED_COLUMNS

REPLY = "struct<recommendations:array<struct<candidate_id:string,rank:int,similarity_label:int,similarity_score_10:int,reason:string>>>"
#: The reason of a candidate that fills a list up.
BACKUP = "Added to fill the list."
WIDE = ["title", "label", "score_10", "reason"]


def prompts(candidates: DataFrame) -> DataFrame:
    """(seed_id, prompt) of candidates (seed_id, seed_title, seed_genres, rank, rec_id, title, genres, tags, description)."""
    line = F.concat_ws(" | ", F.concat(F.lit("id: "), "rec_id"), F.concat(F.lit("title: "), "title"), F.concat(F.lit("genres: "), X.list_commas("genres")), F.concat(F.lit("tags: "), X.list_commas("tags", 16)), X.truncate_words("description", 500))
    rows = candidates.select("seed_id", "seed_title", "seed_genres", "rank", line.alias("line"))
    lists = rows.groupBy("seed_id").agg(F.first("seed_title").alias("t"), F.first("seed_genres").alias("g"), F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("lines"))
    head = F.concat(F.lit("Seed: "), "t", F.lit(" ("), X.list_commas("g"), F.lit(")\nReturn JSON with `recommendations`: candidate_id, rank, similarity_score_10, reason.\nCandidates:\n"))
    return lists.select("seed_id", F.concat(head, F.array_join(F.transform("lines", lambda x: x["line"]), "\n")).alias("prompt"))


class ChatClient:
    """Calls `send(prompt) -> (status, headers, body)` until it answers: waits as told after 429, longer each time after other failures."""

    def __init__(self, send: Callable, tries: int = 5, delay: float = 8.0, sleep: Callable[[float], None] = time.sleep):
        self.send, self.tries, self.delay, self.sleep = send, tries, delay, sleep

    def call(self, prompt: str) -> str:
        said = "no try"
        for attempt in range(1, self.tries + 1):
            try:
                status, headers, body = self.send(prompt)
            except Exception as error:
                status, headers, body = 0, {}, str(error)
            if status == 200:
                return body
            said = f"status {status}: {body}"
            if attempt < self.tries:
                self.sleep(float(headers.get("Retry-After", self.delay)) if status == 429 else self.delay * attempt)
        raise RuntimeError(f"the client gave up after {self.tries} tries ({said})")


def extract_json(reply: str) -> dict:
    try:
        return json.loads(reply)
    except json.JSONDecodeError:
        if found := re.search(r"\{.*\}", reply, re.DOTALL):
            return json.loads(found[0])
        raise


def verify_prompt(prompt: str, reply: str, number: int) -> str:
    """The prompt of a verifying pass: the pool again, and the current list to be checked; a reply without one is shown as it is."""
    try:
        current = extract_json(reply)["recommendations"]
    except (json.JSONDecodeError, KeyError, TypeError):
        return f"Verifying pass {number}\n{prompt}\nReturn the list that this reply lacks:\n{reply}"
    lines = []
    for i, x in enumerate(current, 1):
        lines.append(" | ".join([f"rank: {x.get('rank', i)}", f"id: {x.get('candidate_id')}", f"label: {x.get('similarity_label')}", f"score: {x.get('similarity_score_10')}", f"reason: {x.get('reason')}"]))
    return f"Verifying pass {number}\n{prompt}\nCurrent list, to be checked, corrected and returned whole:\n" + "\n".join(lines)


def ask(prompt_rows: DataFrame, make_client: Callable[[], ChatClient], verify_passes: int = 2) -> DataFrame:
    """(seed_id, reply): the client's answer to each prompt, shown to it again `verify_passes` times."""

    def run(frames):
        client = make_client()
        for frame in frames:
            replies = []
            for prompt in frame["prompt"]:
                reply = client.call(prompt)
                for number in range(1, verify_passes + 1):
                    reply = client.call(verify_prompt(prompt, reply, number))
                replies.append(reply)
            yield pd.DataFrame({"seed_id": frame["seed_id"], "reply": replies})

    return prompt_rows.mapInPandas(run, "seed_id string, reply string")


def within(picks: DataFrame, candidates: DataFrame) -> DataFrame:
    """Picks (seed_id, rec_id, ...) that are among their seed's candidates."""
    return picks.join(candidates.select("seed_id", "rec_id").distinct(), ["seed_id", "rec_id"], "left_semi")


def judged(replies: DataFrame, candidates: DataFrame, k: int = 15) -> DataFrame:
    """(seed_id, rank, rec_id, label, score_10, reason) from replies (seed_id, reply) and candidates (seed_id, rec_id, pos).

    Picks outside the seed's candidates go, the first of repeated picks stays,
    labels follow from the clamped scores, lists are filled up to k from the
    candidates in order, and all are ranked by score, label and given rank.
    """
    parsed = replies.select("seed_id", F.from_json(X.json_object("reply"), REPLY).alias("r")).select("seed_id", F.posexplode("r.recommendations").alias("at", "p"))
    score = X.clamp(F.coalesce("p.similarity_score_10", F.lit(0)), 0, 10)
    picks = within(parsed.select("seed_id", F.col("p.candidate_id").alias("rec_id"), "at", F.coalesce("p.rank", F.col("at") + 1).alias("rank"), score.alias("score_10"), F.trim(F.coalesce("p.reason", F.lit(""))).alias("reason")), candidates)
    once = picks.groupBy("seed_id", "rec_id").agg(F.min_by(F.struct("rank", "score_10", "reason", "at"), "at").alias("p")).select("seed_id", "rec_id", "p.*")
    once = once.withColumn("label", X.label_from_score(F.col("score_10")))
    seeds = once.groupBy("seed_id").agg(F.count(F.lit(1)).alias("have"))
    unseen = candidates.select("seed_id", "rec_id", "pos").join(once.select("seed_id", "rec_id"), ["seed_id", "rec_id"], "left_anti").join(seeds, "seed_id", "left")
    place = F.coalesce("have", F.lit(0)) + F.row_number().over(Window.partitionBy("seed_id").orderBy("pos", "rec_id"))
    backup = unseen.withColumn("rank", place).filter(F.col("rank") <= k).select("seed_id", "rec_id", "rank", F.lit(4).alias("score_10"), F.lit(BACKUP).alias("reason"), F.lit(1).alias("label"))
    rows = once.select(*backup.columns).unionByName(backup)
    return rerank(rows, k).select("seed_id", "rank", "rec_id", "label", "score_10", "reason")


def judged_rows(judged_lists: DataFrame, candidates: DataFrame) -> DataFrame:
    """The columns of a judged file: judged lists with the attributes of candidate rows (setsim.candidate_rows)."""
    own = candidates.select("seed_id", F.col("candidate_id").alias("rec_id"), "seed_title", "seed_genres", "seed_tags", "candidate_title", "candidate_genres", "candidate_tags").dropDuplicates(["seed_id", "rec_id"])
    named = {"recommended_id": "rec_id", "recommended_title": "candidate_title", "similarity_label": "label", "similarity_score_10": "score_10", "recommended_genres": "candidate_genres", "recommended_tags": "candidate_tags"}
    return judged_lists.join(own, ["seed_id", "rec_id"]).select(*[F.col(named.get(c, c)).alias(c) for c in JUDGED_COLUMNS])


def audit_records(rows: DataFrame) -> DataFrame:
    """(seed_id, seed_title, recommendations): a record for each seed with its list, of judged rows."""
    entry = F.struct(F.col("recommended_id").alias("candidate_id"), "rank", "similarity_label", "similarity_score_10", "reason")
    lists = rows.groupBy("seed_id", "seed_title").agg(F.array_sort(F.collect_list(F.struct("rank", entry.alias("e")))).alias("l"))
    return lists.select("seed_id", "seed_title", F.transform("l", lambda x: x["e"]).alias("recommendations"))


def wide(rows: DataFrame, ranks: range = range(1, 16)) -> DataFrame:
    """One row per seed: title, label, score and reason of each rank, blank where there is none; of repeated ranks the last (by pos) counts."""
    last = [F.max_by(c, "pos").alias(c) for c in WIDE]
    pivoted = rows.groupBy("seed_id", "seed_title").pivot("rank", list(ranks)).agg(*last)
    names = [f"{r}_{c}" for r in ranks for c in WIDE]
    return pivoted.select("seed_id", "seed_title", *[F.coalesce(F.col(f"`{n}`").cast("string"), F.lit("")).alias(f"rec_{n}") for n in names])


def unfinished(candidates: DataFrame, done: DataFrame) -> DataFrame:
    """Candidates of seeds that are not among the results yet."""
    return candidates.join(done.select("seed_id").distinct(), "seed_id", "left_anti")
