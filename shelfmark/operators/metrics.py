"""Ranking metrics over predictions (seed_id, rank, rec_id) and judgements (seed_id, rec_id, label)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.operators.quality import markdown

KS = (3, 5, 10, 15)


def judged_once(judged: DataFrame, order: str = "pos") -> DataFrame:
    """Of judgements of one pair the last counts."""
    last = judged.groupBy("seed_id", "rec_id").agg(F.max_by("label", order).alias("label"))
    return last


def gain(label):
    return F.pow(F.lit(2.0), label) - 1


def known(judged: DataFrame, catalog: DataFrame | None) -> DataFrame:
    """Judgements of seeds that are in the catalog (id); all without one."""
    return judged if catalog is None else judged.join(catalog.select(F.col("id").alias("seed_id")), "seed_id", "left_semi")


def precision_recall(predicted: DataFrame, judged: DataFrame, ks=KS, threshold: int = 2, catalog: DataFrame | None = None) -> DataFrame:
    """(k, precision, recall, seeds): macro means over the seeds (of the catalog) that have a relevant item."""
    judged = known(judged, catalog)
    relevant = judged.filter(F.col("label") >= threshold).select("seed_id", "rec_id").distinct()
    sizes = relevant.groupBy("seed_id").agg(F.count(F.lit(1)).alias("n_relevant"))
    hits = predicted.join(relevant, ["seed_id", "rec_id"]).select("seed_id", "rank")
    per_k = F.explode(F.array(*[F.lit(k) for k in ks]))
    found = sizes.withColumn("k", per_k).join(hits, "seed_id", "left").groupBy("seed_id", "k", "n_relevant").agg(F.count_if(F.col("rank") <= F.col("k")).alias("hits"))
    return found.groupBy("k").agg(F.round(F.avg(F.col("hits") / F.col("k")), 6).alias("precision"), F.round(F.avg(F.col("hits") / F.col("n_relevant")), 6).alias("recall"), F.count(F.lit(1)).alias("seeds"))


def ndcg(predicted: DataFrame, judged: DataFrame, ks=KS, catalog: DataFrame | None = None) -> DataFrame:
    """(k, ndcg, seeds): macro mean over the seeds (of the catalog) whose ideal is positive; unjudged predictions gain nothing."""
    judged = known(judged, catalog)
    ideal_rank = F.row_number().over(Window.partitionBy("seed_id").orderBy(F.desc("label"), "rec_id"))
    ranked = judged.withColumn("rank", ideal_rank).select("seed_id", "rank", "label", F.lit(True).alias("ideal"))
    got = predicted.join(judged, ["seed_id", "rec_id"], "left").select("seed_id", "rank", F.coalesce("label", F.lit(0)).alias("label"), F.lit(False).alias("ideal"))
    part = gain(F.col("label")) / F.log2(F.col("rank") + 1.0)
    rows = ranked.unionByName(got).withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).filter("rank <= k")
    sums = rows.groupBy("seed_id", "k").agg(F.coalesce(F.sum(F.when(F.col("ideal"), part)), F.lit(0.0)).alias("best"), F.coalesce(F.sum(F.when(~F.col("ideal"), part)), F.lit(0.0)).alias("dcg"))
    return sums.filter("best > 0").groupBy("k").agg(F.round(F.avg(F.col("dcg") / F.col("best")), 6).alias("ndcg"), F.count(F.lit(1)).alias("seeds"))


def grid(models: dict[str, DataFrame], judged: DataFrame, ks=KS, catalog: DataFrame | None = None) -> DataFrame:
    """(model, k, ndcg, precision, recall) for each model, ranked once and cut at each k."""
    out = None
    for name, predicted in models.items():
        part = ndcg(predicted, judged, ks, catalog).select("k", "ndcg").join(precision_recall(predicted, judged, ks, catalog=catalog).drop("seeds"), "k").select(F.lit(name).alias("model"), "k", "ndcg", "precision", "recall")
        out = part if out is None else out.unionByName(part)
    return out


def model_report(name: str, metrics: DataFrame, k: int = 10, threshold: int = 2) -> str:
    """A model's precision and recall at one k as Markdown; metrics come from precision_recall()."""
    row = metrics.filter(F.col("k") == k).first()
    seeds, precision, recall = (row["seeds"], row["precision"], row["recall"]) if row else (0, 0.0, 0.0)
    rows = [["Evaluated seeds", str(seeds)], [f"Precision@{k}", f"{precision:.4f}"], [f"Recall@{k}", f"{recall:.4f}"]]
    return f"# {name}\n\nRelevant are judgements with a label of {threshold} or more.\n\n" + markdown(rows, ["Metric", "Value"]) + "\n"


def comparison_report(title: str, by_model: dict[str, DataFrame], columns: dict[str, str], ks=KS) -> str:
    """Models by measures at each k as Markdown. columns: heading by measure, as {"precision": "P", "recall": "R"} or {"ndcg": "NDCG"}."""
    rows = []
    for model, metrics in by_model.items():
        found = {r["k"]: r for r in metrics.collect()}  # a row for each k
        rows.append([model, *[f"{found[k][c]:.4f}" if k in found else "0.0000" for k in ks for c in columns]])
    return f"# {title}\n\n" + markdown(rows, ["Model", *[f"{heading}@{k}" for k in ks for heading in columns.values()]]) + "\n"


def strict_lenient_report(title: str, strict: dict[str, DataFrame], lenient: dict[str, DataFrame], ks=KS) -> str:
    """Two comparisons of precision and recall: with label 2 as relevant, and with labels from 1."""
    columns = {"precision": "P", "recall": "R"}
    parts = [comparison_report(heading, models, columns, ks).replace("# ", "## ", 1) for heading, models in (("Strict: label 2", strict), ("Lenient: label 1 or 2", lenient))]
    return f"# {title}\n\n" + "\n".join(parts)
