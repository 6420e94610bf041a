"""Identification metrics of a scored query x gallery table, with intervals over groups."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def per_query(scores: DataFrame, queries: DataFrame, gallery: DataFrame, *by: str) -> DataFrame:
    """hit1, hit5 and average precision of each query.

    scores: (q_id, g_id, score, by...); queries and gallery: (id, design).  Gallery rows of
    the query's design are relevant; a design that the gallery lacks has precision 0.
    """
    rank = F.row_number().over(Window.partitionBy("q_id", *by).orderBy(F.desc("score"), "g_id"))
    ranked = scores.withColumn("rank", rank).join(queries.select(F.col("id").alias("q_id"), F.col("design").alias("q_design")), "q_id").join(gallery.select(F.col("id").alias("g_id"), F.col("design").alias("g_design")), "g_id")
    hit = F.col("q_design") == F.col("g_design")
    nth = F.sum(hit.cast("int")).over(Window.partitionBy("q_id", *by).orderBy("rank"))
    ranked = ranked.withColumn("nth", nth)
    return ranked.groupBy("q_id", "q_design", *by).agg(
        F.max((hit & (F.col("rank") == 1)).cast("double")).alias("hit1"),
        F.max((hit & (F.col("rank") <= 5)).cast("double")).alias("hit5"),
        F.coalesce(F.avg(F.when(hit, F.col("nth") / F.col("rank"))), F.lit(0.0)).alias("ap"),
    )


def summary(per_query_rows: DataFrame, *by: str) -> DataFrame:
    """Rank-1, Rank-5 and mAP, by group if asked for."""
    return per_query_rows.groupBy(*by).agg(F.avg("hit1").alias("rank1"), F.avg("hit5").alias("rank5"), F.avg("ap").alias("map"), F.count("*").alias("n_queries"), F.count_distinct("q_design").alias("n_designs"))


def bootstrap_weights(spark, groups: list, draws: int, seed: int) -> DataFrame:
    """(draw, group, weight): how often each of the sorted groups is drawn with replacement.

    The generator and order are NumPy's, so draws are those of any NumPy program with this seed.
    Such a generator is sequential, so one task makes the draws, one at a time; ``hashed_weights``
    has no such limit.
    """
    groups = sorted(groups)

    def run(batches):
        import pandas as pd

        for b in batches:
            for _ in b["id"]:
                rng = np.random.default_rng(seed)
                for d in range(draws):
                    g, n = np.unique(rng.choice(len(groups), size=len(groups), replace=True), return_counts=True)
                    yield pd.DataFrame({"draw": d, "grp": [str(groups[k]) for k in g], "weight": n.astype(np.int64)})

    return spark.range(0, 1, 1, 1).mapInPandas(run, "draw long, grp string, weight long")


def hashed_weights(groups: DataFrame, draws: int, seed: int) -> DataFrame:
    """(draw, grp, weight) without a generator's order: each of the n places of a draw takes the group of a hashed index.

    groups: (grp, k, n) with k from 0 and n their number.  Every place of a draw is drawn on
    its own, so the table is made in parallel and in SQL alike.
    """
    from sparkloom.functions.ids import stable_seed

    places = groups.select(F.col("k").alias("place"), "n").withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(draws - 1).cast("long"))))
    picked = places.withColumn("k", stable_seed(F.lit(str(seed)), F.col("draw").cast("string"), F.col("place").cast("string")) % F.col("n"))
    return picked.groupBy("draw", "k").agg(F.count("*").alias("weight")).join(groups.select("grp", "k"), "k").select("draw", "grp", "weight")


def interval(per_group: DataFrame, weights: DataFrame, metrics: list[str], confidence: float = 0.95) -> DataFrame:
    """(metric, low, high): percentiles of the weighted means.

    per_group: (grp, n, <metric> sums); weights: (draw, grp, weight).  A drawn group brings all its rows.
    """
    stats = weights.join(per_group, "grp").groupBy("draw").agg(*[(F.sum(F.col("weight") * F.col(m)) / F.sum(F.col("weight") * F.col("n"))).alias(m) for m in metrics])
    alpha = (1 - confidence) / 2
    long = stats.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])).alias("s")).select("s.*")
    return long.groupBy("metric").agg(F.expr(f"percentile(value, {alpha})").alias("low"), F.expr(f"percentile(value, {1 - alpha})").alias("high"))


def genuine_scores(scores: DataFrame, queries: DataFrame, gallery: DataFrame) -> DataFrame:
    """(q_id, q_design, score): each query's best score with the gallery of its own design; minus infinity if the gallery lacks it."""
    g = gallery.select(F.col("id").alias("g_id"), F.col("design").alias("q_design"))
    q = queries.select(F.col("id").alias("q_id"), F.col("design").alias("q_design"))
    own = scores.join(q, "q_id").join(g, ["g_id", "q_design"]).groupBy("q_id").agg(F.max("score").alias("score"))
    return q.join(own, "q_id", "left").select("q_id", "q_design", F.coalesce("score", F.lit(float("-inf"))).alias("score"))


def hits_by_group(genuine: DataFrame, threshold: DataFrame) -> DataFrame:
    """(grp, n, tar): queries of each design, and how many are accepted at a frozen threshold (one row); what ``interval`` resamples."""
    met = genuine.join(F.broadcast(threshold.select("threshold").limit(1)))
    return met.groupBy(F.col("q_design").alias("grp")).agg(F.count("*").alias("n"), F.sum((F.col("score") >= F.col("threshold")).cast("double")).alias("tar"))


def real_pair_queries(queries: DataFrame, kind: str = "real_view") -> DataFrame:
    """Queries of the designs that have one of this kind; queries: (id, design, query_kind)."""
    return queries.join(queries.where(F.col("query_kind") == kind).select("design").distinct(), "design", "left_semi")


def selection_metric(per_kind: DataFrame) -> DataFrame:
    """(held_out, in_distribution, gap, selected): mean average precision of the kinds that select a model, of the one that doesn't, and the gap.

    per_kind: (kind, map) with kinds heldout, tonal and indist; an absent kind is left out of the mean, and without any the metric is -1.
    """
    of = lambda k: F.max(F.when(F.col("kind") == k, F.col("map")))
    out = per_kind.agg(of("heldout").alias("held_out"), of("indist").alias("in_distribution"), F.coalesce(F.avg(F.when(F.col("kind").isin("heldout", "tonal"), F.col("map"))), F.lit(-1.0)).alias("selected"))
    return out.select("held_out", "in_distribution", (F.col("in_distribution") - F.col("held_out")).alias("gap"), "selected")
