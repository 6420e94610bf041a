"""Leakage audit, exclusions, pair mining and success rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.strings import palette_band
from sparkloom.functions.vectors import l1
from sparkloom.operators.ranges import quantiles
from sparkloom.operators.schema import with_index
from sparkloom.operators.similarity import knn_pairs, top_k
from sparkloom.plans.shared import dealt_join, written


def nearest_train(test: DataFrame, train: DataFrame) -> DataFrame:
    """(id, nearest, cosine): each test row's nearest train row; of equals the smallest id.  Both: (id, vec)."""
    return top_k(test, train, 1).select(F.col("q_id").alias("id"), F.col("g_id").alias("nearest"), F.col("score").alias("cosine"))


def audit_percentiles(audit: DataFrame) -> DataFrame:
    return audit.agg(F.count("*").alias("n"), F.max("cosine").alias("max")).join(quantiles(audit, "cosine", {"p50": 0.5, "p90": 0.9, "p99": 0.99}))


def top_report(audit: DataFrame, n: int) -> DataFrame:
    return audit.orderBy(F.desc("cosine"), "id").limit(n)


def best_per_pair(audit: DataFrame, a: str, b: str, score: str, tie: str) -> DataFrame:
    """One row for each pair of designs: the best scored."""
    return audit.withColumn("_k", F.row_number().over(Window.partitionBy(a, b).orderBy(F.desc(score), tie))).where("_k = 1").drop("_k")


def link_action(a_design: Column, a_split: Column, b_design: Column, b_split: Column) -> tuple[Column, Column]:
    """What a link means for a manifest, and the design it excludes."""
    out_a = (a_split == "test") & (b_split == "train")
    out_b = (b_split == "test") & (a_split == "train")
    touches = (a_split == "test") | (b_split == "test")
    other = F.when(a_split == "test", b_split).otherwise(a_split)
    action = F.when(out_a, "EXCLUDE test side").when(out_b, "EXCLUDE partner (now in test)").when(a_design == b_design, "same design now; no leak").when(touches, F.concat(F.lit("kept: partner in "), other, F.lit(", not train"))).otherwise("no test side")
    return action, F.when(out_a, a_design).when(out_b, b_design)


def resolve_links(links: DataFrame, manifest: DataFrame) -> DataFrame:
    """Links with action and target; an image that the manifest lacks is an error.  links: (test_image_id, other_image_id, ...)."""
    manifest = written(manifest.select("image_id", "design_id", "split"), "resolved")
    ids = links.select(F.explode(F.array("test_image_id", "other_image_id")).alias("image_id"))
    if missing := ids.join(manifest, "image_id", "left_anti").limit(5).collect():
        raise ValueError(f"links name images the manifest lacks: {[r.image_id for r in missing]}")
    side = lambda p, c: manifest.select(F.col("image_id").alias(c), F.col("design_id").alias(f"{p}_design"), F.col("split").alias(f"{p}_split"))
    joined = links.join(side("a", "test_image_id"), "test_image_id").join(side("b", "other_image_id"), "other_image_id")
    action, target = link_action(F.col("a_design"), F.col("a_split"), F.col("b_design"), F.col("b_split"))
    return joined.withColumn("action", action).withColumn("target", target)


def exclusions(links: DataFrame, audited: DataFrame, manifest: DataFrame, vectors: DataFrame, least: float = 0.90) -> DataFrame:
    """(design_id, reason) of every test design: link, rule, kept_reviewed or kept_unreviewed.

    Test designs that no audit covers and no link excludes go by rule if any of their images has
    a train image from this cosine.  audited: (image_id); vectors: (image_id, id, vec).
    """
    real = written(manifest.where(~F.col("is_synthetic")).select("image_id", "design_id", "split"), "real")
    test = real.where("split = 'test'").select("design_id").distinct()
    linked = resolve_links(links, real).where(F.col("target").isNotNull()).select(F.col("target").alias("design_id")).distinct().withColumn("linked", F.lit(True))
    covered = real.join(audited.select("image_id").distinct(), "image_id", "left_semi").select("design_id").distinct().withColumn("covered", F.lit(True))
    state = test.join(linked, "design_id", "left").join(covered, "design_id", "left")
    open_ = state.where("linked IS NULL AND covered IS NULL").select("design_id")
    rows = real.join(vectors, "image_id")
    near = nearest_train(rows.where("split = 'test'").join(open_, "design_id", "left_semi").select("id", "vec"), rows.where("split = 'train'").select("id", "vec"))
    ruled = near.join(rows.select("id", "design_id"), "id").groupBy("design_id").agg(F.max("cosine").alias("c")).where(F.col("c") >= least).select("design_id", F.lit(True).alias("ruled"))
    reason = F.when(F.col("linked"), "link").when(F.col("ruled"), "rule").when(F.col("covered"), "kept_reviewed").otherwise("kept_unreviewed")
    return state.join(ruled, "design_id", "left").select("design_id", reason.alias("reason"))


def exclusion_counts(found: DataFrame) -> DataFrame:
    """One row of counts and the designs left; that the reasons partition the test designs is asserted in the plan."""
    n = lambda r: F.count_if(F.col("reason") == r).alias(r)
    out = found.agg(F.count("*").alias("test_designs"), n("link"), n("rule"), n("kept_reviewed"), n("kept_unreviewed"), F.count_distinct("design_id").alias("_d"))
    whole = (F.col("test_designs") == F.col("link") + F.col("rule") + F.col("kept_reviewed") + F.col("kept_unreviewed")) & (F.col("test_designs") == F.col("_d"))
    wrong = F.raise_error(F.lit("reasons do not partition the test designs")).cast("long")
    return out.select(F.when(whole, F.col("test_designs")).otherwise(wrong).alias("test_designs"), "link", "rule", "kept_reviewed", "kept_unreviewed", (F.col("test_designs") - F.col("link") - F.col("rule")).alias("final_test_designs"))


def mined_pairs(rows: DataFrame, *, k: int = 3, min_sat: float = 0.05, min_hue: float = 0.6) -> DataFrame:
    """Pairs of designs alike in grey and unlike in hue; rows: (id, design, vec, hist, saturated).

    The k nearest are cut first and own-design neighbours dropped after, so fewer than k may stay.
    """
    pairs = knn_pairs(rows.select("id", "vec"), k)
    side = lambda p, c: rows.select(F.col("id").alias(c), F.col("design").alias(f"{p}_design"), F.col("hist").alias(f"{p}_hist"), F.col("saturated").alias(f"{p}_sat"))
    met = pairs.join(side("a", "i"), "i").join(side("b", "j"), "j").where("a_design <> b_design").where(F.col("a_hist").isNotNull() & F.col("b_hist").isNotNull() & (F.least("a_sat", "b_sat") >= min_sat))
    return met.withColumn("hue_l1", l1("a_hist", "b_hist")).where(F.col("hue_l1") >= min_hue).select("i", "j", "a_design", "b_design", F.bround("score", 4).alias("cosine"), F.bround("hue_l1", 3).alias("hue_l1"))


def numbered_pairs(mined: DataFrame) -> DataFrame:
    """Mined pairs with idx from 1 by falling cosine, then by ids."""
    ordered = mined.withColumn("_o", F.struct((-F.col("cosine")).alias("c"), "i", "j"))
    return with_index(ordered, "_o", "idx").withColumn("idx", F.col("idx") + 1).drop("_o")


def review_flags(edges: DataFrame, least: float = 0.45) -> DataFrame:
    """Verified pairs whose hues differ inside the overlap, for human eyes: kind, source, path_a, path_b, ncc, overlap, hue_overlap, note.

    NaN hues (too few saturated pixels) never flag.  edges: (source, path_a, path_b, ncc, overlap, hue_overlap).
    """
    h = F.col("hue_overlap")
    flagged = edges.where(h.isNotNull() & ~F.isnan(h) & (h >= least))
    return flagged.select(F.lit("palette_differs").alias("kind"), "source", "path_a", "path_b", F.bround("ncc", 4).alias("ncc"), F.bround("overlap", 4).alias("overlap"), F.bround(h, 4).alias("hue_overlap"), F.lit("same pixels, other hues: one design in two colours?").alias("note"))


def family_flags(majorities: DataFrame) -> DataFrame:
    """The same columns for designs whose rows name several families; majorities: (design_id, craft_family, contradiction)."""
    none = F.lit(None).cast("double")
    return majorities.where("contradiction").select(F.lit("family_contradiction").alias("kind"), F.lit("").alias("source"), F.col("design_id").alias("path_a"), F.lit("").alias("path_b"), none.alias("ncc"), none.alias("overlap"), none.alias("hue_overlap"), F.concat(F.lit("several families; kept: "), "craft_family").alias("note"))


def palette_tally(edges: DataFrame, distance: str = "hue_overlap") -> DataFrame:
    """(band, n) of verified pairs by how far their hues are apart."""
    return edges.groupBy(palette_band(F.col(distance)).alias("band")).agg(F.count("*").alias("n"))


def same_family_negatives(rows: DataFrame, components: DataFrame, unreviewed: DataFrame | None = None, alike: str | None = None) -> DataFrame:
    """(i, j): pairs of one family, not of one component, not awaiting review.  rows: (id, family); components: (id, component); unreviewed: (i, j).

    alike: a column of rows; pairs that share its value await review too.  Such a rule is applied as pairs are made, where a list of pairs is a join of them all.
    """
    keep = [alike] if alike else []
    r = rows.join(components, "id", "left").select("id", "family", *keep, F.coalesce("component", "id").alias("component"))
    a, b = (r.select(F.col("id").alias(i), "family", F.col("component").alias(f"c{i}"), *[F.col(c).alias(f"m{i}") for c in keep]) for i in ("i", "j"))
    pairs = dealt_join(a, b, ["family"], "i").where((F.col("i") < F.col("j")) & (F.col("ci") != F.col("cj")))
    pairs = (pairs.where(~F.coalesce(F.col("mi") == F.col("mj"), F.lit(False))) if alike else pairs).select("i", "j")
    if unreviewed is None:
        return pairs
    key = unreviewed.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).distinct()
    return pairs.join(key, ["i", "j"], "left_anti")


def partners(accepted: DataFrame, audit: DataFrame, manifest: DataFrame) -> DataFrame:
    """Links for test images: the accepted pair in train first, else the audit's nearest.

    accepted: (image_id_a, image_id_b); audit: (image_id, nearest_image_id, cosine).
    """
    both = accepted.select(F.col("image_id_a").alias("image_id"), F.col("image_id_b").alias("partner")).unionByName(accepted.select(F.col("image_id_b").alias("image_id"), F.col("image_id_a").alias("partner")))
    train = manifest.where("split = 'train'").select(F.col("image_id").alias("partner"))
    first = both.join(train, "partner", "left_semi").groupBy("image_id").agg(F.min("partner").alias("accepted"))
    near = audit.groupBy("image_id").agg(F.max_by("nearest_image_id", F.struct("cosine", "nearest_image_id")).alias("nearest"))
    return near.join(first, "image_id", "left").select(F.col("image_id").alias("test_image_id"), F.coalesce("accepted", "nearest").alias("other_image_id"), F.when(F.col("accepted").isNotNull(), "accepted pair").otherwise("nearest train").alias("kind"))


def bars_from(reference: DataFrame, guard: str = "main_rank1") -> DataFrame:
    """(metric, bar) from a reference method's intervals (metric, value, low, high): upper ends to beat, and the guard metric's lower end as ``guard``."""
    return reference.select(F.when(F.col("metric") == guard, "guard").otherwise(F.col("metric")).alias("metric"), F.when(F.col("metric") == guard, F.col("low")).otherwise(F.col("high")).alias("bar"))


def verdict(bars: DataFrame, results: DataFrame) -> DataFrame:
    """(method, n_beaten, guard_ok, verdict): SUCCESS if any metric strictly beats its bar and the guard holds.

    bars: (metric, bar) with the guard as metric ``guard``; results: (method, metric, value).
    Null bars and values are skipped.
    """
    met = results.join(F.broadcast(bars), "metric")
    guard = F.col("metric") == "guard"
    beaten = F.count_if(~guard & (F.col("value") > F.col("bar")))
    ok = F.coalesce(F.max(F.when(guard, F.col("value") >= F.col("bar"))), F.lit(False))
    out = met.groupBy("method").agg(beaten.alias("n_beaten"), ok.alias("guard_ok"))
    return out.withColumn("verdict", F.when((F.col("n_beaten") > 0) & F.col("guard_ok"), "SUCCESS").otherwise("FAIL"))
