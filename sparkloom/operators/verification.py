"""Verification metrics of scored pairs (score, genuine), by group if asked for.

All come from one table, the curve: pairs are counted by score (combined before the
shuffle), and running sums over the distinct scores are taken range by range, so no task
holds all scores.  Metrics of the same pairs share the curve.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.ranges import quantiles, running
from sparkloom.plans.shared import is_small, written


def curve(pairs: DataFrame, *by: str, reuse: bool = False) -> DataFrame:
    """Distinct scores from the highest: genuine and impostor pairs at each (p, n), from there up (p_run, n_run), in all (p_all, n_all) and at the next."""
    counted = pairs.groupBy(*by, "score").agg(F.count_if("genuine").alias("p"), F.count_if(~F.col("genuine")).alias("n"))
    return running(counted, "score", ["p", "n"], by, descending=True, reuse=reuse)


def roc_curve(pairs: DataFrame, *by: str) -> DataFrame:
    """Distinct scores from the highest, with true and false accepts from there (tp, fp) and all (np, nn)."""
    return curve(pairs, *by).select(*by, "score", "p", "n", F.col("p_run").alias("tp"), F.col("n_run").alias("fp"), F.col("p_all").alias("np"), F.col("n_all").alias("nn"), "place")


def auc_of(c: DataFrame, *by: str) -> DataFrame:
    # Impostors below a genuine score count whole, equal ones half.
    won = F.sum(F.col("p") * ((F.col("n_all") - F.col("n_run")) + F.col("n") / 2.0))
    both = F.max(F.col("p_all") * F.col("n_all"))
    return c.groupBy(*by).agg(F.when(both > 0, won / both).otherwise(F.lit(float("nan"))).alias("roc_auc"))


def roc_auc(pairs: DataFrame, *by: str) -> DataFrame:
    """Area under the curve with ties at half; NaN if a class is missing."""
    return auc_of(curve(pairs, *by), *by)


def eer_of(c: DataFrame, *by: str) -> DataFrame:
    corner = (F.col("place") == 1) | F.col("p_next").isNull() | (F.col("p_next") != F.col("p")) | (F.col("n_next") != F.col("n"))
    kept = c.where(corner).select(*by, "score", "p_run", "n_run", "p_all", "n_all", "place")
    zero = F.lit(0).cast("long")
    start = c.where("place = 1").select(*by, F.lit(float("inf")).alias("score"), zero.alias("p_run"), zero.alias("n_run"), "p_all", "n_all", zero.alias("place"))
    points = kept.unionByName(start).where((F.col("p_all") > 0) & (F.col("n_all") > 0))
    fnr, fpr = 1 - F.col("p_run") / F.col("p_all"), F.col("n_run") / F.col("n_all")
    best = F.min_by(F.struct(((fpr + fnr) / 2).alias("eer"), F.col("score").alias("threshold")), F.struct(F.round(F.abs(fnr - fpr), 12), F.col("place")))
    return points.groupBy(*by).agg(best.alias("b")).select(*by, "b.eer", "b.threshold")


def equal_error_rate(pairs: DataFrame, *by: str) -> DataFrame:
    """The first point of least difference between false rejects and false accepts: eer, threshold.

    As in a curve without collinear points, a point between two steps of the same size and kind
    is left out; the curve starts at no accepts (threshold infinity).
    """
    return eer_of(curve(pairs, *by, reuse=True), *by)


def threshold_of(c: DataFrame, far: float, *by: str) -> DataFrame:
    up = F.col("n_all") - F.col("n_run") + F.col("n")  # impostors up to this score
    k = F.greatest(F.ceil(F.lit(1.0 - far) * F.col("n_all")), F.lit(1))
    return c.groupBy(*by).agg(F.coalesce(F.min(F.when((F.col("n_all") > 0) & (up >= k), F.col("score"))), F.lit(float("inf"))).alias("threshold"))


def threshold_at_far(pairs: DataFrame, far: float, *by: str) -> DataFrame:
    """The impostor score at place ceil((1 - far) * n) from the lowest; infinity without impostors."""
    return threshold_of(curve(pairs, *by), far, *by)


def at_threshold(counts: DataFrame, thresholds: DataFrame, *by: str) -> DataFrame:
    """tar and achieved_far at frozen thresholds ((by..., threshold), one row a group) of pairs (score, genuine), or of a curve."""
    if "genuine" in counts.columns:
        counts = counts.groupBy(*by, "score").agg(F.count_if("genuine").alias("p"), F.count_if(~F.col("genuine")).alias("n"))
    joined = counts.join(thresholds, list(by)) if by else counts.join(F.broadcast(thresholds.limit(1)))
    ok = F.col("score") >= F.col("threshold")
    share = lambda x: F.try_divide(F.coalesce(F.sum(F.when(ok, F.col(x))), F.lit(0)), F.sum(x))
    return joined.groupBy(*by).agg(share("p").alias("tar"), share("n").alias("achieved_far"), F.max("threshold").alias("threshold"), F.sum("p").alias("n_genuine"), F.sum("n").alias("n_impostor"))


def evaluate(pairs: DataFrame, far: float = 1e-3, threshold: DataFrame | None = None, *by: str) -> DataFrame:
    """All verification metrics of a pair set, from one curve; NaN where a class is missing."""
    c = curve(pairs, *by, reuse=True)
    at = at_threshold(c, threshold if threshold is not None else threshold_of(c, far, *by), *by)
    auc, eer = auc_of(c, *by), eer_of(c, *by).withColumnRenamed("threshold", "eer_threshold")
    one = F.lit(1)
    keys = list(by) or ["__one"]
    add = lambda d: d if by else d.withColumn("__one", one)
    out = add(at).join(add(auc), keys, "left").join(add(eer), keys, "left")
    gone = (F.col("n_genuine") == 0) | (F.col("n_impostor") == 0)
    nan = F.lit(float("nan"))
    for name in ("tar", "achieved_far", "threshold", "roc_auc", "eer"):
        out = out.withColumn(name, F.when(gone, nan).otherwise(F.col(name)))
    return out.select(*by, "roc_auc", "eer", "tar", "achieved_far", "threshold", F.lit(far).alias("far_target"), "n_genuine", "n_impostor")


def tar_linear(pairs: DataFrame, far: float = 1e-2, *by: str) -> DataFrame:
    """tar at the linearly interpolated (1 - far) quantile of impostor scores."""
    return at_threshold(pairs, quantiles(pairs.where(~F.col("genuine")), "score", {"threshold": 1 - far}, by), *by)


def frozen(val_pairs: DataFrame, test_pairs: DataFrame, far: float = 1e-3) -> DataFrame:
    """Test metrics at the threshold of validation pairs."""
    return evaluate(test_pairs, far, threshold_at_far(val_pairs, far))


def resampled(pairs: DataFrame, draws: int, seed: int = 0) -> DataFrame:
    """(draw, genuine, score, weight): genuine and impostor pairs drawn with replacement, each class on its own.

    Every pair is drawn a Poisson(1) number of times, by a hash of seed, draw and pair, which for many pairs
    is the bootstrap without a sequential generator; draw -1 is the pairs themselves.  pairs: (pair_id, score, genuine).
    """
    u = (F.conv(F.substring(F.sha1(F.concat_ws("|", F.lit(str(seed)), F.col("draw").cast("string"), F.col("pair_id").cast("string"))), 1, 12), 16, 10).cast("double") + 0.5) / 2.0**48
    # Cumulative probabilities of the Poisson distribution of mean 1.
    steps, p, total = [], math.exp(-1), 0.0
    for k in range(1, 16):
        total += p
        steps.append(total)
        p /= k
    weight = sum((F.when(u > x, 1).otherwise(0) for x in steps), F.lit(0))
    dealt = pairs.withColumn("draw", F.explode(F.sequence(F.lit(-1), F.lit(draws - 1))))
    return dealt.withColumn("weight", F.when(F.col("draw") < 0, 1).otherwise(weight)).where("weight > 0").select("draw", "genuine", "score", "weight")


def pair_intervals(pairs: DataFrame, far: float = 1e-2, draws: int = 1000, seed: int = 0, confidence: float = 0.95) -> DataFrame:
    """(metric, value, low, high) of roc_auc and tar at the linear quantile, whose threshold each draw takes anew.

    Draws are counted by score before they shuffle, so their size is draws x distinct scores.
    """
    counted = resampled(pairs, draws, seed).groupBy("draw", "score").agg(F.coalesce(F.sum(F.when(F.col("genuine"), F.col("weight"))), F.lit(0)).alias("p"), F.coalesce(F.sum(F.when(~F.col("genuine"), F.col("weight"))), F.lit(0)).alias("n"))
    c = running(counted, "score", ["p", "n"], ("draw",), descending=True, reuse=True)
    # The impostor at a rank r from the lowest: the least score up to which more than r stand.
    rank = F.lit(1.0 - far) * (F.col("n_all") - 1)
    value_at = lambda r: F.min(F.when(F.col("n_all") - F.col("n_run") + F.col("n") > r, F.col("score")))
    low, high, part = value_at(F.floor(rank)), value_at(F.ceil(rank)), F.max(rank - F.floor(rank))
    thr = c.groupBy("draw").agg((low + (high - low) * part).alias("threshold"))
    per = at_threshold(c, thr, "draw").select("draw", "tar").join(auc_of(c, "draw"), "draw")
    long = per.select("draw", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("roc_auc", "tar")])).alias("m")).select("draw", "m.*").where(~F.isnan("value"))
    edge = (1 - confidence) / 2
    point = long.where("draw < 0").select("metric", "value")
    ends = long.where("draw >= 0").groupBy("metric").agg(F.expr(f"percentile(value, {edge})").alias("low"), F.expr(f"percentile(value, {1 - edge})").alias("high"))  # draws rows
    return point.join(ends, "metric")


def stress_pairs(rows: DataFrame, scores, tier: int = 1) -> DataFrame:
    """Pairs of queries: genuine of one design, impostors of two designs in one palette (tier 2: and one non-empty family).

    rows: (id, design, palette, family, vec), one row an id.  The two kinds are two grids of matrix products: rows of one
    design; rows of one palette (and family), of which the pairs of one design are dropped.
    """
    from sparkloom.operators.similarity import pair_scores

    kind = dict(rows.dtypes)["id"]
    r = rows.where((F.coalesce("palette", F.lit("")) != "") & F.col("design").isNotNull())
    found = lambda df, *keys: pair_scores(df.select("id", "vec", *keys), df.select("id", "vec", *keys), id_type=kind, within=list(keys), once=True).select(F.col("q_id").alias("a_id"), F.col("g_id").alias("b_id"), "score")
    same = found(r, "design").withColumn("genuine", F.lit(True))
    other = found(r.where(F.col("family") != ""), "palette", "family") if tier == 2 else found(r, "palette")
    of = written(r.select("id", "design"), "designs")
    small = is_small(of)

    def side(p: str) -> DataFrame:
        named = of.select(F.col("id").alias(f"{p}_id"), F.col("design").alias(f"{p}_design"))
        return F.broadcast(named) if small else named

    other = other.join(side("a"), "a_id").join(side("b"), "b_id").where(F.col("a_design") != F.col("b_design")).withColumn("genuine", F.lit(False))
    return same.select("a_id", "b_id", "genuine", "score").unionByName(other.select("a_id", "b_id", "genuine", "score"))


def stress_report(pairs: DataFrame, threshold: DataFrame | None = None, tier: int = 1) -> DataFrame:
    """One row: tier, roc_auc, eer, false accepts at a threshold, margin, counts, and a note if a class is missing."""
    curve_of = curve(pairs, reuse=True)
    mean = lambda x: F.try_divide(F.sum(F.col("score") * F.col(x)), F.sum(x))
    sums = curve_of.agg(F.coalesce(F.sum("p"), F.lit(0)).alias("genuine"), F.coalesce(F.sum("n"), F.lit(0)).alias("impostor"), (mean("p") - mean("n")).alias("margin"))
    one = lambda d: d.withColumn("__one", F.lit(1))
    out = one(sums).join(one(auc_of(curve_of)), "__one", "left").join(one(eer_of(curve_of)).drop("threshold"), "__one", "left")
    if threshold is not None:
        out = out.join(one(at_threshold(curve_of, threshold).select(F.col("achieved_far").alias("fa"))), "__one", "left")
    else:
        out = out.withColumn("fa", F.lit(None).cast("double"))
    ok = (F.col("genuine") > 0) & (F.col("impostor") > 0)
    r = lambda c: F.when(ok, F.bround(c, 4))
    return out.select(F.lit(tier).alias("tier"), r("roc_auc").alias("roc_auc"), r("eer").alias("eer"), r("fa").alias("same_palette_false_accept_rate"), r("margin").alias("margin"), "genuine", "impostor", F.when(~ok, "no impostor pairs at this tier").alias("note"))
