"""Integrity constraints of a manifest: every check as (check_id, n_bad, message).

Checks that only count rows share one scan; those on groups and parents are one grouped
query or equi-join each.  All failures are reported, not only the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.schema import COLUMNS, ENUMS, NO_SEED
from sparkloom.plans.shared import written


def _row_checks(train_method: str) -> dict[str, tuple[Column, str]]:
    """Rows that break a rule by themselves."""
    c, synth = F.col, F.col("is_synthetic")
    out = {
        "CK-04": (synth & c("split").isin("val", "test") & (c("recolor_method") == train_method), "val/test rows use the TRAIN recolor method"),
        "CK-16": ((c("role") == "gallery") & synth, "gallery rows are synthetic"),
        "CK-17": ((c("role") == "gallery") & ~c("is_representative"), "the gallery holds images that represent no group"),
        "CK-18": (~c("is_representative") & ~synth & c("role").isin("gallery", "query"), "real images that represent no group are evaluated"),
        "CK-20": ((c("role") == "query") & (c("query_kind") == ""), "queries lack their kind"),
        "CK-21": ((c("role") != "query") & (c("query_kind") != ""), "a kind of query stands on other rows"),
        "CK-27": (~synth & (c("recolor_seed") != NO_SEED), "real images have a seed"),
        "CK-28": (~synth & (c("recolor_method") != ""), "real images have a method"),
        "CK-29": (synth & (c("recolor_seed") < 0), "synthetic images lack their seed"),
        "CK-30": (synth & (c("recolor_method") == ""), "synthetic images lack their method"),
        "CK-31": (synth & (c("parent_image_id") == ""), "synthetic images lack their parent"),
    }
    for k, (name, allowed) in zip(("CK-23", "CK-24", "CK-25", "CK-26"), ENUMS.items(), strict=True):
        out[k] = (~c(name).isin(*allowed), f"column '{name}' has values outside the contract")
    return out


def _counted(df: DataFrame, check: str, message: str) -> DataFrame:
    return df.agg(F.lit(check).alias("check_id"), F.count("*").alias("n_bad"), F.lit(message).alias("message"))


def report(df: DataFrame, label_map: DataFrame | None = None, *, train_method: str = "kmeans_palette_swap", files: DataFrame | None = None) -> DataFrame:
    """(check_id, n_bad, message) of every check; label_map: (design_id, label); files: (path) that exist.

    The manifest is written once, as every group of checks reads it.
    """
    in_order = df.columns == COLUMNS
    df = written(df, "manifest")
    rules = _row_checks(train_method)
    flat = df.agg(*[F.count_if(bad).alias(k) for k, (bad, _) in rules.items()], *[F.count_if(F.col("split") == s).alias(f"_{s}") for s in ("val", "test")])
    one = F.array(*[F.struct(F.lit(k).alias("check_id"), F.col(k).alias("n_bad"), F.lit(m).alias("message")) for k, (_, m) in rules.items()], F.struct(F.lit("CK-13").alias("check_id"), ((F.col("_val") == 0).cast("long") + (F.col("_test") == 0).cast("long")).alias("n_bad"), F.lit("no row is in val, or none in test").alias("message")))
    out = [flat.select(F.explode(one).alias("c")).select("c.*")]
    order = F.lit(0 if in_order else 1).cast("long")
    out.append(df.sparkSession.range(1).select(F.lit("CK-22").alias("check_id"), order.alias("n_bad"), F.lit("columns stand in another order").alias("message")))

    def spans(check: str, column: str, rows: DataFrame, message: str) -> None:
        out.append(_counted(rows.groupBy(column).agg(F.min("split").alias("a"), F.max("split").alias("b")).where("a <> b"), check, message))

    synth, real = df.where("is_synthetic"), df.where(~F.col("is_synthetic"))
    spans("CK-01", "design_id", df, "design_id(s) appear in more than one split")
    spans("CK-02", "dup_group", df, "dup_group(s) stand in several splits")
    spans("CK-05", "palette_id", synth.where("palette_id <> ''"), "palette_id(s) used in more than one split")

    parents = df.select(F.col("image_id").alias("parent_image_id"), *[F.col(c).alias(f"p_{c}") for c in ("split", "source", "design_id", "craft_family")])
    pairs = synth.join(parents, "parent_image_id", "left")
    found = F.col("p_split").isNotNull()
    checks = [("CK-03", "split", "synthetic images are split from their parent"), *[(f"CK-0{7 + k}", c, f"synthetic images differ from their parent in {c}") for k, c in enumerate(("source", "design_id", "craft_family"))]]
    got = pairs.agg(F.count_if(~found).alias("CK-06"), *[F.count_if(found & (F.col(c) != F.col(f"p_{c}"))).alias(k) for k, c, _ in checks])
    named = [("CK-06", "parents of synthetic images are absent"), *[(k, m) for k, _, m in checks]]
    out.append(got.select(F.explode(F.array(*[F.struct(F.lit(k).alias("check_id"), F.col(k).alias("n_bad"), F.lit(m).alias("message")) for k, m in named])).alias("c")).select("c.*"))

    for check, column in (("CK-10", "image_id"), ("CK-11", "path")):
        out.append(_counted(df.groupBy(column).agg(F.count("*").alias("n")).where("n > 1"), check, f"{column} is not unique"))
    out.append(_counted(real.groupBy("dup_group").agg(F.count_if("is_representative").alias("n")).where("n <> 1"), "CK-12", "dup_group(s) do not have exactly one representative"))
    per = df.where(F.col("split").isin("val", "test")).groupBy("split", "design_id").agg(F.count_if(F.col("role") == "gallery").alias("g"), F.count_if(F.col("role") == "query").alias("q"))
    two = per.agg(F.count_if(F.col("g") < 1).alias("a"), F.count_if(F.col("q") < 1).alias("b"))
    out.append(two.select(F.explode(F.array(F.struct(F.lit("CK-14").alias("check_id"), F.col("a").alias("n_bad"), F.lit("evaluated designs without a gallery image").alias("message")), F.struct(F.lit("CK-15").alias("check_id"), F.col("b").alias("n_bad"), F.lit("evaluated designs without a query").alias("message")))).alias("c")).select("c.*"))
    if label_map is not None:
        train = df.where("split = 'train'").select("design_id").distinct().withColumn("t", F.lit(True))
        both = train.join(label_map.select("design_id").distinct().withColumn("m", F.lit(True)), "design_id", "full")
        out.append(_counted(both.where("t IS NULL OR m IS NULL"), "CK-19", "label_map covers other designs than train has"))
    if files is not None:
        out.append(_counted(df.select("path").join(files.select("path"), "path", "left_anti"), "CK-32", "paths without a file"))
    every = out[0]
    for o in out[1:]:
        every = every.unionByName(o)
    return every


def require_valid(df: DataFrame, label_map: DataFrame | None = None, **more) -> None:
    """Raises with every failing check."""
    bad = report(df, label_map, **more).where("n_bad > 0").orderBy("check_id").collect()  # one row a check
    if bad:
        raise ValueError("; ".join(f"{r.check_id}: {r.n_bad} {r.message}" for r in bad))


def enum_violations(df: DataFrame) -> DataFrame:
    """(column, value, n) of values outside the contract."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value"), (~F.col(c).isin(*allowed)).alias("bad")) for c, allowed in ENUMS.items()]))
    return df.select(pairs.alias("p")).where("p.bad").groupBy("p.column", "p.value").agg(F.count("*").alias("n"))
