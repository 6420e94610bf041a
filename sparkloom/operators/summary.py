"""Aggregates of manifests and file collections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.strings import depth, file_stem, parent_key, suffix
from sparkloom.operators.ranges import running


def split_summary(df: DataFrame) -> DataFrame:
    synth = F.col("is_synthetic")
    return df.groupBy("source", "split").agg(F.count_distinct("design_id").alias("designs"), F.count_if(~synth).alias("real"), F.count_if(synth).alias("synthetic"), F.count_if(F.col("role") == "gallery").alias("gallery"), F.count_if(F.col("role") == "query").alias("queries"))


def family_pivot(designs: DataFrame, splits=("test", "train", "val")) -> DataFrame:
    """Designs of each family in each split."""
    return designs.groupBy("craft_family").pivot("split", list(splits)).agg(F.count(F.lit(1))).na.fill(0)


def size_histogram(df: DataFrame, group: str) -> DataFrame:
    return df.groupBy(group).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n_groups"))


def query_composition(df: DataFrame) -> DataFrame:
    return df.where("role = 'query'").groupBy("split", "query_kind").agg(F.count("*").alias("n"))


def spanning(df: DataFrame, group: str, column: str) -> DataFrame:
    """Groups with several values of a column."""
    return df.groupBy(group).agg(F.count_distinct(column).alias("n")).where("n > 1")


def suffix_counts(df: DataFrame, path: str = "path") -> DataFrame:
    return df.groupBy(suffix(F.col(path)).alias("suffix")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "suffix")


def dir_tree(df: DataFrame, path: str = "path", most: int = 3) -> DataFrame:
    """(depth, dir, n_files, n_dirs) of directories down to a depth: files anywhere below, directories right below."""
    parts = F.split(F.col(path), "/")
    up = df.select(parts.alias("p"), F.explode(F.sequence(F.lit(0), F.least(F.lit(most), F.size(parts) - 1))).alias("depth"))
    at = up.select("depth", F.array_join(F.slice("p", 1, F.col("depth")), "/").alias("dir"), F.when(F.size("p") - 1 > F.col("depth"), F.get("p", F.col("depth"))).alias("sub"))
    return at.groupBy("depth", "dir").agg(F.count("*").alias("n_files"), F.count_distinct("sub").alias("n_dirs"))


def size_stats(df: DataFrame, small: int = 224) -> DataFrame:
    """min, median, mean and max of width, height and aspect, and rows with a small side."""
    out = []
    for c, x in (("width", F.col("width")), ("height", F.col("height")), ("aspect", F.col("width") / F.nullif(F.col("height"), F.lit(0)))):
        out += [F.min(x).alias(f"{c}_min"), F.median(x).alias(f"{c}_median"), F.avg(x).alias(f"{c}_mean"), F.max(x).alias(f"{c}_max")]
    return df.agg(*out, F.count_if(F.least("width", "height") < small).alias("n_small"))


def order_stat(df: DataFrame, value: str, shares: tuple[float, ...], *by: str) -> DataFrame:
    """Values at place int(share * n) (from 0) of the sorted values: neither of SQL's two percentiles."""
    c = running(df.groupBy(*by, value).agg(F.count("*").alias("c")), value, ["c"], by)
    at = lambda p: F.min(F.when(F.col("c_run") > F.least(F.floor(F.lit(p) * F.col("c_all")), F.col("c_all") - 1), F.col(value)))
    return c.groupBy(*by).agg(*[at(p).alias(f"p{round(p * 100)}") for p in shares], F.max("c_all").alias("n"))


def depths(df: DataFrame, path: str = "path") -> DataFrame:
    return df.groupBy(depth(F.col(path)).alias("depth")).agg(F.count("*").alias("n"))


def group_sizes(df: DataFrame, group: str) -> DataFrame:
    """(group, n, min, median and max of the longest side, median bytes); df: (group, width, height, length)."""
    side = F.greatest("width", "height")
    return df.groupBy(group).agg(F.count("*").alias("n"), F.min(side).alias("side_min"), F.median(side).alias("side_median"), F.max(side).alias("side_max"), F.median("length").alias("bytes_median"))


def shared_ids(df: DataFrame, first: str, second: str, path: str = "path") -> DataFrame:
    """(id) of stems that occur both as ``<first><id>`` and as ``<second><id>``."""
    stem = file_stem(F.col(path))
    of = lambda p: df.where(F.startswith(stem, F.lit(p))).select(F.substring(stem, len(p) + 1, 1 << 30).alias("id"))
    return of(first).intersect(of(second))


def build_counts(manifest: DataFrame, constraints: DataFrame) -> DataFrame:
    """(name, n) of what a build is recognised by: designs, designs of several views and duplicate groups by source, constraints, synthetic rows, train designs."""
    real = manifest.where(~F.col("is_synthetic"))
    per = real.groupBy("source", "design_id").agg(F.count_distinct("dup_group").alias("v"))
    out = per.groupBy("source").agg(F.count("*").alias("designs"), F.count_if(F.col("v") > 1).alias("multi")).join(real.groupBy("source").agg(F.count_distinct("dup_group").alias("groups")), "source")
    each = out.select(F.explode(F.array(*[F.struct(F.concat("source", F.lit(f".{k}")).alias("name"), F.col(k).alias("n")) for k in ("designs", "multi", "groups")])).alias("c")).select("c.*")
    one = lambda df, name: df.agg(F.lit(name).alias("name"), F.count("*").alias("n"))
    return each.unionByName(one(constraints, "constraining_pairs")).unionByName(one(manifest.where("is_synthetic"), "synthetic")).unionByName(one(real.where("split = 'train'").select("design_id").distinct(), "train_designs"))


def count_mismatches(counts: DataFrame, expected: DataFrame) -> DataFrame:
    """(name, n, expected) of counts (name, n) that differ from the expected ones, absent ones as null."""
    return counts.join(expected.select("name", F.col("n").alias("expected")), "name", "full").where(~F.col("n").eqNullSafe(F.col("expected")))


def path_facts(df: DataFrame, path: str = "path") -> DataFrame:
    """One row: files, depths, different directories, and files whose path holds each kind of separator."""
    p, d = F.col(path), depth(F.col(path))
    has = lambda c, name: F.count_if(F.instr(file_stem(p), c) > 0).alias(name)
    return df.agg(F.count(path).alias("n"), F.min(d).alias("depth_min"), F.max(d).alias("depth_max"), F.count_distinct(parent_key(p)).alias("n_dirs"), has("_", "underscores"), has("-", "hyphens"), has(" ", "spaces"), has(".", "dots"))
