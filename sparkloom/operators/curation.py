"""From records to a split manifest: duplicates, identities, splits, roles and synthetic rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.ids import hash_rank_key, stable_image_id, stable_seed
from sparkloom.functions.strings import export_stem, is_generic
from sparkloom.operators.components import connected_components
from sparkloom.operators.schema import NO_SEED
from sparkloom.operators.similarity import hamming_pairs, near_edges, pair_scores
from sparkloom.plans.shared import dealt_join, is_small, written

#: Fixed value: an aligned overlap from which a verified pair shows the same pixels.
DUP_OVERLAP_MIN, DUP_NCC_MIN = 0.85, 0.95


def union_sources(frames: list[DataFrame], limit_source: int | None = None) -> DataFrame:
    """Records of all enabled sources; at most so many of each, first by path."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    if limit_source is None:
        return out
    return out.withColumn("_n", F.row_number().over(Window.partitionBy("source").orderBy("path"))).where(F.col("_n") <= limit_source).drop("_n")


def duplicate_groups(rows: DataFrame, most: int = 4, mode: str = "banded") -> DataFrame:
    """(id, component) of every row by pairs of near hashes; rows: (id, h)."""
    return connected_components(near_edges(rows, most, mode), "i", "j", rows.select("id"))


def cluster_stats(rows: DataFrame, thresholds: tuple[int, ...] = (0, 2, 4, 6, 8), mode: str = "banded") -> DataFrame:
    """(threshold, n_clusters, n_multi, largest): one pair join at the largest threshold, components at each."""
    pairs = near_edges(rows, max(thresholds), mode)
    out = None
    for t in thresholds:
        sizes = connected_components(pairs.where(F.col("distance") <= t), "i", "j", rows.select("id")).groupBy("component").agg(F.count("*").alias("n"))
        one = sizes.agg(F.lit(t).alias("threshold"), F.count("*").alias("n_clusters"), F.count_if(F.col("n") > 1).alias("n_multi"), F.max("n").alias("largest"))
        out = one if out is None else out.unionByName(one)
    return out


def representatives(rows: DataFrame, group: str = "dup_group", score: str = "score", path: str = "path", id_col: str = "id") -> DataFrame:
    """(group, representative): the least noisy member, of equals the first by path."""
    return rows.groupBy(group).agg(F.min_by(id_col, F.struct(score, path)).alias("representative"))


def merge_groups(groups: DataFrame, verified: DataFrame) -> DataFrame:
    """(dup_group, merged): groups whose members show the same pixels become one, the smallest; verified: (a, b, overlap, ncc) of groups."""
    same = verified.where(~F.isnan("overlap") & ~F.isnan("ncc") & (F.col("overlap") >= DUP_OVERLAP_MIN) & (F.col("ncc") >= DUP_NCC_MIN))
    return connected_components(same, "a", "b", groups.select(F.col("dup_group").alias("id"))).select(F.col("id").alias("dup_group"), F.col("component").alias("merged"))


def numbered(components: DataFrame, prefix: str, width: int = 5) -> DataFrame:
    """Adds name ``prefix_d00000`` in the order of components."""
    from sparkloom.operators.schema import with_index

    names = with_index(components.select("component").distinct(), "component", "_k")
    return components.join(names.select("component", F.format_string(f"{prefix}_d%0{width}d", "_k").alias("name")), "component")


def candidates(knn: DataFrame, hashed: DataFrame, budget: int | None = None) -> DataFrame:
    """Pairs to verify in order of promise: neighbours by score, hash pairs 1.0 where they aren't neighbours; the first ``budget``.

    A count bounds the work where a clock would make results depend on the machine.
    """
    both = knn.select("i", "j", F.col("score").alias("prior"), F.lit(0).alias("k")).unionByName(hashed.select("i", "j", F.lit(1.0).alias("prior"), F.lit(1).alias("k")))
    one = both.groupBy("i", "j").agg(F.min_by("prior", "k").alias("prior"))
    order = [F.desc(F.coalesce("prior", F.lit(0.0))), "i", "j"]
    return one.orderBy(*order).limit(budget) if budget is not None else one


def group_designs(rows: DataFrame, verify, *, k: int = 8, most: int = 4, budget: int | None = None, all_pairs_up_to: int = 20_000, id_type: str = "long") -> tuple[DataFrame, DataFrame]:
    """(labels, edges): components of verified candidate pairs; rows: (id, vec, h).

    verify maps candidate pairs (i, j) to accepted edges (``pixels.pair_verifier`` makes one).  Inputs of up to
    ``all_pairs_up_to`` pairs try all of them, larger ones neighbours and near hashes.
    """
    from sparkloom.operators.similarity import knn_pairs

    n = rows.count()
    if n * (n - 1) // 2 <= all_pairs_up_to:
        every = pair_scores(rows.select("id", "vec"), rows.select("id", "vec"), id_type=id_type).where(F.col("q_id") < F.col("g_id"))
        tried = every.select(F.col("q_id").alias("i"), F.col("g_id").alias("j"))
    else:
        tried = candidates(knn_pairs(rows.select("id", "vec"), k, id_type), hamming_pairs(rows.select("id", "h"), most), budget)
    edges = written(verify(tried), "verified")
    return connected_components(edges, "i", "j", rows.select("id")), edges


def majority(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, contradiction): the most frequent value, of equals the smallest; empty texts count as values."""
    n = rows.groupBy(key, value).agg(F.count("*").alias("n"))
    return n.groupBy(key).agg(F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias(value), (F.count("*") > 1).alias("contradiction"))


def rollup_designs(rows: DataFrame) -> DataFrame:
    """(design_id, source, craft_family, n_images, n_views): those of the first row by path; a design of several views holds several duplicate groups."""
    return rows.groupBy("design_id").agg(F.min_by("source", "path").alias("source"), F.min_by("craft_family", "path").alias("craft_family"), F.count("*").alias("n_images"), F.count_distinct("dup_group").alias("n_views"))


def prefix_constraints(designs: DataFrame, names: DataFrame, cosine_min: float = 0.93, least: int = 5) -> DataFrame:
    """(i, j, score, shared): pairs of designs that are similar and share a distinctive name prefix.

    designs: (id, vec); names: (id, path) of all members.  Names are only compared for pairs that are similar.
    """
    similar = written(pair_scores(designs, designs, cosine_min).where(F.col("q_id") < F.col("g_id")), "similar")
    stem = export_stem(F.col("path"))
    stems = names.select("id", stem.alias("stem")).where(~is_generic(F.col("stem")))
    # Two designs' longest shared prefix is the longest that stands in both sets of prefixes: as many rows as characters, where pairs of names would be a product.
    n = F.length("stem")
    begins = F.when(n >= least, F.transform(F.sequence(F.lit(max(least, 0)), n), lambda k: F.substring("stem", F.lit(1), k)))
    prefixes = written(stems.select("id", F.explode(begins).alias("prefix")).distinct(), "prefixes")
    side = lambda c: prefixes.select(F.col("id").alias(c), "prefix")
    one = side("q_id").join(F.broadcast(similar), "q_id") if is_small(similar) else dealt_join(similar, side("q_id"), ["q_id"], "g_id")
    both = one.join(side("g_id"), ["g_id", "prefix"])
    return both.groupBy(F.col("q_id").alias("i"), F.col("g_id").alias("j")).agg(F.max("score").alias("score"), F.max(F.length("prefix")).alias("shared"))


def split_groups(designs: DataFrame, constraints: DataFrame) -> DataFrame:
    """(design_id, split_group): designs that a constraint (i, j) links, over any number of links, are one group, named by its smallest."""
    return connected_components(constraints, "i", "j", designs.select(F.col("design_id").alias("id"))).select(F.col("id").alias("design_id"), F.col("component").alias("split_group"))


def assign_grouped_splits(designs: DataFrame, constraints: DataFrame, **more) -> DataFrame:
    """(design_id, split): as ``assign_splits``, but linked designs never straddle a split.

    designs: (design_id, source, craft_family, forced); constraints: (i, j) of design ids.  Groups are split, with
    the source and family of their first design; a group with a forced design is forced.
    """
    groups = split_groups(designs, constraints)
    of = designs.join(groups, "design_id").groupBy("split_group").agg(F.min_by("source", "design_id").alias("source"), F.min_by("craft_family", "design_id").alias("craft_family"), F.max("forced").alias("forced"))
    return groups.join(assign_splits(of.withColumnRenamed("split_group", "design_id"), **more).withColumnRenamed("design_id", "split_group"), "split_group").select("design_id", "split")


def straddling(splits: DataFrame, constraints: DataFrame) -> DataFrame:
    """Constraints (i, j) whose designs sit in different splits."""
    side = lambda c: splits.select(F.col("design_id").alias(c), F.col("split").alias(f"split_{c}"))
    return constraints.select("i", "j").join(side("i"), "i").join(side("j"), "j").where("split_i <> split_j")


def assign_splits(designs: DataFrame, *, seed: int = 42, val_frac: float = 0.15, test_frac: float = 0.2, per_source_test_frac: dict[str, float] | None = None) -> DataFrame:
    """(design_id, split): quotas within (source, craft_family); forced designs are test and count towards the quota.

    designs: (design_id, source, craft_family, forced).  Free designs are drawn by a hash of seed
    and id: one more design moves at most the borders.  Targets round half to even.
    """
    frac = F.lit(test_frac)
    for s, f in sorted((per_source_test_frac or {}).items()):
        frac = F.when(F.col("source") == s, F.lit(f)).otherwise(frac)
    stratum = Window.partitionBy("source", "craft_family")
    d = designs.select("design_id", "source", "craft_family", "forced", hash_rank_key(seed, "design_id").alias("_key"))
    d = d.withColumn("_n", F.count("*").over(stratum)).withColumn("_have", F.count_if("forced").over(stratum))
    d = d.withColumn("_rank", F.row_number().over(Window.partitionBy("source", "craft_family", "forced").orderBy("_key", "design_id")))
    free = F.col("_n") - F.col("_have")
    test_more = F.greatest(F.lit(0), F.least(F.rint(frac * F.col("_n")) - F.col("_have"), free))
    val = F.greatest(F.lit(0), F.least(F.rint(F.lit(val_frac) * F.col("_n")), free - test_more))
    split = F.when(F.col("forced") | (F.col("_rank") <= test_more), "test").when(F.col("_rank") <= test_more + val, "val").otherwise("train")
    return d.select("design_id", split.alias("split"))


def assign_roles(rows: DataFrame) -> DataFrame:
    """role and query_kind: in val and test each design's first representative by path is the gallery, the others are queries; all else trains."""
    place = F.row_number().over(Window.partitionBy("design_id", "is_representative").orderBy("path"))
    used = F.col("split").isin("val", "test") & F.col("is_representative")
    r = rows.withColumn("_k", place)
    role = F.when(used & (F.col("_k") == 1), "gallery").when(used, "query").otherwise("train")
    return r.withColumn("role", role).withColumn("query_kind", F.when(F.col("role") == "query", "real_view").otherwise("")).drop("_k")


def synthetic_rows(rows: DataFrame, *, methods: dict[str, str], palettes: dict[str, list[str]], n_recolor: int = 5, n_tonal: int = 5, tonal_method: str = "tonal_remap") -> DataFrame:
    """Planned synthetic queries of val and test: per gallery row n recolours and n tonal ones, per further view one recolour.

    Seeds are hashes of parent, kind and number; identity, split and source come from the parent.
    """
    real = rows.where(F.col("split").isin("val", "test") & F.col("role").isin("gallery", "query") & ~F.col("is_synthetic"))
    view = F.row_number().over(Window.partitionBy("design_id").orderBy("path")) - 2
    number = lambda n: F.sequence(F.lit(0), F.lit(n - 1)) if n else F.array().cast("array<int>")
    plan = real.withColumn("_view", view)
    kinds = F.when(
        F.col("role") == "gallery",
        F.concat(F.transform(number(n_recolor), lambda q: F.struct(F.lit("synthetic_recolor").alias("kind"), q.alias("q"))), F.transform(number(n_tonal), lambda q: F.struct(F.lit("synthetic_tonal").alias("kind"), q.alias("q")))),
    ).otherwise(F.array(F.struct(F.lit("real_view_recolored").alias("kind"), F.col("_view").cast("int").alias("q"))))
    plan = plan.withColumn("_p", F.explode(kinds))
    seed = stable_seed("image_id", F.col("_p.kind"), F.col("_p.q").cast("string"))
    pool = F.lit(None).cast("array<string>")
    method = F.lit(None).cast("string")
    for s in sorted(methods):
        pool = F.when(F.col("split") == s, F.array(*[F.lit(p) for p in palettes[s]])).otherwise(pool)
        method = F.when(F.col("split") == s, F.lit(methods[s])).otherwise(method)
    out = plan.withColumn("recolor_seed", seed).withColumn("recolor_method", F.when(F.col("_p.kind") == "synthetic_tonal", tonal_method).otherwise(method))
    out = out.withColumn("palette_id", F.get(pool, (F.col("recolor_seed") % F.size(pool)).cast("int")))
    out = out.withColumn("parent_image_id", F.col("image_id"))
    stem = F.regexp_replace(F.regexp_extract("path", "[^/]*$", 0), r"\.[^.]*$", "")
    path = F.concat_ws("/", F.lit("synthetic"), "split", "design_id", F.concat_ws("_", stem, "palette_id", F.col("recolor_seed").cast("string"), F.concat(F.col("_p.kind"), F.lit(".jpg"))))
    out = out.withColumn("path", path).withColumn("image_id", stable_image_id(F.col("path")))
    out = out.withColumns({"role": F.lit("query"), "query_kind": F.col("_p.kind"), "is_synthetic": F.lit(True), "is_representative": F.lit(False), "colorway_id": F.col("palette_id"), "phash": F.lit("")})
    return out.drop("_p", "_view")


def demote(rows: DataFrame) -> DataFrame:
    """Real rows that represent no group only train."""
    idle = ~F.col("is_representative") & ~F.col("is_synthetic") & F.col("role").isin("gallery", "query")
    return rows.withColumn("role", F.when(idle, "train").otherwise(F.col("role")))


def real_defaults(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"is_synthetic": F.lit(False), "recolor_method": F.lit(""), "palette_id": F.lit(""), "recolor_seed": F.lit(NO_SEED).cast("long"), "parent_image_id": F.lit(""), "colorway_id": F.lit("")})


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement, those first by a hash of seed and key."""
    return rows.orderBy(hash_rank_key(seed, F.col(key).cast("string")), key).limit(n)


def first_designs(rows: DataFrame, n: int) -> DataFrame:
    """Rows of the first n designs by id (a smoke subset)."""
    return rows.join(F.broadcast(rows.select("design_id").distinct().orderBy("design_id").limit(n)), "design_id", "left_semi")


def pk_batches(designs: DataFrame, p: int, batches: int, seed: int = 42, epoch: int = 0) -> DataFrame:
    """(batch, design_id, place): p different designs for each batch, by a hash of seed, epoch and batch.

    Each batch takes its p smallest of all hashes; only p rows of a batch pass a partition.
    """
    d = designs.select("design_id").distinct().withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(batches - 1))))
    key = F.sha1(F.concat_ws("|", F.lit(str(seed)), F.lit(str(epoch)), F.col("batch").cast("string"), "design_id"))
    return d.withColumn("place", F.row_number().over(Window.partitionBy("batch").orderBy(key))).where(F.col("place") <= p)


def palette_groups(batches: DataFrame, palettes: list[str], *, prob: float = 0.3, size: int = 4, seed: int = 42) -> DataFrame:
    """(batch, design_id, palette_id): in a share of the batches some designs are pinned to one palette, all by hashes of seed and batch.

    batches: (batch, design_id).  Without palettes, or for batches of one design, nothing is pinned.
    """
    unit = lambda *parts: F.conv(F.substring(F.sha1(F.concat_ws("|", F.lit(str(seed)), *parts)), 1, 8), 16, 10).cast("bigint")
    b = F.col("batch").cast("string")
    place = F.row_number().over(Window.partitionBy("batch").orderBy(F.sha1(F.concat_ws("|", F.lit(str(seed)), F.lit("pick"), b, "design_id")), "design_id"))
    n = F.count("*").over(Window.partitionBy("batch"))
    pool = F.array(*[F.lit(p) for p in palettes]).cast("array<string>")
    chosen = batches.select("batch", "design_id").withColumns({"_k": place, "_n": n}).where((F.col("_n") >= 2) & (F.col("_k") <= size) & (unit(F.lit("draw"), b) < prob * 2.0**32))
    return chosen.select("batch", "design_id", F.get(pool, (unit(F.lit("palette"), b) % max(len(palettes), 1)).cast("int")).alias("palette_id")).where("palette_id IS NOT NULL")


def check_pools(pools: DataFrame) -> DataFrame:
    """(palette_id, n) of palettes in more than one pool; pools: (pool, palette_id)."""
    return pools.groupBy("palette_id").agg(F.count_distinct("pool").alias("n")).where("n > 1")


def cache_paths(manifest: DataFrame) -> DataFrame:
    """(path): images that training and its validation read: real train rows and the val gallery, once each."""
    wanted = (~F.col("is_synthetic") & (F.col("split") == "train")) | ((F.col("split") == "val") & (F.col("role") == "gallery"))
    return manifest.where(wanted).select("path").distinct()


def sampled_pairs(rows: DataFrame, n: int, seed: int = 0, id_col: str = "id") -> DataFrame:
    """(k, i, j): at most n different unordered pairs of rows, in the order of their draw.

    Draw k takes two places by hashes of seed and k, so any part of the sample can be made apart; n draws are
    made a second time over as spares for those that repeat or hit one row twice.  Few rows give all their pairs.
    """
    from sparkloom.operators.schema import with_index

    placed = written(with_index(rows.select(id_col).distinct(), id_col, "place"), "placed")
    m = placed.count()
    if m * (m - 1) // 2 <= 2 * n:
        a, b = placed.select(F.col(id_col).alias("i"), F.col("place").alias("p")), placed.select(F.col(id_col).alias("j"), F.col("place").alias("q"))
        every = a.join(F.broadcast(b), F.col("p") < F.col("q"))
        order = Window.orderBy(F.sha1(F.concat_ws("|", F.lit(str(seed)), F.col("p").cast("string"), F.col("q").cast("string"))))
        return every.withColumn("k", (F.row_number().over(order) - 1).cast("long")).where(F.col("k") < n).select("k", "i", "j")  # 2 n rows at most
    draw = lambda tag: F.conv(F.substring(F.sha1(F.concat_ws("|", F.lit(str(seed)), F.lit(tag), F.col("id").cast("string"))), 1, 15), 16, 10).cast("bigint")
    drawn = rows.sparkSession.range(2 * n).select(F.col("id").alias("k"), (draw("a") % m).alias("x"), (draw("b") % (m - 1)).alias("y"))
    drawn = drawn.withColumn("y", F.when(F.col("y") >= F.col("x"), F.col("y") + 1).otherwise(F.col("y"))).groupBy(F.least("x", "y").alias("p"), F.greatest("x", "y").alias("q")).agg(F.min("k").alias("k")).orderBy("k").limit(n)
    return drawn.join(placed.select(F.col(id_col).alias("i"), F.col("place").alias("p")), "p").join(placed.select(F.col(id_col).alias("j"), F.col("place").alias("q")), "q").select("k", "i", "j")


def first_seen(rows: DataFrame, key: str, order: str) -> DataFrame:
    """(key, order) of each key at its first place: distinct keys that keep their order."""
    return rows.groupBy(key).agg(F.min(order).alias(order))
