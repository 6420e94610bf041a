"""Similarity joins of vectors: a grid of matrix products, and Hamming joins by multi-index hashing.

The queries are cut into rows of a grid, the gallery into its columns; a cell holds its
part of the queries and streams its part of the gallery past it, block by block, as
NumPy products.  A vector is sent once for each cell it meets, so with HELD rows held
a join of n and m vectors shuffles about n * m / HELD vectors, and no nested-loop join runs.
Scores are rounded to 9 decimals before they are compared, so that ties are ties on any
machine; equal scores go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.vectors import hamming, normalise
from sparkloom.plans.shared import by_rows, dealt_join, join_by_size, written

#: Rows of a block, and rows of queries that a cell holds (32 MB of 128 numbers each with their scores of a block).
BLOCK, HELD = 512, 16_384
DECIMALS = 9
#: Hashes that a task holds, and rows of a block of them (8 MB and 32 KB).
HASHES, HASH_BLOCK = 1 << 20, 4_096
#: Turned keys of a hash's part at most, bits of a part up to which its keys are looked up in a table, and candidates compared at once.
MAX_MASKS, TABLE_BITS, CANDIDATES = 20_000, 22, 1 << 20


def _packed(df: DataFrame, role: int, blocks: int, lane: Column, within: list[str]) -> DataFrame:
    """Rows dealt by a hash of their id into blocks of about BLOCK: lane, block, ids, vectors (normalised, end to end)."""
    unit = df.select(*within, "id", normalise("vec").alias("vec"))
    dealt = unit.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    rows = dealt.groupBy(*within, "block").agg(F.sort_array(F.collect_list(F.struct("id", "vec"))).alias("rows"))
    return rows.select(*within, lane.alias("lane"), F.lit(role).alias("role"), "block", F.col("rows.id").alias("ids"), F.flatten(F.col("rows.vec")).alias("flat"))


def _grid(queries: DataFrame, gallery: DataFrame, make: Callable, schema: str, within: list[str]) -> DataFrame:
    """Runs make(held, blocks) in every cell: the queries' (ids, vectors), and the gallery's blocks.  A group of ``within`` has cells of its own."""
    spark = queries.sparkSession
    # Of each side the rows of the largest group of ``within``, whose blocks have BLOCK rows at most on average, the groups, which share the tasks, and all rows.
    sizes = [df.groupBy(*within).agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)), F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first() for df in (queries, gallery)]
    (n, groups, rows_in_all), m = sizes[0], sizes[1][0]
    q_blocks, g_blocks = max(1, -(-n // BLOCK)), max(1, -(-m // BLOCK))
    across = max(1, -(-n // HELD))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows_in_all // HELD))
    along = max(1, min(g_blocks, -(-tasks // (across * max(1, groups)))))
    q = _packed(queries, 0, q_blocks, F.pmod(F.col("block"), F.lit(across)), within).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(along - 1))))
    g = _packed(gallery, 1, g_blocks, F.pmod(F.col("block"), F.lit(along)), within).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
    cell = lambda df, a, b: df.select(F.xxhash64(*within, F.col(a), F.col(b)).alias("cell"), "role", "block", "ids", "flat")
    dealt = cell(q, "lane", "other").unionByName(cell(g, "other", "lane")).repartition(tasks, "cell").sortWithinPartitions("cell", "role", "block")

    def matrix(b: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
        ids = b.column(3)[k].values
        return ids.to_numpy(zero_copy_only=False), b.column(4)[k].values.to_numpy().reshape(len(ids), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                for k in range(b.num_rows):
                    yield b.column(0)[k].as_py(), b.column(1)[k].as_py(), matrix(b, k)

        at, held, blocks = None, [], []

        def flush():
            if held and blocks:
                ids = np.concatenate([i for i, _ in held])
                yield from make((ids, np.concatenate([v for _, v in held])), blocks)

        for c, role, block in rows():
            if c != at:
                yield from flush()
                at, held, blocks = c, [], []
            if role == 0:
                held.append(block)
            else:
                blocks.append(block)
                if sum(len(i) for i, _ in blocks) >= HELD:  # the gallery's part passes in pieces
                    yield from flush()
                    blocks = []
        yield from flush()

    return dealt.mapInArrow(run, schema)


def _table(ids: np.ndarray, others: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    column = lambda x: pa.array(x, pa.string() if x.dtype == object else None)
    return pa.RecordBatch.from_arrays([column(ids), column(others), pa.array(score)], names=["q_id", "g_id", "score"])


def pair_scores(queries: DataFrame, gallery: DataFrame, least: float | None = None, id_type: str = "long", *, within: list[str] | None = None, mask: DataFrame | None = None, once: bool = False) -> DataFrame:
    """(q_id, g_id, score) cosine of every query and gallery row (of those from ``least``); both: (id, vec).

    within: columns that a pair must share; only such pairs are scored.  mask: (q_id, g_id) of the pairs to keep.
    once: only pairs with q_id < g_id.
    """

    def make(held, blocks):
        qi, q = held
        for gi, g in blocks:
            for a in range(0, len(qi), BLOCK):
                s = np.round(q[a : a + BLOCK] @ g.T, DECIMALS)
                kept = s >= least if least is not None else np.ones(s.shape, bool)
                if once:
                    kept &= qi[a : a + BLOCK, None] < gi[None, :]
                i, j = np.nonzero(kept)
                yield _table(qi[a + i], gi[j], s[i, j])

    out = _grid(queries, gallery, make, f"q_id {id_type}, g_id {id_type}, score double", within or [])
    return out if mask is None else out.join(mask.select("q_id", "g_id").distinct(), ["q_id", "g_id"], "left_semi")


def top_k(queries: DataFrame, gallery: DataFrame, k: int, *, exclude_self: bool = False, id_type: str = "long", within: list[str] | None = None) -> DataFrame:
    """(q_id, g_id, score, rank) of the k best; a piece of a cell only passes on its own best k for each query."""

    def make(held, blocks):
        qi, q = held
        gi, g = np.concatenate([i for i, _ in blocks]), np.concatenate([v for _, v in blocks])
        order = np.argsort(gi, kind="stable")
        gi, g = gi[order], g[order]
        for a in range(0, len(qi), BLOCK):
            own = qi[a : a + BLOCK]
            s = np.round(q[a : a + BLOCK] @ g.T, DECIMALS)
            if exclude_self:
                s[own[:, None] == gi[None, :]] = -np.inf
            # All that reach the kth best, then the first k of them by score and id.
            i, j = np.nonzero(s >= np.partition(s, -k, 1)[:, -k, None]) if s.shape[1] > k else np.indices(s.shape).reshape(2, -1)
            best = np.lexsort((j, -s[i, j], i))
            i, j = i[best], j[best]
            ok = (np.arange(len(i)) - np.searchsorted(i, i) < k) & np.isfinite(s[i, j])
            i, j = i[ok], j[ok]
            yield _table(own[i], gi[j], s[i, j])

    found = _grid(queries, gallery, make, f"q_id {id_type}, g_id {id_type}, score double", within or [])
    rank = F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("score"), "g_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def knn_pairs(rows: DataFrame, k: int, id_type: str = "long") -> DataFrame:
    """Undirected pairs (i < j) of each row and its k nearest others, with their score."""
    found = top_k(rows, rows, k, exclude_self=True, id_type=id_type)
    return found.groupBy(F.least("q_id", "g_id").alias("i"), F.greatest("q_id", "g_id").alias("j")).agg(F.max("score").alias("score"))


def _flips(width: int, most: int) -> list[int]:
    """Masks of a number of so many bits with at most so many set."""
    return [sum(1 << p for p in places) for k in range(min(width, most) + 1) for places in combinations(range(width), k)]


def index_plan(rows: int, most: int) -> tuple[tuple[int, int, int], ...]:
    """Parts (lowest bit, width, radius) into which hashes are cut, for hashes with at most ``most`` different bits.

    The radii and the number of parts add up to more than ``most``, so of two such hashes some part differs in no more
    bits than its radius.  Chosen for the least time: keys looked up and, for evenly spread hashes, rows met.
    """
    best = None
    for parts in range(1, min(most + 1, 64) + 1):
        edges, (radius, more) = [64 * k // parts for k in range(parts + 1)], divmod(max(most + 1 - parts, 0), parts)
        plan = tuple((a, b - a, radius + (k < more)) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)))
        keys = [sum(comb(w, k) for k in range(min(w, r) + 1)) for _, w, r in plan]
        if max(keys) > MAX_MASKS:
            continue
        cost = sum(rows * n * (1 if w <= TABLE_BITS else 20) + 2 * rows * rows * n / 2.0**w for n, (_, w, _) in zip(keys, plan, strict=True))
        if best is None or cost < best[0]:
            best = (cost, plan)
    return best[1]


def _links_of(q: np.ndarray, g: np.ndarray, plan: tuple[tuple[int, int, int], ...], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Different hashes of q and g (uint64) with at most ``most`` different bits; of a pair that stands in both, in either order, only one order is met."""
    cut = lambda x, low, width: (x >> np.uint64(low)) & np.uint64(2**width - 1)
    for k, (low, width, radius) in enumerate(plan):
        key = cut(g, low, width)
        order = np.argsort(key, kind="stable")
        key, of, own = key[order], g[order], cut(q, low, width)
        table = np.searchsorted(key, np.arange(2**width + 1, dtype=np.uint64)) if width <= TABLE_BITS else None
        for mask in _flips(width, radius):
            # A turned key is looked up from the side whose highest turned bit is 0, an equal one from the smaller hash.
            rows = np.flatnonzero((own >> np.uint64(mask.bit_length() - 1)) & np.uint64(1) == 0) if mask else np.arange(len(own))
            wanted = own[rows] ^ np.uint64(mask)
            if table is not None:
                at = table[wanted]
                n = table[wanted + np.uint64(1)] - at
            else:
                at = np.searchsorted(key, wanted)
                n = np.searchsorted(key, wanted, "right") - at
            some = np.flatnonzero(n)
            rows, at, n = rows[some], at[some], n[some]
            ends = np.cumsum(n)
            a = 0
            while a < len(rows):  # so many candidates at once
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + CANDIDATES)))
                for c in range(0, int(n[a]), CANDIDATES) if b == a + 1 else (0,):
                    m = np.minimum(n[a:b] - c, CANDIDATES) if b == a + 1 else n[a:b]
                    first = np.repeat(at[a:b] + c - (np.cumsum(m) - m), m)
                    x, y = np.repeat(q[rows[a:b]], m), of[first + np.arange(len(first))]
                    ok = np.bitwise_count(x ^ y) <= most
                    if not mask:
                        ok &= x < y
                    x, y = x[ok], y[ok]
                    # A pair that an earlier part finds too is that part's.
                    new = np.ones(len(x), bool)
                    for low2, width2, radius2 in plan[:k]:
                        new &= np.bitwise_count(cut(x ^ y, low2, width2)) > radius2
                    if new.any():
                        yield x[new], y[new]
                a = b


def _exact_links(same: DataFrame, most: int) -> DataFrame:
    """(h1, h2) of the different hashes with at most ``most`` different bits, h1 < h2, once each; same: one row a hash, not null.

    A task holds a piece of the hashes, sorted by each part in turn, and looks up turned keys of a lane of them.
    """
    spark = same.sparkSession
    n = same.count()
    plan = index_plan(n, most)
    blocks = max(1, -(-n // HASH_BLOCK))
    pieces = -(-blocks * HASH_BLOCK // HASHES)
    lanes = max(1, min(blocks, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // pieces)))
    packed = same.groupBy(F.pmod(F.xxhash64("h"), F.lit(blocks)).cast("int").alias("block")).agg(F.collect_list("h").alias("hs"))
    packed = written(packed, "blocks")
    each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    held = packed.select(each(lanes).alias("lane"), (F.col("block") % pieces).alias("piece"), F.lit(0).alias("role"), "hs")
    asked = packed.select((F.col("block") % lanes).alias("lane"), each(pieces).alias("piece"), F.lit(1).alias("role"), "hs")
    cell = F.col("lane") * pieces + F.col("piece")
    dealt = held.unionByName(asked).select(cell.alias("cell"), "role", "hs").repartition(lanes * pieces, "cell").sortWithinPartitions("cell", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sides = None, ([], [])

        def flush():
            if sides[0] and sides[1]:
                g, q = (np.concatenate(x) for x in sides)
                for x, y in _links_of(q, g, plan, most):
                    x, y = x.view(np.int64), y.view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["h1", "h2"])

        for b in batches:
            for k in range(b.num_rows):
                c, role = b.column(0)[k].as_py(), b.column(1)[k].as_py()
                if c != at:
                    yield from flush()
                    at, sides = c, ([], [])
                sides[role].append(b.column(2)[k].values.to_numpy().astype(np.int64).view(np.uint64))
        yield from flush()

    return dealt.mapInArrow(run, "h1 long, h2 long")


def near_hashes(rows: DataFrame, most: int, *, mode: str = "banded", bands: int = 4, cap: int | None = None, first: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(links, alike, same) of the hashes of rows (id, h): links (h1, h2, distance) of different near hashes, h1 < h2, once each; alike (h) of hashes of several
    rows; same (h, id, n), one row a hash with its smallest id and number of rows.  Null hashes are near to none.  Parameters as in ``hamming_pairs``.
    """
    # Equal hashes are one row in the join; their members come back by the hash.
    same = written(rows.where(F.col("h").isNotNull()).groupBy("h").agg(F.min("id").alias("id"), F.count("*").alias("n")), "hashes")
    alike = same.where("n > 1").select("h")
    if mode == "exact":
        near = _exact_links(same, most)
    else:
        edges = [64 * k // bands for k in range(bands + 1)]
        spans = [(k, a, b) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))][:first]
        key = lambda a, b: F.shiftrightunsigned("h", 64 - b).bitwiseAND((1 << (b - a)) - 1 if b - a < 63 else -1)
        each = F.array(*[F.struct(F.lit(k).alias("band"), key(a, b).alias("key")) for k, a, b in spans])
        keyed = same.select("h", "n", F.explode(each).alias("k")).select("h", "n", "k.band", "k.key")
        one = keyed
        if cap is not None:
            fits = keyed.groupBy("band", "key").agg(F.sum("n").alias("m")).where(F.col("m") <= cap)
            one = keyed.join(fits, ["band", "key"], "left_semi")
            alike = one.where("n > 1").select("h").distinct()
        # Statistics don't see how many keys a hash has, so a broadcast side could be larger than Spark believes.
        near = one.select("band", "key", F.col("h").alias("h1")).hint("merge").join(keyed.select("band", "key", F.col("h").alias("h2")), ["band", "key"]).where((F.col("h1") < F.col("h2")) & (hamming("h1", "h2") <= most)).select("h1", "h2").distinct()
    return written(near.select("h1", "h2", hamming("h1", "h2").alias("distance")), "links"), alike, same


def hamming_pairs(rows: DataFrame, most: int, *, mode: str = "banded", bands: int = 4, cap: int | None = None, first: int | None = None) -> DataFrame:
    """Pairs (i < j) of 64-bit hashes with at most ``most`` different bits; rows: (id, h).

    banded: pairs that share one of four 16-bit bands, which all pairs of up to 3 bits do.
    exact: multi-index hashing; parts as wide as the number of hashes allows, whose keys are looked up with
    some bits turned, so that every pair is found.  cap: buckets of more members are left out
    (as a parity mode of banded; None keeps all).  first: only so many of the bands, for a quick look.
    """
    rows = written(rows.select("id", "h").where("id IS NOT NULL"), "hashed")
    links, alike, _ = near_hashes(rows, most, mode=mode, bands=bands, cap=cap, first=first)
    a, b = rows.select(F.col("id").alias("x"), F.col("h").alias("h1")), rows.select(F.col("id").alias("y"), F.col("h").alias("h2"))
    other = by_rows(links).join(by_rows(a), "h1").join(by_rows(b), "h2").where("x <> y").select("x", "y", "distance")
    copies = rows.join(by_rows(alike), "h", "left_semi")
    equal = dealt_join(copies.select("h", F.col("id").alias("x")), copies.select("h", F.col("id").alias("y")), ["h"], "x").where("x < y").select("x", "y", F.lit(0).alias("distance"))
    return other.unionByName(equal).select(F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "distance")


def near_edges(rows: DataFrame, most: int, mode: str = "banded") -> DataFrame:
    """(i, j, distance): edges with the same connected components at every threshold as ``hamming_pairs``, without the pairs of all copies: near hashes by their smallest ids, and each row with its hash's."""
    rows = written(rows.select("id", "h"), "hashed")
    links, _, same = near_hashes(rows, most, mode=mode)
    least = lambda h, i: by_rows(same.select(F.col("h").alias(h), F.col("id").alias(i)))
    other = links.join(least("h1", "i"), "h1").join(least("h2", "j"), "h2").select("i", "j", "distance")
    equal = join_by_size(rows.withColumnRenamed("id", "j"), same.where("n > 1").withColumnRenamed("id", "i"), ["h"], "n", "copies").where("i <> j").select("i", "j", F.lit(0).alias("distance"))
    return written(other.unionByName(equal), "near")


def nearest_hash(queries: DataFrame, gallery: DataFrame) -> DataFrame:
    """(id, nearest, distance, variant): of each query's hashes (id, hs) and all gallery hashes (id, h) the closest pair; of equals the first variant, then the smallest id.

    Bits as signs make it a nearest neighbour by cosine, which the grid finds without joining all rows.
    """
    from sparkloom.functions.vectors import bits_to_signs

    turned = queries.select("id", F.posexplode("hs").alias("variant", "h")).where(F.col("h").isNotNull()).select(F.concat_ws("|", F.col("id").cast("string"), F.col("variant").cast("string")).alias("key"), "id", "variant", "h")
    named = gallery.where(F.col("h").isNotNull()).groupBy("h").agg(F.min("id").alias("g"))  # equal hashes are one row
    kind = dict(named.dtypes)["g"]
    key = lambda df, c: df.select(F.col(c).cast("string").alias("id"), bits_to_signs("h").alias("vec"))
    width = 20  # ids as text must sort as the ids do
    found = top_k(key(turned, "key"), named.select((F.lpad(F.col("g").cast("string"), width, "0") if kind != "string" else F.col("g")).alias("id"), bits_to_signs("h").alias("vec")), 1, id_type="string")
    met = found.join(turned.select(F.col("key").alias("q_id"), "id", "variant"), "q_id").select("id", "variant", F.col("g_id").cast(kind).alias("nearest"), F.rint((1 - F.col("score")) * 32).cast("int").alias("distance"))
    return met.groupBy("id").agg(F.min(F.struct("distance", "variant", "nearest")).alias("b")).select("id", "b.nearest", "b.distance", "b.variant")


def group_distances(rows: DataFrame, group: str, *keep: str) -> DataFrame:
    """(keep..., distance, n_pairs) of the pairs inside groups; rows: (group, h, keep...).  Equal hashes of a group are counted, not paired."""
    n = rows.groupBy(group, *keep, "h").agg(F.count("*").alias("n"))
    a, b = n.select(group, *keep, F.col("h").alias("h1"), F.col("n").alias("n1")), n.select(group, *keep, F.col("h").alias("h2"), F.col("n").alias("n2"))
    other = a.join(b, [group, *keep]).where("h1 < h2").select(*keep, hamming("h1", "h2").alias("distance"), (F.col("n1") * F.col("n2")).alias("n_pairs"))
    same = n.where("n > 1").select(*keep, F.lit(0).alias("distance"), (F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("n_pairs"))
    return other.unionByName(same).groupBy(*keep, "distance").agg(F.sum("n_pairs").alias("n_pairs"))
