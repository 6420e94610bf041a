"""MinHash near-dedup with BagMinHash signatures.

A document is the multiset of its five-word shingles.  Each unit of a shingle's
weight is a Poisson process of rate 1 over (time, signature place); weights are cut
into dyadic levels ([0,1), [1,2), [2,4), ...), a level's process has its width as rate, and
a level that a weight only partly covers is thinned by each point's own height.  A
place of the signature keeps its earliest point, so two documents agree at a place with
probability equal to their weighted Jaccard similarity.  Points are only drawn up to a
time by which all places are expected to be filled; documents with a gap go on to twice
that time.  (Ertl, "BagMinHash", KDD 2018.)

1. Documents with equal words form a class at once; its smallest id stands for it.
2. Signatures are cut into 20 bands of 4.  In each bucket of a band the member whose
   buckets are largest is the hub; all others are candidates with it only.
3. Candidate pairs are verified on the whole texts: multiset overlap of at least 0.8.
   Hub and members are dealt by (hub, salt) and streamed, one hub in memory at a time.
4. Links give components.  Members of buckets that still hold several components are
   joined once more, exactly: two multisets of this similarity share one of their rarest
   elements (prefix filter), so copies of one passage in otherwise different texts never
   meet.  Pairs of different components that do are verified as well, and the components
   are taken again.

So a group of n copies costs about n candidates, not n squared, and links between
different texts are only lost where no band agrees (0.003 % at a similarity of 0.8).

Defined cases: a null or empty text has no shingle and is a class by itself; a text of
fewer than five words is one shingle of all its words; rows with a null id get a null
class; rows with equal ids are one document; ties for a hub go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import textkit
from sparkloom.llm.arrowmap import arrow_map, map_text
from sparkloom.llm.textkit import mix
from sparkloom.operators.components import connected_components
from sparkloom.plans.shared import HOT_ROWS, join_by_size, written

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 20, 4
#: Counters of the sketch by which elements are ordered from rare to frequent (4 MB), in so many pieces.
COUNTERS, PIECES = 1 << 20, 64
#: Parts into which a hub's members are dealt.
HUB_SALTS = 64
#: Ids up to which a candidate list is broadcast to pick its texts, by count.
MAX_BROADCAST_IDS = 200_000

_ONE = 36  # bits of a unit of time
_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


def multisets(s: textkit.Slice, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, shingle and weight, by document and shingle."""
    at, h = s.windows(k)
    doc = s.word_doc()[at]
    for n in range(1, k):
        d = np.flatnonzero(s.n_words == n)
        if len(d):
            _, x = s.windows(n, 0, s.word_off[d])
            doc, h = np.append(doc, d), np.append(h, x)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))) if len(h) else np.zeros(0, np.int64)
    return doc[first], h[first], np.diff(np.append(first, len(h)))


def signatures(doc: np.ndarray, x: np.ndarray, w: np.ndarray, n_docs: int, m: int = BANDS * ROWS) -> np.ndarray:
    """Earliest times, documents by places; documents without shingles keep the largest number."""
    none = np.iinfo(np.int64).max
    out = np.full(n_docs * m, none)
    total = np.bincount(doc, w, n_docs)
    limit = np.minimum(m / np.maximum(total, 1) * (np.log(m) + 6) * 2.0**_ONE, 2.0**60).astype(np.int64)
    todo = total > 0
    while todo.any():
        own = np.flatnonzero(todo[doc])
        # A shingle of weight w reaches into 1 + ceil(log2 w) levels.
        levels = 1 + np.ceil(np.log2(w[own])).astype(np.int64)
        e = np.repeat(own, levels)
        level = np.arange(len(e)) - np.repeat(np.cumsum(levels) - levels, levels)
        low = np.where(level > 0, 1 << np.maximum(level - 1, 0), 0)
        wide = np.maximum(level - 1, 0)  # the level's width is a power of two
        key, d, weight = mix(x[e] + level.astype(np.uint64) * _A), doc[e], w[e]
        whole = low + (1 << wide) <= weight
        t = np.zeros(len(e), np.int64)
        n = 0
        while len(t):
            n += 1
            r = mix(key + np.uint64(n * int(_B) % (1 << 64)))
            step = (-np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) * 2.0**_ONE).astype(np.int64) >> wide
            t = t + step
            on = t < limit[d]
            t, key, d, weight, low, wide, whole, r = (v[on] for v in (t, key, d, weight, low, wide, whole, r))
            inside = whole | (low + (mix(r + _C) & ((np.uint64(1) << wide.astype(np.uint64)) - np.uint64(1))).astype(np.int64) < weight)
            np.minimum.at(out, (d * m + (mix(r + _D) % np.uint64(m)).astype(np.int64))[inside], t[inside])
        gaps = (out.reshape(n_docs, m) == none).any(1) & todo
        limit[gaps] *= 2
        todo = gaps
    return out.reshape(n_docs, m)


def bands(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    h = mix(sig.astype(np.uint64)).reshape(len(sig), BANDS, ROWS)
    key = np.repeat((np.arange(BANDS, dtype=np.uint64) + np.uint64(1))[None], len(sig), 0)
    for r in range(ROWS):
        key = mix(key * _B + h[:, :, r])
    return key


def sketch(docs: DataFrame, *, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Per row with an id and a word: id, two hashes of all its words, band keys."""

    def make(ids, texts, s):
        some = np.flatnonzero(s.n_words > 0)
        if not len(some):
            return None
        sig = signatures(*multisets(s), s.n_docs)[some]
        whole = []
        for f in (0, 1):
            h = s.words(f) * textkit.powers(0x9E3779B97F4A7C15 if f else 0xD6E8FEB86659FD93, len(s.starts) + 1)[np.arange(len(s.starts)) - np.repeat(s.word_off[:-1], s.n_words)]
            c = textkit.prefix(h)
            whole.append(mix(c[s.word_off[1:]] - c[s.word_off[:-1]] + s.n_words.astype(np.uint64))[some].view(np.int64))
        keys = bands(sig).view(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * BANDS), pa.array(keys.reshape(-1)))
        return {"id": ids.take(pa.array(some)), "w1": whole[0], "w2": whole[1], "keys": lists}

    rows = docs.where(F.col(id_col).isNotNull())
    return map_text(rows, id_col, text_col, make, "id long, w1 long, w2 long, keys array<long>")


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sorted multisets."""
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = int(np.minimum(a[1][i], b[1][j]).sum())
    total = int(a[1].sum() + b[1].sum()) - least
    return least / total if total else 0.0


def verify(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, sim) of candidate pairs, on whole texts.  docs: (id, text)."""
    pairs = written(pairs.select("a", "b"), "pairs")
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    few = pairs.count() <= MAX_BROADCAST_IDS
    texts = docs.join(F.broadcast(ids), "id", "left_semi") if few else docs.join(ids, "id", "left_semi")
    dealt = pairs.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(HUB_SALTS)).cast("int"))
    members = texts.join(dealt.withColumnRenamed("a", "id"), "id").select("b", "salt", F.lit(1).alias("role"), "id", "text")
    hubs = texts.join(dealt.select(F.col("b").alias("id"), "salt").distinct(), "id").select(F.col("id").alias("b"), "salt", F.lit(0).alias("role"), "id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, hub = None, None
        for b in batches:
            for i, j, s in textkit.slices(b.column(4)):
                part = b.slice(i, j - i)
                doc, x, w = multisets(s)
                bounds = np.searchsorted(doc, np.arange(s.n_docs + 1))
                out = ([], [], [])
                for d, (to, salt, role, who) in enumerate(zip(*(part.column(k).to_pylist() for k in range(4)), strict=True)):
                    own = (x[bounds[d] : bounds[d + 1]], w[bounds[d] : bounds[d + 1]])
                    if not role:
                        if at != (to, salt):
                            at, hub = (to, salt), []
                        hub.append((own[0].copy(), own[1].copy()))
                    elif at == (to, salt):
                        for c, v in zip(out, (who, to, max(overlap(own, h) for h in hub)), strict=True):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["a", "b", "sim"])

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    streamed = arrow_map(members.unionByName(hubs).repartition(parts, "b", "salt").sortWithinPartitions("b", "salt", "role"), run, "a long, b long, sim double")
    return written(streamed.groupBy("a", "b").agg(F.max("sim").alias("sim")), "sims")


def elements(s: textkit.Slice) -> tuple[np.ndarray, np.ndarray]:
    """Document and hash of each element of the multisets, a shingle's nth occurrence being an element of its own."""
    doc, x, w = multisets(s)
    nth = np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w)
    return np.repeat(doc, w), mix(np.repeat(x, w) + nth.astype(np.uint64) * _A)


def frequencies(texts: DataFrame) -> np.ndarray:
    """Counters of all elements by their low bits: summed in pieces, so that what meets in a task and on the driver has a fixed size."""

    def count(batches):
        total = np.zeros(COUNTERS, np.int64)
        for b in batches:
            for _, _, s in textkit.slices(b.column(0)):
                total += np.bincount((elements(s)[1] & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(PIECES, dtype=np.int32)), pa.array([pa.compress(p.tobytes(), codec="zstd", asbytes=True) for p in total.reshape(PIECES, -1)], pa.binary())], names=["piece", "counts"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for r in b.to_pylist():
                n = COUNTERS // PIECES
                got = np.frombuffer(pa.decompress(r["counts"], decompressed_size=8 * n, codec="zstd", asbytes=True), np.int64)
                sums[r["piece"]] = sums.get(r["piece"], 0) + got
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.astype(np.int64).tobytes() for v in sums.values()], pa.binary())], names=["piece", "counts"])

    out = np.zeros((PIECES, COUNTERS // PIECES), np.int64)
    summed = arrow_map(arrow_map(texts.select("text"), count, "piece int, counts binary").repartition(PIECES, "piece"), add, "piece int, counts binary")
    for r in summed.collect():  # PIECES rows
        out[r.piece] = np.frombuffer(r.counts, np.int64)
    return np.minimum(out.reshape(-1), 2**31 - 1).astype(np.int32)


def crossing(texts: DataFrame, similarity: float) -> DataFrame:
    """(a, b) pairs of different components c that share an element of their prefixes; texts: (id, c, text).

    Elements are ordered by the sketch's counts, then by hash: the same order for all texts, so
    the filter is exact.  Of each element's members only those outside its most frequent
    component look for partners; those of a frequent element are dealt to several tasks.
    """
    counts = texts.sparkSession.sparkContext.broadcast(frequencies(texts))

    def prefixes(batches):
        rank = counts.value
        for b in batches:
            for i, j, s in textkit.slices(b.column(2)):
                doc, x = elements(s)
                order = np.lexsort((x, rank[(x & np.uint64(COUNTERS - 1)).astype(np.int64)], doc))
                doc, x = doc[order], x[order]
                n = np.bincount(doc, minlength=s.n_docs)
                keep = n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1
                place = np.arange(len(doc)) - (np.cumsum(n) - n)[doc]
                at = place < keep[doc]
                d = pa.array(doc[at])
                yield pa.RecordBatch.from_arrays([pa.array(x[at].view(np.int64)), b.column(0).slice(i, j - i).take(d), b.column(1).slice(i, j - i).take(d), pa.array(n[doc[at]]), pa.array(place[at])], names=["x", "id", "c", "n", "i"])

    rows = written(arrow_map(texts.select("id", "c", "text"), prefixes, "x long, id long, c long, n long, i long"), "prefixes")
    by = rows.groupBy("x", "c").agg(F.count("*").alias("m"))
    mixed = by.groupBy("x").agg(F.max_by("c", "m").alias("main"), F.sum("m").alias("m"), F.count("*").alias("k")).where("k > 1").select("x", "main", "m", (1 + F.col("m") / HOT_ROWS).cast("int").alias("salts"))
    mixed = written(join_by_size(rows, mixed, ["x"], "m", what="elements"), "mixed")
    salt = F.pmod(F.xxhash64("id"), F.col("salts")).cast("int")
    a = mixed.where("c <> main").select("x", salt.alias("salt"), F.col("id").alias("p"), F.col("c").alias("pc"), F.col("n").alias("pn"), F.col("i").alias("pi"))
    b = mixed.select("x", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("id").alias("q"), F.col("c").alias("qc"), F.col("n").alias("qn"), F.col("i").alias("qi"))
    # At their first common element two similar multisets still have their whole overlap before them.
    enough = F.least(F.col("pn") - F.col("pi"), F.col("qn") - F.col("qi")) >= similarity / (1 + similarity) * (F.col("pn") + F.col("qn")) - 1e-6
    met = a.join(b, ["x", "salt"]).where((F.col("pc") != F.col("qc")) & enough)
    return met.groupBy(F.greatest("p", "q").alias("a"), F.least("p", "q").alias("b")).agg(F.count("*").alias("m"))


def classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """Per row: id, class_id (the smallest id of the near-duplicates it is linked with, over any number of links), is_kept."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    some = rows.where(F.col("id").isNotNull())
    made = written(sketch(some), "sketches")
    copies = made.groupBy("w1", "w2").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    # Only classes of several copies need a join; the smallest id of each goes on.
    several = join_by_size(made.select("id", "w1", "w2"), copies.where("n > 1"), ["w1", "w2"], "n", what="copies").select("id", "rep").where("id <> rep").distinct()
    first = copies.select(F.col("rep").alias("id"), "w1", "w2")
    reps = written(made.join(first, ["id", "w1", "w2"], "left_semi").dropDuplicates(["id", "w1", "w2"]), "representatives")

    member = reps.select("id", F.explode("keys").alias("key"))
    counted = member.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").withColumn("size", F.col("n"))
    member = written(join_by_size(member, counted, ["key"], "size", what="counted"), "buckets")
    central = member.groupBy("id").agg(F.sum("n").alias("c"))
    member = member.join(central, "id").select("key", "id", "c")
    hub = member.groupBy("key").agg(F.max_by("id", F.struct("c", -F.col("id"))).alias("hub"), F.count("*").alias("size"))
    member = written(join_by_size(member, hub, ["key"], "size", what="hubs").select("key", "id", "hub"), "members")
    stars = member.where("id <> hub").groupBy(F.col("id").alias("a"), F.col("hub").alias("b")).agg(F.count("*").alias("n"))
    sims = verify(some, stars)
    links = sims.where(F.col("sim") >= similarity).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    parts = written(connected_components(links), "parts")

    # What is left: members of buckets with several components.
    own = member.join(parts, "id", "left").select("key", "id", F.coalesce("component", "id").alias("c"))
    mixed = own.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count("*").alias("size")).where("c0 <> c1").select("key", "size")
    left = written(join_by_size(own, mixed, ["key"], "size", what="mixed-buckets").select("id", "c").distinct(), "open")
    if left.isEmpty():
        return _named(rows, parts, several, None, id_col)
    texts = some.join(F.broadcast(left) if left.count() <= MAX_BROADCAST_IDS else left, "id").select("id", "c", "text")
    more = verify(some, crossing(written(texts, "texts"), similarity)).where(F.col("sim") >= similarity).select(F.col("a").alias("src"), F.col("b").alias("dst"))

    return _named(rows, parts, several, more, id_col)


def _named(rows: DataFrame, parts: DataFrame, several: DataFrame, more: DataFrame | None, id_col: str) -> DataFrame:
    """Every row's class from the components of verified links, exact copies, and links found later."""
    every = parts.where("id <> component").select(F.col("id").alias("src"), F.col("component").alias("dst")).unionByName(several.select(F.col("id").alias("src"), F.col("rep").alias("dst")))
    found = connected_components(every if more is None else every.unionByName(more))
    # Only ids that are linked join; others are their own class.
    out = rows.select("id").join(found, "id", "left").select(F.col("id").alias(id_col), F.coalesce("component", "id").alias("class_id"))
    return out.withColumn("is_kept", F.coalesce(F.col(id_col) == F.col("class_id"), F.lit(True)))
