"""Substring dedup with fixed-block anchors.

A window of 50 consecutive words is removed from a document if its word sequence also
starts in a document with a smaller id.  Any such window holds, in the other document,
a whole 25-word block of that document's non-overlapping grid.  So:

1. *Anchors.*  Every document sends the hashes of all its rolling 25-word windows, with a
   mark on those of its grid, to buckets by hash.  A bucket reports the hashes that are a
   grid block somewhere and occur in two documents or more.
2. *Extension.*  Each document extends its hits to all 50-word windows around them, which
   are held against each other by a hash of 80 bits: runs of equal windows are the maximal
   exact repeats.  A window's smallest document keeps it.
3. Documents drop the words that removed windows cover.

Hashes travel packed (sorted, as byte planes of differences, with document numbers local
to a batch), a few bytes per word.  A bucket holds a bounded share of all hashes, whatever
passage is frequent: a batch sends each (hash, document) once, and groups are reduced by
sorting, never by pairs.  With more than ``DIRECT`` buckets, rows for one bucket each would be
many and tiny; they then go through lanes of some square root of the buckets first, whose
tasks pack them anew, so that rows stay large however many buckets there are.

Defined cases: a null text has no words; rows with a null id keep all words and take none
from others; rows with equal ids count as one document; documents of fewer than 50 words
keep all; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import textkit
from sparkloom.llm.arrowmap import arrow_map
from sparkloom.plans.shared import partitions, plan_bytes, written

WINDOW = 50
#: A window of n words holds a whole block of a grid of (n + 1) // 2 words.
HASH_BITS, DOC_BITS = 44, 19
#: Words (or documents) of a batch of packed hashes; input bytes for each bucket.
BATCH_WORDS, BATCH_DOCS, BUCKET_BYTES = 1 << 21, (1 << DOC_BITS) - 1, 12 << 20
#: Buckets up to which rows are packed for each of them at once.
DIRECT = 4096


def lane_width(buckets: int) -> int:
    """Buckets of a lane."""
    return 1 if buckets <= DIRECT else max(2, int(np.sqrt(buckets)))


def planes(values: np.ndarray) -> bytes:
    """Whole numbers as compressed byte planes, the high ones left out where all are 0."""
    k = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    raw = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :k].T).tobytes()
    return bytes([k]) + pa.compress(raw, codec="zstd", asbytes=True)


def unplanes(data: bytes, n: int) -> np.ndarray:
    k = data[0]
    raw = np.frombuffer(pa.decompress(data[1:], decompressed_size=n * k, codec="zstd", asbytes=True), np.uint8).reshape(k, n)
    out = np.zeros((n, 8), np.uint8)
    out[:, :k] = raw.T
    return out.reshape(-1).view("<u8")


def deltas(values: np.ndarray) -> np.ndarray:
    return np.diff(values, prepend=values.dtype.type(0))


class Packer:
    """Gathers (hash, document, extra) of a task and packs them into one row for each lane of so many buckets."""

    fields = ("bucket", "n", "n_docs", "docs", "hashes", "refs", "extra")
    schema = "bucket int, n int, n_docs int, docs binary, hashes binary, refs binary, extra binary"

    def __init__(self, bits: int, buckets: int, wide: int = 1):
        self.bits, self.buckets, self.wide, self.parts, self.words, self.docs = bits, buckets, wide, [], 0, 0

    def add(self, ids: np.ndarray, doc: np.ndarray, h: np.ndarray, extra: np.ndarray) -> Iterator[pa.RecordBatch]:
        """ids by document of the slice; of each entry its document, hash and extra."""
        if len(h):
            self.parts.append((ids[doc], h, extra))
            self.words += len(h)
            self.docs += len(ids)
        if self.words >= BATCH_WORDS or self.docs >= BATCH_DOCS:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.words:
            return
        ids, h, extra = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.words, self.docs = [], 0, 0
        order = np.argsort(h)
        h, extra = h[order], extra[order]
        ids = ids[order]
        # Buckets are ranges of the hash, lanes ranges of buckets.
        step = -(-(1 << self.bits) // self.buckets) * self.wide
        lane = (h // np.uint64(step)).astype(np.int64) if step < 1 << 64 else np.zeros(len(h), np.int64)
        first = np.flatnonzero(np.append(True, lane[1:] != lane[:-1]))
        cols: dict[str, list] = {f: [] for f in self.fields}
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(h)], strict=True):
            docs, refs = np.unique(ids[a:b], return_inverse=True)
            made = (int(lane[a]), b - a, len(docs), planes(deltas(docs.view(np.uint64))), planes(deltas(h[a:b])), planes(refs.astype(np.uint64)), planes(extra[a:b].astype(np.uint64)))
            for f, v in zip(self.fields, made, strict=True):
                cols[f].append(v)
        types = (pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 4)
        yield pa.RecordBatch.from_arrays([pa.array(cols[f], t) for f, t in zip(self.fields, types, strict=True)], names=list(self.fields))


def unpack(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents' ids, hashes and extras of a packed row."""
    docs = np.cumsum(unplanes(r["docs"], r["n_docs"])).view(np.int64)
    return docs[unplanes(r["refs"], r["n"]).astype(np.int64)], np.cumsum(unplanes(r["hashes"], r["n"])), unplanes(r["extra"], r["n"])


def spark_hash(ids: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of a long, for the same dealing of documents in both places."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))
    h = turn(ids.astype(np.int64).view(np.uint64) * p2, 31) * p1 ^ (p5 + np.uint64(42 + 8))
    h = turn(h, 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def pack_hits(doc: np.ndarray, h: np.ndarray, buckets: int, wide: int) -> pa.RecordBatch:
    """(lane, hits): hashes by document, a row for each lane of so many parts of the documents."""
    lane = np.mod(spark_hash(doc), buckets) // wide
    order = np.lexsort((doc, lane))
    doc, h, lane = doc[order], h[order], lane[order]
    first = np.flatnonzero(np.append(True, lane[1:] != lane[:-1])) if len(lane) else np.zeros(0, np.int64)
    lanes, rows = [], []
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(lane)], strict=True) if len(lane) else ():
        docs, counts = np.unique(doc[a:b], return_counts=True)
        head = np.array([len(docs)], np.int64).tobytes()
        lanes.append(int(lane[a]))
        rows.append(b"".join(len(x).to_bytes(8, "little") + x for x in (head, planes(deltas(docs.view(np.uint64))), planes(counts.astype(np.uint64)), h[a:b].tobytes())))
    return pa.RecordBatch.from_arrays([pa.array(lanes, pa.int64()), pa.array(rows, pa.binary())], names=["part", "hits"])


def unpack_hits(raw: bytes, dtype) -> tuple[np.ndarray, np.ndarray]:
    """Documents and hashes of a row of hits, by document."""
    fields, at = [], 0
    while at < len(raw):
        n = int.from_bytes(raw[at : at + 8], "little")
        fields.append(raw[at + 8 : at + 8 + n])
        at += 8 + n
    n = int(np.frombuffer(fields[0], np.int64)[0])
    return np.repeat(np.cumsum(unplanes(fields[1], n)).view(np.int64), unplanes(fields[2], n).astype(np.int64)), np.frombuffer(fields[3], dtype)


def packed_anew(packed: DataFrame, bits: int, buckets: int, wide: int) -> DataFrame:
    """Rows of lanes as rows of buckets: a lane's rows are dealt to as many tasks as it has buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(bits, buckets)
        for b in batches:
            for r in b.to_pylist():
                doc, h, extra = unpack(r)
                yield from packer.add(doc, np.arange(len(doc)), h, extra)
        yield from packer.flush()

    some = F.pmod(F.crc32("hashes"), F.lit(wide))
    return arrow_map(packed.repartition(buckets, F.col("bucket"), some).sortWithinPartitions("bucket"), run, Packer.schema)


def hits_anew(hits: DataFrame, buckets: int, wide: int, dtype) -> DataFrame:
    """Hits of lanes as hits of parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            for raw in b.column(1).to_pylist():
                held.append(unpack_hits(raw, dtype))
                n += len(held[-1][0])
                if n >= BATCH_WORDS:
                    yield pack_hits(*(np.concatenate(x) for x in zip(*held, strict=True)), buckets, 1)
                    held, n = [], 0
        if held:
            yield pack_hits(*(np.concatenate(x) for x in zip(*held, strict=True)), buckets, 1)

    some = F.pmod(F.crc32("hits"), F.lit(wide))
    return arrow_map(hits.repartition(buckets, F.col("part"), some).sortWithinPartitions("part"), run, "part long, hits binary")


def by_bucket(packed: DataFrame, bits: int, buckets: int, wide: int, reduce: Callable, dtype, what: str) -> DataFrame:
    """Brings the rows of each bucket together and reduces them.

    reduce(ids, hashes, extras) gives ids and hashes; they are packed for each lane of parts of the
    documents (``part``), however many documents a bucket has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts = None, []

        def done() -> Iterator[pa.RecordBatch]:
            if parts:
                yield pack_hits(*reduce(*[np.concatenate(x) for x in zip(*parts, strict=True)]), buckets, wide)

        for b in batches:
            for r in b.to_pylist():
                if r["bucket"] != at:
                    yield from done()
                    at, parts = r["bucket"], []
                parts.append(unpack(r))
        yield from done()

    own = packed_anew(packed, bits, buckets, wide) if wide > 1 else packed
    hits = arrow_map(own.repartition(buckets, "bucket").sortWithinPartitions("bucket"), run, "part long, hits binary")
    return written(hits_anew(hits, buckets, wide, dtype) if wide > 1 else hits, what)


class Hits:
    """The hashes of each document of a part."""

    def __init__(self, rows: list[bytes], dtype):
        if not rows:
            self.docs, self.off, self.values = np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, dtype)
            return
        doc, values = (np.concatenate(x) for x in zip(*(unpack_hits(raw, dtype) for raw in rows), strict=True))
        order = np.argsort(doc, kind="stable")
        self.values = values[order]
        self.docs, first = np.unique(doc[order], return_index=True)
        self.off = np.append(first, len(doc))

    def of(self, ids: list[int | None]) -> list[np.ndarray | None]:
        if not len(self.docs):
            return [None] * len(ids)
        at = np.minimum(np.searchsorted(self.docs, [i or 0 for i in ids]), len(self.docs) - 1)
        return [self.values[self.off[k] : self.off[k + 1]] if i is not None and self.docs[k] == i else None for i, k in zip(ids, at.tolist(), strict=True)]


def beside(rows: DataFrame, hits: DataFrame, buckets: int, dtype, work: Callable, schema: str) -> DataFrame:
    """Streams documents past the hits of their part: work(ids, slice, hits of each document) yields batches.

    One part's hits are in memory at a time; a part is a share of the documents by a hash of their id.
    """
    part = lambda c: F.pmod(c, F.lit(buckets))
    texts = rows.select(part(F.when(F.col("id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("id"))).alias("part"), F.lit(1).alias("kind"), "id", "text", F.lit(None).cast("binary").alias("hits"))
    both = texts.unionByName(hits.select("part", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("text"), "hits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, raw, known = None, [], None
        for b in batches:
            parts, kinds = b.column(0).to_numpy(), b.column(1).to_numpy()
            key = parts * 2 + kinds
            edges = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)] if len(key) else [0]
            for i, j in zip(edges, edges[1:], strict=False):
                if parts[i] != at:
                    at, raw, known = parts[i], [], None
                if not kinds[i]:
                    raw += b.column(4).slice(i, j - i).to_pylist()
                    continue
                if known is None:
                    known, raw = Hits(raw, dtype), []
                for x, y, s in textkit.slices(b.column(3).slice(i, j - i)):
                    ids = b.column(2).slice(i + x, y - x)
                    yield from work(ids, s, known.of(ids.to_pylist()))

        yield from work(None, None, None)

    return arrow_map(both.repartition(buckets, "part").sortWithinPartitions("part", "kind"), run, schema)


def shared_blocks(doc: np.ndarray, h: np.ndarray, grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries whose hash is a grid block somewhere and occurs in two documents; of the hash its low half, enough within a document."""
    order = np.argsort(h, kind="stable")
    doc, h, grid = doc[order], h[order], grid[order]
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    good = (np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)) & (np.maximum.reduceat(grid, first) > 0)
    keep = np.repeat(good, np.diff(np.append(first, len(h))))
    return doc[keep], h[keep].astype(np.uint32)


def not_the_first(doc: np.ndarray, h: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries whose hash (and check) a smaller document has too."""
    order = np.lexsort((doc, check, h))
    doc, h, check = doc[order], h[order], check[order]
    first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (check[1:] != check[:-1])))
    least = np.repeat(doc[first], np.diff(np.append(first, len(h))))
    keep = doc > least
    return doc[keep], h[keep]


def _members(s: textkit.Slice, values: np.ndarray, at: np.ndarray, hits: list[np.ndarray | None]) -> np.ndarray:
    """Which windows' values are among their document's hits."""
    bounds = np.searchsorted(at, s.word_off)
    out = np.zeros(len(at), bool)
    for d, own in enumerate(hits):
        if own is not None:
            out[bounds[d] : bounds[d + 1]] = np.isin(values[bounds[d] : bounds[d + 1]], own)
    return out


def _parts(rows: DataFrame) -> int:
    return partitions(rows.sparkSession, plan_bytes(rows), BUCKET_BYTES)


def repeats(docs: DataFrame, buckets: int, *, window: int = WINDOW) -> DataFrame:
    """Packed hashes (64 bits) of each document's windows that start in a document with a smaller id; docs: (id, text)."""
    block, wide = (window + 1) // 2, lane_width(buckets)
    rows = docs.where(F.col("id").isNotNull() & (F.length("text") >= 2 * window - 1))

    def anchors(batches):
        packer = Packer(HASH_BITS, buckets, wide)
        for b in batches:
            for i, j, s in textkit.slices(b.column(1)):
                ids = b.column(0).slice(i, j - i).to_numpy(zero_copy_only=False)
                word_doc = s.word_doc()
                long = s.n_words >= window
                at, h = s.windows(block)
                at, h = at[long[word_doc[at]]], h[long[word_doc[at]]]
                doc = word_doc[at]
                yield from packer.add(ids, doc, h >> np.uint64(64 - HASH_BITS), (at - s.word_off[doc]) % block == 0)
        yield from packer.flush()

    hits = by_bucket(arrow_map(rows, anchors, Packer.schema), HASH_BITS, buckets, wide, shared_blocks, np.uint32, "anchors")

    def extend():
        packer = None

        def work(ids, s, hits):
            nonlocal packer
            packer = packer or Packer(64, buckets, wide)
            if s is None:
                yield from packer.flush()
                return
            if all(x is None for x in hits):
                return
            at, h = s.windows(block)
            hit = at[_members(s, (h >> np.uint64(64 - HASH_BITS)).astype(np.uint32), at, hits)]
            near = np.zeros(len(s.starts) + 1, np.int64)
            near[hit + 1] = 1
            near = np.cumsum(near)
            word_doc = s.word_doc()
            full = np.flatnonzero(s.word_off[1:][word_doc] - np.arange(len(s.starts)) >= window)
            full = full[near[full + window - block + 1] > near[full]]
            _, h = s.windows(window, 0, full)
            _, check = s.windows(window, 1, full)
            yield from packer.add(ids.to_numpy(zero_copy_only=False), word_doc[full], h, check >> np.uint64(48))

        return work

    return by_bucket(beside(rows, hits, buckets, np.uint32, extend(), Packer.schema), 64, buckets, wide, not_the_first, np.uint64, "repeats")


def remove(docs: DataFrame, found: DataFrame, buckets: int, *, window: int = WINDOW) -> DataFrame:
    """Per row of docs (id, text): id, n_words, n_removed, kept (the words left, joined by one space)."""

    def work(ids, s, hits):
        if s is None:
            return
        word_doc = s.word_doc()
        gone = np.zeros(len(s.starts), bool)
        if any(x is not None for x in hits):
            full = np.flatnonzero(s.word_off[1:][word_doc] - np.arange(len(s.starts)) >= window)
            _, h = s.windows(window, 0, full)
            gone = s.covered(full[_members(s, h, full, hits)], window)
        yield pa.RecordBatch.from_arrays([ids, pa.array(s.n_words.astype(np.int64)), pa.array(s.per_doc_words(gone)), kept_words(s, ~gone)], names=["id", "n_words", "n_removed", "kept"])

    return beside(docs, found, buckets, np.uint64, work, "id long, n_words long, n_removed long, kept string")


def kept_words(s: textkit.Slice, keep: np.ndarray) -> pa.Array:
    """Each document's kept words, joined by one space."""
    word_doc = s.word_doc()
    at = np.flatnonzero(keep)
    last = np.ones(len(at), bool)
    last[:-1] = word_doc[at[1:]] != word_doc[at[:-1]]
    d = np.zeros(len(s.buf) + 2, np.int32)
    # A kept word takes its bytes and, unless the last of its document, the white space after it, made a space.
    d[s.starts[at]] += 1
    d[s.ends[at] + ~last] -= 1
    mask = np.cumsum(d)[: len(s.buf)] > 0
    buf = s.buf.copy()
    buf[s.ends[at[~last]]] = 0x20
    sums = textkit.prefix(mask.astype(np.int64))
    off = sums[s.off].astype(np.int32)
    return pa.StringArray.from_buffers(s.n_docs, pa.py_buffer(off), pa.py_buffer(buf[mask]))


def dedup(docs: DataFrame, *, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, n_removed, kept."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    buckets = _parts(rows)
    return remove(rows, repeats(rows, buckets, window=window), buckets, window=window).withColumnRenamed("id", id_col)
