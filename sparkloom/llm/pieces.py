"""SentencePiece encoding and decoding on the tokenizers library.

The model protobuf is read here (pieces, scores, types, normaliser, flags) and
rebuilt as a ``tokenizers`` BPE or Unigram model: precompiled character map, dummy
prefix, space marker, byte fallback; BPE merges follow from the scores.

No piece of the usual models holds the marker after its first letters, so no token
crosses a space before which there is none, and a text falls into segments at these
spaces.  The tokenizers library encodes each segment once, in batches on ``THREADS``
threads; texts are put together from the segments' ids as whole arrays.  ``encode`` holds
each segment against the sentencepiece library and decodes it again: ``parity`` says
whether both libraries agree on all of a text, whose ids are those of the tokenizers
library in any case.  A worker keeps at most ``CACHE_BYTES`` of segments, found again by a
64-bit hash, and frees them with the model at a task's end.  Models with other pieces or
their own normaliser are encoded text by text.

Defined cases: a null or empty text has no ids; ``round_trip`` says whether decoding
gives the normalised text again, which is the text itself for a model with the identity
normaliser; unknown characters without byte fallback give the unknown id and no round
trip; control ids decode to nothing; null ids and repeated rows are kept.
"""

from __future__ import annotations

import functools
import os
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sparkloom.llm import textkit
from sparkloom.llm.arrowmap import arrow_map

MARK = "▁"
#: Bytes of segments that a worker keeps; segments encoded, and ids decoded, at once; threads of an encoding batch.
CACHE_BYTES, BATCH, DECODED, THREADS = 32 << 20, 4096, 1 << 16, 2
#: The marker's bytes.
_MARK = np.frombuffer(MARK.encode(), np.uint8)
# Fixed values of the model format: field numbers, piece types, model types.
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
UNIGRAM, BPE = 1, 2


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a protobuf message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                return out

    while at < len(data):
        key = varint()
        if (kind := key & 7) == 0:
            yield key >> 3, varint()
            continue
        n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, data[at : at + n]
        at += n


class Model:
    """What a model file says."""

    def __init__(self, data: bytes):
        self.data = data
        self.pieces: list[tuple[str, float, int]] = []
        trainer, norm = {}, {}
        for number, value in fields(data):
            if number == 1:
                p = dict(fields(value))
                self.pieces.append((p[1].decode(), struct.unpack("<f", p[2])[0] if 2 in p else 0.0, p.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                norm = dict(fields(value))
        self.kind = trainer.get(3, UNIGRAM)
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        if trainer.get(24, 0):
            raise ValueError("models that treat white space as a suffix are not supported")
        self.byte_fallback = bool(trainer.get(35, 0))
        self.unknown = next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)
        self.charsmap = norm.get(2, b"")
        self.prefix, self.squeeze, self.escape = (bool(norm.get(k, 1)) for k in (3, 4, 5))
        self.plain = not self.charsmap and not self.squeeze and self.escape
        words = [p for p, _, t in self.pieces if t in (NORMAL, USER)]
        #: Whether the marker only begins pieces, so that a text may be cut at a space.
        self.cuts = self.plain and MARK in words and not any(MARK in p.lstrip(MARK) for p in words)

    def merges(self) -> list[tuple[str, str]]:
        """All ways to join two pieces to a third, best score first.

        Of equal scores the format takes the leftmost pair, so that a run grows from its left: longer left pieces come first.
        """
        score = {p: s for p, s, t in self.pieces if t in (NORMAL, USER)}
        place = {p: i for i, (p, _, _) in enumerate(self.pieces)}
        found = [(-s, -k, place[p[:k]], place[p[k:]], p[:k], p[k:]) for p, s in score.items() if len(p) > 1 for k in range(1, len(p)) if p[:k] in score and p[k:] in score]
        return [(a, b) for *_, a, b in sorted(found)]

    def tokenizer(self):
        from tokenizers import Regex, Tokenizer, decoders, models, normalizers

        if self.kind == BPE:
            t = Tokenizer(models.BPE({p: i for i, (p, _, _) in enumerate(self.pieces)}, self.merges(), unk_token=self.pieces[self.unknown][0], fuse_unk=True, byte_fallback=self.byte_fallback, cache_capacity=0))
        else:
            t = Tokenizer(models.Unigram([(p, s) for p, s, _ in self.pieces], self.unknown, self.byte_fallback))
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.squeeze:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        steps += [normalizers.Prepend(" " if not self.escape else MARK)] * self.prefix
        steps += [normalizers.Replace(" ", MARK)] * self.escape
        if steps:
            t.normalizer = normalizers.Sequence(steps)
        t.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()] + [decoders.Strip(" ", 1, 0)] * self.prefix)
        return t


class Segments:
    """Known segments: sorted hashes, and each one's ids, whether both libraries agree on it, and whether it decodes again."""

    def __init__(self):
        self.keys, self.row = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.same, self.back = np.zeros(0, bool), np.zeros(0, bool)
        self.flat, self.used = np.zeros(1 << 12, np.int32), 0

    def bytes(self) -> int:
        return 4 * self.used + 34 * len(self.keys)

    def rows(self, keys: np.ndarray) -> np.ndarray:
        """Rows of hashes, -1 for those not known."""
        at = np.searchsorted(self.keys, keys)
        hit = at < len(self.keys)
        hit[hit] = self.keys[at[hit]] == keys[hit]
        out = np.full(len(keys), -1)
        out[hit] = self.row[at[hit]]
        return out

    def add(self, keys: np.ndarray, ids: list[list[int]], same: np.ndarray, back: np.ndarray) -> None:
        size = np.array([len(x) for x in ids], np.int64)
        total, first = int(size.sum()), len(self.size)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(ids), np.int32, total)
        self.start = np.append(self.start, self.used + np.cumsum(size) - size)
        self.used += total
        self.size, self.same, self.back = np.append(self.size, size), np.append(self.same, same), np.append(self.back, back)
        at = np.searchsorted(self.keys, keys)
        self.keys, self.row = np.insert(self.keys, at, keys), np.insert(self.row, at, np.arange(first, first + len(keys)))


class Codec:
    """Encodes and decodes batches of texts in one worker."""

    def __init__(self, data: bytes, threads: int = THREADS):
        # Before the first batch; a worker process encodes with few threads, as each core has a worker.
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        self.model = Model(data)
        self.tokenizer = self.model.tokenizer()
        self.control = frozenset(i for i, (_, _, t) in enumerate(self.model.pieces) if t == CONTROL)
        self.marked = frozenset(i for i, (p, _, t) in enumerate(self.model.pieces) if t in (NORMAL, USER) and p.startswith(MARK))
        self.known, self.checked = Segments(), True

    @functools.cached_property
    def library(self):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_proto=self.model.data)

    def ids(self, texts: list[str]) -> list[list[int]]:
        """The tokenizers library's ids."""
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def theirs(self, texts: list[str]) -> list[list[int]]:
        """The sentencepiece library's ids."""
        return self.library.encode(texts, num_threads=1)

    def plain(self, text: str) -> str:
        """What a text's ids should decode to."""
        if not self.model.plain:
            text = self.tokenizer.normalizer.normalize_str(text) if self.tokenizer.normalizer else text
            text = text[1:] if self.model.prefix and text[:1] in (MARK, " ") else text
        return text.replace(MARK, " ")

    def _new(self, texts: list[str], check: bool) -> tuple[list[list[int]], np.ndarray, np.ndarray]:
        ids = self.ids(texts)
        if not check:
            return ids, np.ones(len(ids), bool), np.ones(len(ids), bool)
        same = np.array([a == b for a, b in zip(ids, self.theirs(texts), strict=True)], bool)
        return ids, same, np.array([a == self.plain(t) for a, t in zip(self.decode_batch(ids), texts, strict=True)], bool)

    def _rows(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, check: bool) -> np.ndarray:
        """Rows of segments; new ones are learned."""
        keys, first, of = np.unique(textkit.hashes(buf, starts, ends), return_index=True, return_inverse=True)
        rows = self.known.rows(keys)
        if not (rows < 0).any():
            return rows[of]
        if self.known.bytes() > CACHE_BYTES:
            self.known = Segments()
            rows[:] = -1
        new = np.flatnonzero(rows < 0)
        # The space that begins a segment is the one the dummy prefix stands for.
        texts = [buf[a:b].tobytes().decode() for a, b in zip((starts[first[new]] + self.model.prefix).tolist(), ends[first[new]].tolist(), strict=True)]
        for k in range(0, len(new), BATCH):
            self.known.add(keys[new[k : k + BATCH]], *self._new(texts[k : k + BATCH], check))
        return self.known.rows(keys)[of]

    def encode_bytes(self, buf: np.ndarray, off: np.ndarray, check: bool = True) -> tuple[pa.ListArray, np.ndarray, np.ndarray]:
        """As ``encode``, of UTF-8 texts one behind the other."""
        if check and not self.checked:
            self.known = Segments()
        self.checked = check
        if self.model.prefix:  # each text begins with a space more
            some = off[1:] > off[:-1]
            buf = np.insert(buf, off[:-1][some], 0x20)
            off = off + np.append(0, np.cumsum(some))
        space = buf == 0x20
        start = space.copy()
        start[1:] &= ~space[:-1]
        if len(buf) > 3:  # a written marker is a space to the model
            start[3:] &= ~((buf[:-3] == _MARK[0]) & (buf[1:-2] == _MARK[1]) & (buf[2:-1] == _MARK[2]))
        if self.model.prefix:  # a text's last space alone would be nothing behind a dummy prefix
            start[off[1:][some] - 1] &= buf[off[1:][some] - 1] != 0x20
        start[off[:-1][off[1:] > off[:-1]]] = True
        starts = np.flatnonzero(start)
        bounds, sizes, same, back, flat = np.append(starts, len(buf)), [], [], [], []
        k = 0
        while k < len(starts):
            z = max(k + 1, int(np.searchsorted(bounds, bounds[k] + textkit.SLICE_BYTES, side="right")) - 1)
            low = int(bounds[k])
            rows = self._rows(buf[low : int(bounds[z])], starts[k:z] - low, bounds[k + 1 : z + 1] - low, check)
            size = self.known.size[rows]
            before = np.cumsum(size) - size
            flat.append(self.known.flat[np.repeat(self.known.start[rows] - before, size) + np.arange(int(size.sum()))])
            sizes.append(size)
            same.append(self.known.same[rows])
            back.append(self.known.back[rows])
            k = z
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        at = np.searchsorted(starts, off)
        ends = textkit.prefix(join(sizes, np.int64))
        found = pa.ListArray.from_arrays(pa.array(ends[at].astype(np.int32)), pa.array(join(flat, np.int32)))
        bad = lambda parts: np.diff(textkit.prefix((~join(parts, bool)).astype(np.int64))[at]) == 0
        return found, bad(same), bad(back)

    def encode(self, texts: list[str], check: bool = True) -> tuple[pa.ListArray, np.ndarray, np.ndarray]:
        """Ids of each text; if asked for, whether both libraries agree on it, and whether the ids decode to the normalised text."""
        if self.model.cuts:
            raw = [t.encode() for t in texts]
            return self.encode_bytes(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), check)
        ids, same, back = self._new(texts, check)
        off = np.cumsum([0, *map(len, ids)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(off), pa.array(np.fromiter(chain.from_iterable(ids), np.int32, int(off[-1])))), same, back

    def decode_batch(self, lists: list[list[int]]) -> list[str]:
        """Texts of lists of ids, long lists cut before a piece that begins with the marker."""
        if max(map(len, lists), default=0) <= DECODED and self.control.isdisjoint(chain.from_iterable(lists)):
            return self.tokenizer.decode_batch(lists, skip_special_tokens=False)
        pieces, of = [], []
        for k, ids in enumerate(lists):
            ids = [i for i in ids if i not in self.control]
            a = 0
            while a < len(ids):
                z = a + DECODED
                while z < len(ids) and ids[z] not in self.marked:
                    z += 1
                pieces.append(ids[a:z])
                of.append((k, a > 0 and self.model.prefix))
                a = z
        out: list[list[str]] = [[] for _ in lists]
        for (k, space), text in zip(of, self.tokenizer.decode_batch(pieces, skip_special_tokens=False), strict=True):
            out[k].append(" " + text if space else text)  # the decoder takes a space for the dummy prefix
        return ["".join(x) for x in out]

    def decode(self, ids: list[int]) -> str:
        return self.decode_batch([list(ids)])[0]


class Held:
    """A model's codec in a worker, built at first use and freed at a task's end."""

    def __init__(self, data: bytes):
        self.data, self.made = data, None

    def __getstate__(self):
        return self.data

    def __setstate__(self, data):
        self.__init__(data)

    def get(self) -> Codec:
        if self.made is None:
            self.made = Codec(self.data)
        return self.made

    def free(self) -> None:
        self.made = None
        textkit.tidy()


def read_model(path: str) -> bytes:
    """The model file, read on the driver; it travels to the executors with the job."""
    with open(path, "rb") as f:
        return f.read()


def _batches(held: Held, column: pa.Array, check: bool) -> Iterator[tuple[int, int, tuple]]:
    """The slices of a column, encoded."""
    for i, j, buf, off in textkit.raw_slices(column):
        c = held.get()
        yield i, j, c.encode_bytes(buf, off, check) if c.model.cuts else c.encode([buf[a:b].tobytes().decode() for a, b in zip(off, off[1:], strict=False)], check)


def encode(docs: DataFrame, data: bytes, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ids, parity with the sentencepiece library, round_trip."""
    from pyspark.sql import functions as F

    held = Held(data)

    def run(batches):
        try:
            for b in batches:
                for i, j, (found, parity, back) in _batches(held, b.column(1), True):
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), found, pa.array(parity, pa.bool_()), pa.array(back, pa.bool_())], names=[id_col, "ids", "parity", "round_trip"])
        finally:
            held.free()

    return arrow_map(docs.select(F.col(id_col), F.col(text_col).cast("string")), run, f"{id_col} long, ids array<int>, parity boolean, round_trip boolean")


def with_ids(docs: DataFrame, data: bytes, *, text_col: str = "text", to: str = "token_ids") -> DataFrame:
    """The rows with all their columns and their ids; a column that has the ids' name goes."""
    from pyspark.sql import types as T

    docs = docs.drop(to)
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(to, T.ArrayType(T.IntegerType()))])
    held = Held(data)

    def run(batches):
        try:
            for b in batches:
                for i, j, (found, _, _) in _batches(held, b.column(at), False):
                    part = b.slice(i, j - i)
                    yield pa.RecordBatch.from_arrays([*part.columns, found], names=[*part.schema.names, to])
        finally:
            held.free()

    return arrow_map(docs, run, schema)


def decode(rows: DataFrame, data: bytes, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: id, text."""
    from pyspark.sql import functions as F

    held = Held(data)

    def run(batches):
        try:
            for b in batches:
                for i in range(0, b.num_rows, 256):
                    part = b.slice(i, 256)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(held.get().decode_batch([x or [] for x in part.column(1).to_pylist()]), pa.string())], names=[id_col, "text"])
        finally:
            held.free()

    return arrow_map(rows.select(F.col(id_col), F.col(ids_col)), run, f"{id_col} long, text string")
