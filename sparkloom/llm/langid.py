"""Language ID by rank-order profiles.

A profile is the list of a text's most frequent letter n-grams (one to three,
words padded with a boundary), most frequent first.  A document is compared to each
language by out-of-place distance: for each n-gram of the document's profile the
difference of its two ranks, or the profile length if the language lacks it.

Letters are folded to lower case only.  An n-gram is one number made of its code
points; within a slice its letters are numbered anew, so that documents and n-grams
sort as one array.

Profiles are learned from at most ``max_rows`` documents (``MAX_ROWS``), those first by
a hash of the id; every whole text is judged.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; equal
distances go to the language first by name; equal counts in a profile go to the n-gram
more frequent over all languages; without training rows every text is ``und``; null ids
and repeated rows are kept.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm import stats
from sparkloom.llm.arrowmap import map_text
from sparkloom.llm.textkit import CONTINUES, Slice

#: Documents to learn from at most; n-grams of a profile.
MAX_ROWS, PROFILE = 8_000, 400
#: Letters are below it: 1 to 26 for a-z, others by their code point.
CLASSES = 1 << 21
#: Known n-grams up to which a document's order is sorted as one number.
MAX_TIES = 1 << 17
UNKNOWN = "und"


@functools.cache
def letter_classes() -> np.ndarray:
    """The letter of each code point: 0 for what is none."""
    t = np.zeros(0x110000, np.int32)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            low = ord(c.lower()[0])
            t[cp] = low - 96 if 97 <= low <= 122 else low
    return t


def code_points(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """The slice's code points, and how many come before each document."""
    lead = ~CONTINUES[s.buf]
    lead[s.off[:-1][s.off[:-1] < len(s.buf)]] = True
    at = np.flatnonzero(lead)
    pad = np.append(s.buf, np.zeros(3, np.uint8)).astype(np.uint32)
    b0, b1, b2, b3 = pad[at], pad[at + 1] & 63, pad[at + 2] & 63, pad[at + 3] & 63
    cp = np.where(b0 < 0x80, b0, np.where(b0 < 0xE0, (b0 & 31) << 6 | b1, np.where(b0 < 0xF0, (b0 & 15) << 12 | b1 << 6 | b2, (b0 & 7) << 18 | b1 << 12 | b2 << 6 | b3)))
    return np.minimum(cp, 0x10FFFF), np.searchsorted(at, s.off)


def gram_numbers(g: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """n-grams of a slice's letters (places in ``letters``) as numbers of any slice, in the same order."""
    k = len(letters)
    bi, tri = k, k + k**2
    h = np.where(g >= tri, g - tri, np.where(g >= bi, g - bi, g))
    a, b, c = letters[h // k**2], letters[h // k % k], letters[h % k]
    return np.where(g >= tri, ((a + 1) * CLASSES + b) * CLASSES + c, np.where(g >= bi, (b + 1) * CLASSES + c, c))


def gram_counts(s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The slice's documents (places), their n-grams, and how often each occurs; by document."""
    cp, off = code_points(s)
    c = np.insert(letter_classes()[cp], off, 0)  # a boundary before each document, and one at the end
    doc = np.insert(np.repeat(np.arange(s.n_docs), np.diff(off)), off, np.minimum(np.arange(s.n_docs + 1), max(s.n_docs - 1, 0)))
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 0) | (c[:-1] != 0)
    c, doc = c[keep].astype(np.int64), doc[keep]
    letter = c != 0
    one, two, three = np.flatnonzero(letter), np.flatnonzero(letter[:-1] | letter[1:]), np.flatnonzero(letter[1:-1])
    two_doc = np.where(letter[two], doc[two], doc[two + 1]) if len(two) else two
    seen, number = np.zeros(0x110000, bool), np.zeros(0x110000, np.int64)
    seen[0] = True
    seen[c] = True
    letters = np.flatnonzero(seen)
    number[letters] = np.arange(len(letters))
    c = number[c]
    k = len(letters)
    grams = k + k**2 + k**3
    docs = np.concatenate([doc[one], two_doc, doc[three + 1]])
    keys = np.concatenate([c[one], k + c[two] * k + c[two + 1], k + k**2 + (c[three] * k + c[three + 1]) * k + c[three + 2]])
    if grams * max(s.n_docs, 1) < 1 << 63:
        keys += docs * grams
        keys.sort()
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        docs, found = keys[first] // grams, keys[first] % grams
    else:  # very many letters and documents in one slice
        order = np.lexsort((keys, docs))
        docs, keys = docs[order], keys[order]
        first = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])))
        docs, found = docs[first], keys[first]
    return docs, gram_numbers(found, letters), np.diff(np.append(first, len(keys)))


class Profiles:
    """Languages, each one's rank of every known n-gram (the profile length if it lacks it), and the n-grams' overall order for ties."""

    def __init__(self, rows: list[tuple[str, int, int]], length: int = PROFILE):
        self.length = length
        self.langs = sorted({r[0] for r in rows})
        own = {x: sorted(((n, -g) for y, g, n in rows if y == x), reverse=True)[:length] for x in self.langs}
        total: dict[int, int] = {}
        for n, g in (t for x in self.langs for t in own[x]):
            total[-g] = total.get(-g, 0) + n
        self.known = np.array(sorted(total), np.int64)
        # The last place is that of all other n-grams.
        self.ranks = np.full((len(self.langs), len(total) + 1), length, np.int32)
        for k, lang in enumerate(self.langs):
            self.ranks[k, np.searchsorted(self.known, [-g for _, g in own[lang]])] = np.arange(len(own[lang]))
        self.tie = np.arange(len(total) + 1)
        self.tie[np.lexsort((self.known, [-total[int(g)] for g in self.known]))] = np.arange(len(total))

    def nearest(self, n_docs: int, doc: np.ndarray, gram: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each document the closest language (-1 without n-grams), and 1 less its share of the largest possible distance."""
        lang, score = np.full(n_docs, -1), np.zeros(n_docs)
        if not len(doc) or not self.langs:
            return lang, score
        at = np.searchsorted(self.known, gram)
        gram = np.where(self.known[np.minimum(at, len(self.known) - 1)] == gram, at, len(self.known))
        # Most frequent first within a document: 24 bits of count, then the order for ties; other n-grams stay by number.
        if len(self.known) < MAX_TIES:
            order = np.argsort((doc << 41) | ((1 << 24) - 1 - np.minimum(n, (1 << 24) - 1)) << 17 | self.tie[gram], kind="stable")
        else:
            order = np.lexsort((self.tie[gram], -n, doc))
        doc, gram = doc[order], gram[order]
        start = np.searchsorted(doc, np.arange(n_docs + 1))
        place = np.arange(len(doc)) - start[doc]
        used = place < self.length
        doc, gram, place = doc[used], gram[used], place[used]
        size = np.bincount(doc, minlength=n_docs)
        far = np.empty((len(self.langs), n_docs))
        for k, ranks in enumerate(self.ranks):
            r = ranks[gram]
            far[k] = np.bincount(doc, np.where(r == self.length, self.length, np.abs(r - place)), n_docs)
        some = size > 0
        lang[some] = far.argmin(0)[some]
        score[some] = 1 - far.min(0)[some] / (self.length * size[some])
        return lang, score


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", but: tuple[int, int] | None = (4, 2), max_rows: int = MAX_ROWS, length: int = PROFILE) -> Profiles:
    rows = docs.select(F.col(id_col).alias("__id"), F.col(lang_col).alias("__lang"), F.col(text_col).alias("__text")).where(F.col("__id").isNotNull() & F.col("__lang").isNotNull() & F.col("__text").isNotNull())
    if but:
        rows = rows.where(stats.fold("__id", but[0]) != but[1])
    sample = rows.select("__id").orderBy(F.xxhash64("__id"), "__id").limit(max_rows)

    def make(ids, texts, s, langs):
        names = sorted(set(langs.to_pylist()))
        own = np.array([names.index(x) for x in langs.to_pylist()])
        doc, gram, n = gram_counts(s)
        grams, gram = np.unique(gram, return_inverse=True)
        total = np.zeros((len(names), len(grams)), np.int64)
        if len(doc):
            np.add.at(total, (own[doc], gram), n)
        which, at = total.nonzero()
        return {"lang": pa.array([names[k] for k in which], pa.string()), "gram": grams[at], "n": total[which, at]}

    counted = map_text(rows.join(F.broadcast(sample), "__id", "left_semi"), "__id", "__text", make, "lang string, gram long, n long", "__lang").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = counted.withColumn("place", place).where(F.col("place") <= length)
    return Profiles([(r.lang, r.gram, r.n) for r in top.collect()], length)


def predict(docs: DataFrame, model: Profiles, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, lang_pred, score (0 to 1, higher: closer to the language's profile)."""

    def make(ids, texts, s):
        lang, score = model.nearest(s.n_docs, *gram_counts(s))
        return {id_col: ids, "lang_pred": pa.array([model.langs[k] if k >= 0 else UNKNOWN for k in lang], pa.string()), "score": score}

    return map_text(docs, id_col, text_col, make, f"{id_col} long, lang_pred string, score double")
