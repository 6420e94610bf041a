"""Document statistics, counted on the word kernel for a slice of documents at once."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import textkit
from sparkloom.llm.textkit import CONTINUES, Slice


def _table(chars: str) -> np.ndarray:
    t = np.zeros(256, bool)
    t[[ord(c) for c in chars]] = True
    return t


#: Fixed values of the contract: characters that count as symbols.
SYMBOLS = _table("#*$%&|<>")
UPPER, LOWER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("abcdefghijklmnopqrstuvwxyz")
DIGIT, STOPS, SHOUT = _table("0123456789"), _table(".,;:?"), _table("!")
LEAD = np.zeros(256, bool)
LEAD[0xC0:] = True
REPEAT_WINDOW = 5

#: Names of the statistics, in the order of the matrix.
NAMES = (
    "n_words", "n_chars", "mean_word", "sd_word", "symbols_per_word", "bars_per_word", "upper_share", "digit_share", "shouts_per_word",
    "stops_per_word", "wide_share", "short_words", "distinct_words", "repeat_words", "dup_lines", "lines_per_word", "chars_outside_words", "longest_word",
)


def counts(s: Slice) -> dict[str, np.ndarray]:
    """Whole-number counts of each document."""
    word_doc = s.word_doc()
    at, h = s.windows(REPEAT_WINDOW)
    twice, _ = textkit.repeated(word_doc[at], h)
    covered = s.covered(at[twice], REPEAT_WINDOW)
    doc, a, b = textkit.lines(s)
    _, again = textkit.repeated(doc, s.spans(a, b, 1))
    points = ~CONTINUES[s.buf]
    sums = textkit.prefix(points.astype(np.int64))
    length = sums[s.ends] - sums[s.starts]
    _, later = textkit.repeated(word_doc, s.words())
    longest = np.zeros(s.n_docs, np.int64)
    np.maximum.at(longest, word_doc, length)
    return {
        "n_words": s.n_words.astype(np.int64),
        "word_chars": s.per_doc_words(length),
        "word_chars2": s.per_doc_words(length * length),
        "n_chars": s.per_doc(points),
        "n_symbols": s.per_doc(SYMBOLS[s.buf]),
        "n_bars": s.per_doc(s.buf == 0x7C),
        "n_upper": s.per_doc(UPPER[s.buf]),
        "n_lower": s.per_doc(LOWER[s.buf]),
        "n_digits": s.per_doc(DIGIT[s.buf]),
        "n_shouts": s.per_doc(SHOUT[s.buf]),
        "n_stops": s.per_doc(STOPS[s.buf]),
        "n_wide": s.per_doc(LEAD[s.buf]),
        "n_short": s.per_doc_words(length <= 3),
        "n_later": s.per_doc_words(later),
        "n_repeat_words": s.per_doc_words(covered),
        "n_lines": np.bincount(doc, minlength=s.n_docs).astype(np.int64),
        "n_dup_lines": np.bincount(doc[again], minlength=s.n_docs).astype(np.int64),
        "longest": longest,
    }


def matrix(c: dict[str, np.ndarray]) -> np.ndarray:
    """One row of NAMES for each document; finite for every document, also without words."""
    words = np.maximum(c["n_words"], 1)
    letters = np.maximum(c["n_upper"] + c["n_lower"], 1)
    chars = np.maximum(c["n_chars"], 1)
    mean = c["word_chars"] / words
    cols = [
        np.log1p(c["n_words"]), np.log1p(c["n_chars"]), mean, np.sqrt(np.maximum(c["word_chars2"] / words - mean * mean, 0)), c["n_symbols"] / words, c["n_bars"] / words,
        c["n_upper"] / letters, c["n_digits"] / chars, c["n_shouts"] / words, c["n_stops"] / words, c["n_wide"] / chars, c["n_short"] / words,
        1 - c["n_later"] / words, c["n_repeat_words"] / words, c["n_dup_lines"] / np.maximum(c["n_lines"], 1), c["n_lines"] / words, 1 - c["word_chars"] / chars, np.log1p(c["longest"]),
    ]
    return np.stack([np.asarray(x, np.float64) for x in cols], axis=1) if len(words) else np.zeros((0, len(NAMES)))


def fold(doc_id: str, of: int):
    """crc32 of an id's text, modulo."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % of


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int, *, id_col: str = "doc_id", text_col: str = "text", but: tuple[int, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and 0/1 labels of at most ``most`` labelled rows.

    The rows are those first by a hash of their id, so the sample is the same for any
    partitioning; ``but`` leaves a fold (of, remainder) out.  The sampled labels are bounded
    by ``most``, so they are broadcast; texts stay on the executors, only statistics return.
    """
    from sparkloom.llm.arrowmap import map_text

    rows = labels.select(F.col(id_col).alias("__id"), F.col(label).cast("int").alias("__y")).where(F.col("__id").isNotNull() & F.col("__y").isin(0, 1))
    if but:
        rows = rows.where(fold("__id", but[0]) != but[1])
    sample = rows.orderBy(F.xxhash64("__id"), "__id", "__y").limit(most)
    d = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(sample), "__id")

    def make(ids, texts, s, y):
        m = matrix(counts(s))
        return {"id": ids, "y": y} | {f"x{k}": m[:, k] for k in range(m.shape[1])}

    schema = "id long, y int, " + ", ".join(f"x{k} double" for k in range(len(NAMES)))
    # Rows with equal ids are one: of their statistics the smallest, so no more than ``most`` rows return.
    x = [f"x{k}" for k in range(len(NAMES))]
    one = map_text(d, "__id", "__text", make, schema, "__y").groupBy("id", "y").agg(F.min(F.struct(*x)).alias("x")).select("id", "y", "x.*")
    t = one.toPandas().sort_values(["id", "y"], kind="stable")
    return t[x].to_numpy(np.float64).reshape(-1, len(NAMES)), t["y"].to_numpy(np.int64)
