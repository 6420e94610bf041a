"""Quality rules: gradient-boosted trees over document statistics.

Trees are grown on histograms (logistic loss, Newton leaves) and flattened into
numpy node arrays, so that scoring moves all documents one level down a tree at a
time.  Chosen statistics are monotonic: a split on one of them is only made if the
two sides' values keep the order, and both subtrees keep to their side of the
middle, so more of it never raises the score.

Learning uses at most ``max_rows`` labelled rows (``MAX_ROWS``); every whole text is judged.

Defined cases: a null or empty text has no words and fails the base rule; with
fewer than five training rows of a class every score is the smoothed share of label 1;
null ids and repeated rows are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sparkloom.llm import stats
from sparkloom.llm.arrowmap import map_text

MAX_ROWS = 20_000
TREES, DEPTH, RATE, BINS, RIDGE, LEAST = 60, 4, 0.15, 64, 1.0, 10.0
#: Statistics of which more never helps a document.
FALLING = ("symbols_per_word", "bars_per_word", "shouts_per_word", "repeat_words", "dup_lines")

# Fixed values of the contract's base rule.
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20


class Trees:
    """Node arrays of all trees: statistic (-1 at a leaf), threshold, left child (right: one more), value."""

    def __init__(self, m: np.ndarray, y: np.ndarray, falling: tuple[str, ...] = FALLING):
        self.prior = (float((y == 1).sum()) + 1) / (len(y) + 2)
        self.bias = float(np.log(self.prior / (1 - self.prior)))
        self.sign = np.array([-1 if n in falling else 0 for n in stats.NAMES])
        self.feature, self.threshold, self.left, self.value = (np.zeros(0, t) for t in (np.int32, np.float64, np.int32, np.float64))
        self.roots = np.zeros(0, np.int32)
        if min((y == 0).sum(), (y == 1).sum()) < 5:
            return
        self.cuts = [np.unique(np.quantile(m[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(m.shape[1])]
        codes = np.stack([np.searchsorted(c, m[:, k], side="left") for k, c in enumerate(self.cuts)], 1)
        out, nodes, roots = np.full(len(y), self.bias), [], []
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-out))
            roots.append(len(nodes))
            self._grow(codes, p - y, p * (1 - p), nodes, out)
        self.feature, self.threshold, self.left, self.value = (np.array([n[k] for n in nodes], t) for k, t in enumerate((np.int32, np.float64, np.int32, np.float64)))
        self.roots = np.array(roots, np.int32)

    def _grow(self, codes, g, h, nodes, out) -> None:
        nodes.append(None)
        todo = [(len(nodes) - 1, np.arange(len(g)), 0, -np.inf, np.inf)]
        while todo:
            place, rows, depth, low, high = todo.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            value = float(np.clip(-gs / (hs + RIDGE), low, high))
            best = self._split(codes[rows], g[rows], h[rows], gs, hs, low, high) if depth < DEPTH else None
            if best is None:
                nodes[place] = (-1, 0.0, 0, RATE * value)
                out[rows] += RATE * value
                continue
            k, cut, lv, rv = best
            goes = codes[rows, k] <= cut
            nodes[place] = (k, float(self.cuts[k][cut]), len(nodes), 0.0)
            nodes += [None, None]
            mid = (lv + rv) / 2
            bounds = [(low, high), (low, high)] if not self.sign[k] else [(mid, high), (low, mid)]
            for side, part, (a, b) in zip((0, 1), (rows[goes], rows[~goes]), bounds, strict=True):
                todo.append((nodes[place][2] + side, part, depth + 1, a, b))

    def _split(self, codes, g, h, gs, hs, low, high):
        best, gain = None, 1e-6
        for k, cuts in enumerate(self.cuts):
            if not len(cuts):
                continue
            gl = np.cumsum(np.bincount(codes[:, k], g, len(cuts) + 1))[:-1]
            hl = np.cumsum(np.bincount(codes[:, k], h, len(cuts) + 1))[:-1]
            nl = np.cumsum(np.bincount(codes[:, k], minlength=len(cuts) + 1))[:-1]
            lv, rv = (np.clip(-a / (b + RIDGE), low, high) for a, b in ((gl, hl), (gs - gl, hs - hl)))
            won = gl * gl / (hl + RIDGE) + (gs - gl) ** 2 / (hs - hl + RIDGE) - gs * gs / (hs + RIDGE)
            ok = (nl >= LEAST) & (len(codes) - nl >= LEAST) & ((lv >= rv) if self.sign[k] else True)
            won = np.where(ok, won, -1)
            i = int(won.argmax())
            if won[i] > gain:
                best, gain = (k, i, float(lv[i]), float(rv[i])), won[i]
        return best

    def score(self, m: np.ndarray) -> np.ndarray:
        out = np.full(len(m), self.bias)
        rows = np.arange(len(m))
        for root in self.roots:
            at = np.full(len(m), root)
            for _ in range(DEPTH):
                f = self.feature[at]
                down = self.left[at] + (m[rows, np.maximum(f, 0)] > self.threshold[at])
                at = np.where(f >= 0, down, at)
            out += self.value[at]
        return 1 / (1 + np.exp(-np.clip(out, -35, 35)))


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", max_rows: int = MAX_ROWS, but: tuple[int, int] | None = None, id_col: str = "doc_id", text_col: str = "text") -> Trees:
    return Trees(*stats.training_rows(docs, labels, label, max_rows, id_col=id_col, text_col=text_col, but=but))


def judge(docs: DataFrame, model: Trees, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, the base counts, base_failed, score and kept."""

    def make(ids, texts, s):
        c = stats.counts(s)
        failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])
        p = model.score(stats.matrix(c))
        return {id_col: ids, "base_failed": pa.array(failed), "score": p, "kept": pa.array(~failed & (p >= 0.5))} | {k: c[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}

    return map_text(docs, id_col, text_col, make, f"{id_col} long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean")
