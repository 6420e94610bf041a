"""Quality classifier: regularised quadratic discriminant over document statistics.

Statistics are transformed (log or square root, then standardised), each class
gets a mean and a covariance shrunk towards the pooled one and the identity, and
its Cholesky factor is inverted once and kept.  A document's score comes from the
difference of the classes' Mahalanobis log-densities, by a logistic link that is
fitted on the training rows.

Learning uses at most ``max_rows`` labelled rows (``MAX_ROWS``), chosen by a hash of
the id; scoring reads every whole text.  Only statistics of the text are inputs.

Defined cases: a null or empty text is scored as a text without words; if the
training rows hold only one class or too few rows, every score is the smoothed share
of label 1; a null id is not held out; repeated rows are all scored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import stats
from sparkloom.llm.arrowmap import arrow_map, map_text

#: Labelled rows to learn from at most.
MAX_ROWS = 20_000
SHRINK_POOLED, SHRINK_IDENTITY = 0.1, 0.05


def transform(m: np.ndarray) -> np.ndarray:
    """Shares and ratios by square root, which evens out their spread; n_words, n_chars and longest_word are logs already."""
    out = np.sqrt(np.maximum(m, 0))
    for k, name in enumerate(stats.NAMES):
        if name in ("n_words", "n_chars", "longest_word"):
            out[:, k] = m[:, k]
    return out


class Discriminant:
    """Class means, inverse Cholesky factors and log-determinants, and the link's slope and offset."""

    def __init__(self, m: np.ndarray, y: np.ndarray):
        self.prior = (float((y == 1).sum()) + 1) / (len(y) + 2)
        self.fitted = min((y == 0).sum(), (y == 1).sum()) >= 5
        if not self.fitted:
            return
        x = transform(m)
        self.mid, self.spread = x.mean(0), np.maximum(x.std(0), 1e-6)
        z = (x - self.mid) / self.spread
        d = z.shape[1]
        own = [z[y == c] for c in (0, 1)]
        self.means = [o.mean(0) for o in own]
        covs = [np.cov(o, rowvar=False, bias=True) for o in own]
        pooled = sum(len(o) * c for o, c in zip(own, covs, strict=True)) / len(z)
        self.factors, self.logdets = [], []
        for c in covs:
            c = (1 - SHRINK_POOLED - SHRINK_IDENTITY) * c + SHRINK_POOLED * pooled + SHRINK_IDENTITY * np.eye(d)
            low = np.linalg.cholesky(c)
            self.factors.append(np.linalg.inv(low))
            self.logdets.append(2 * np.log(np.diag(low)).sum())
        self.slope, self.offset = 1.0, 0.0
        self._link(self.margin(m), y)

    def margin(self, m: np.ndarray) -> np.ndarray:
        """Log-density of class 1 less that of class 0, squashed so that far documents stay finite."""
        z = (transform(m) - self.mid) / self.spread
        a, b = (np.square((z - mu) @ f.T).sum(1) + ld for mu, f, ld in zip(self.means, self.factors, self.logdets, strict=True))
        return np.arcsinh((a - b) / 2)

    def _link(self, t: np.ndarray, y: np.ndarray) -> None:
        """Newton steps of a ridge logistic regression on the margin."""
        w = np.array([1.0, 0.0])
        x = np.stack([t, np.ones_like(t)], 1)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
            g = x.T @ (p - y) + 1e-2 * w
            h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
            w = w - np.linalg.solve(h, g)
        if np.isfinite(w).all() and w[0] > 0:
            self.slope, self.offset = float(w[0]), float(w[1])

    def score(self, m: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(m), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(m) + self.offset, -35, 35)))


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", max_rows: int = MAX_ROWS, but: tuple[int, int] | None = (3, 1), id_col: str = "doc_id", text_col: str = "text") -> Discriminant:
    return Discriminant(*stats.training_rows(docs, labels, label, max_rows, id_col=id_col, text_col=text_col, but=but))


def score(docs: DataFrame, model: Discriminant, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, score (0 to 1), predicted (1 from 0.5)."""

    def make(ids, texts, s):
        p = model.score(stats.matrix(stats.counts(s)))
        return {id_col: ids, "score": p, "predicted": (p >= 0.5).astype(np.int32)}

    return map_text(docs, id_col, text_col, make, f"{id_col} long, score double, predicted int")


def keep_good(docs: DataFrame, model: Discriminant, *, text_col: str = "text") -> DataFrame:
    """The rows that the model doesn't reject, with all their columns."""
    import pyarrow as pa

    from sparkloom.llm import textkit

    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            for i, j, s in textkit.slices(b.column(at)):
                kept = b.slice(i, j - i).filter(pa.array(model.score(stats.matrix(stats.counts(s))) >= 0.5))
                if kept.num_rows:
                    yield kept

    return arrow_map(docs, run, docs.schema)


def held_out(id_col: str, fold: tuple[int, int] = (3, 1)):
    return F.coalesce(stats.fold(id_col, fold[0]) == fold[1], F.lit(False))
