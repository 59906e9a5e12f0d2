"""Quality classifier: a generalised additive model with pairwise interactions.

Each text becomes a dozen ratios (letters, symbols, repeats, ...). Cyclic boosting fits one
shallow tree per feature and round, on the feature's histogram, and adds it to that feature's
lookup table; then the strongest feature pairs get two-dimensional tables in the same way.
A text is scored by adding up the table entries of its bins, for a whole Arrow batch at once.

Labels: a bounded sample (``per_class`` rows of each class, in hash order) trains the model on
the driver; the features of the sample are computed in Spark. Every text is scored.

Defined cases: null and empty texts are scored as texts with all features zero; a null or
repeated id is scored row by row; with labels of one class, or none, the score is the share of
1 among them (0.5 if there are none); unlabelled rows and labels other than 0 and 1 don't train.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, labelled_sample, prepare
from .text import shingle_hashes, word_hashes

FEATURES = (
    "log_chars", "upper", "symbols", "pipes", "exclaims", "digits", "spaces", "punctuation",
    "word_length", "distinct_words", "repeated_next", "distinct_shingles", "line_words",
)
_KIND = np.zeros(256, np.uint8)
for _i, _chars in enumerate(
    (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*@~^<>{}[]\\=+_`", b"|", b"!?", b"0123456789", b" \t\n\r", b".,;:'\"()-/"), 1
):
    _KIND[list(_chars)] = _i


def features(text: str | None) -> np.ndarray:
    """The features of one text, in the order of FEATURES; all zero for a null or empty text."""
    out = np.zeros(len(FEATURES))
    if not text:
        return out
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    count = np.bincount(_KIND[raw], minlength=8).astype(float)
    words = word_hashes(text)
    n, m = len(raw), max(1, len(words))
    shingles = shingle_hashes(words)
    out[0] = np.log1p(n)
    out[1] = count[1] / max(1.0, count[1] + count[0])
    out[2:8] = count[2:8] / n
    out[8] = (count[0] + count[1]) / m
    out[9] = len(np.unique(words)) / m
    out[10] = float((words[1:] == words[:-1]).mean()) if len(words) > 1 else 0.0
    out[11] = len(np.unique(shingles)) / max(1, len(shingles))
    out[12] = np.log1p(m / (1 + text.count("\n")))
    return out


def _tree(gain_of, lo: int, hi: int, depth: int, leaves: list) -> None:
    """Split the bins lo .. hi - 1 where the gain is largest, down to ``depth``."""
    cut = gain_of(lo, hi) if depth else None
    if cut is None:
        leaves.append((lo, hi))
    else:
        _tree(gain_of, lo, cut, depth - 1, leaves)
        _tree(gain_of, cut, hi, depth - 1, leaves)


def _shallow(g: np.ndarray, h: np.ndarray, depth: int, l2: float) -> np.ndarray:
    """The Newton step of a tree on a histogram of gradients g and curvatures h, bin by bin."""
    cg, ch = np.r_[0, np.cumsum(g)], np.r_[0, np.cumsum(h)]

    def gain_of(lo, hi):
        if hi - lo < 2:
            return None
        k = np.arange(lo + 1, hi)
        gl, hl, gr, hr = cg[k] - cg[lo], ch[k] - ch[lo], cg[hi] - cg[k], ch[hi] - ch[k]
        ga, ha = cg[hi] - cg[lo], ch[hi] - ch[lo]
        gain = gl**2 / (hl + l2) + gr**2 / (hr + l2) - ga**2 / (ha + l2)
        best = int(np.argmax(gain))
        return int(k[best]) if gain[best] > 1e-9 else None

    leaves: list = []
    _tree(gain_of, 0, len(g), depth, leaves)
    step = np.zeros(len(g))
    for lo, hi in leaves:
        step[lo:hi] = (cg[hi] - cg[lo]) / (ch[hi] - ch[lo] + l2)
    return step


class AdditiveModel:
    """score(x) = sigmoid(bias + sum of one table entry per feature and per chosen pair)."""

    def __init__(self, bins=32, pair_bins=8, rounds=150, pair_rounds=60, pairs=6, rate=0.15, depth=2, l2=1.0):
        self.bins, self.pair_bins, self.rounds, self.pair_rounds = bins, pair_bins, rounds, pair_rounds
        self.n_pairs, self.rate, self.depth, self.l2 = pairs, rate, depth, l2
        self.bias, self.edges, self.coarse, self.tables, self.pairs = 0.0, [], [], [], []

    @staticmethod
    def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
        return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], method="nearest"))

    def _bin(self, x: np.ndarray, edges: list) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)], 1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        if not len(y) or y.min() == y.max():
            rate = float(np.mean(y)) if len(y) else 0.5
            self.bias = float(np.log(max(rate, 1e-6) / max(1 - rate, 1e-6)))
            self.edges = self.coarse = []
            return self
        self.edges = [self._cuts(x[:, j], self.bins) for j in range(x.shape[1])]
        self.coarse = [self._cuts(x[:, j], self.pair_bins) for j in range(x.shape[1])]
        weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))  # both classes weigh the same
        b, c = self._bin(x, self.edges), self._bin(x, self.coarse)
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        f = np.zeros(len(y))

        def pull():
            p = 1 / (1 + np.exp(-f))
            return weight * (y - p), weight * p * (1 - p)

        for _ in range(self.rounds):
            for j, t in enumerate(self.tables):
                g, h = pull()
                step = self.rate * _shallow(
                    np.bincount(b[:, j], g, len(t)), np.bincount(b[:, j], h, len(t)), self.depth, self.l2
                )
                t += step
                f += step[b[:, j]]
        g, h = pull()
        found = []
        for i in range(x.shape[1]):
            for j in range(i):
                k = c[:, i] * (len(self.coarse[j]) + 1) + c[:, j]
                gg, hh = np.bincount(k, g), np.bincount(k, h)
                found.append((float((gg**2 / (hh + self.l2)).sum()), i, j))
        for _, i, j in sorted(found, reverse=True)[: self.n_pairs]:
            self.pairs.append((i, j, np.zeros((len(self.coarse[i]) + 1, len(self.coarse[j]) + 1))))
        for _ in range(self.pair_rounds):
            for i, j, t in self.pairs:
                g, h = pull()
                k = c[:, i] * t.shape[1] + c[:, j]
                gg, hh = (np.bincount(k, v, t.size).reshape(t.shape) for v in (g, h))
                # a tree of two levels: one cut along the first axis, then one along the second in each half
                rows = _shallow(gg.sum(1), hh.sum(1), 1, self.l2)
                step = np.zeros(t.shape)
                for v in np.unique(rows):
                    m = rows == v
                    step[m] = _shallow(gg[m].sum(0), hh[m].sum(0), 1, self.l2)
                t += self.rate * step
                f += self.rate * step[c[:, i], c[:, j]]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.bias)
        if self.edges and len(x):
            b, c = self._bin(x, self.edges), self._bin(x, self.coarse)
            for j, t in enumerate(self.tables):
                f += t[b[:, j]]
            for i, j, t in self.pairs:
                f += t[c[:, i], c[:, j]]
        return 1 / (1 + np.exp(-np.clip(f, -30, 30)))


def feature_rows(docs: DataFrame) -> DataFrame:
    """(label, features) of (text, label) rows."""

    def run(batches):
        for batch in batches:
            x = [features(t).tolist() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), pa.array(x, pa.list_(pa.float64()))], names=["label", "features"]
            )

    return docs.select("text", "label").mapInArrow(run, "label int, features array<double>")


def fit(docs: DataFrame, labels: DataFrame, label: str, keep, per_class: int = 6000, **settings) -> AdditiveModel:
    """Fit on at most per_class labelled texts of each class."""
    prepare(docs.sparkSession)
    sample = labelled_sample(labels, label, per_class, keep)
    rows = (
        feature_rows(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"))
        .orderBy(F.xxhash64("features"), "features", "label")
        .limit(2 * per_class)
        .collect()
    )
    x = np.array([r.features for r in rows], float).reshape(len(rows), len(FEATURES))
    return AdditiveModel(**settings).fit(x, np.array([r.label for r in rows], float))


def score(docs: DataFrame, model: AdditiveModel, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` with quality_score and quality_predicted added (replaced if there)."""
    prepare(docs.sparkSession)
    docs = docs.drop("quality_score", "quality_predicted")
    added = [T.StructField("quality_score", T.DoubleType()), T.StructField("quality_predicted", T.IntegerType())]
    schema = T.StructType([*docs.schema.fields, *added])

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            s = model.score(np.array([features(t) for t in texts]).reshape(len(texts), len(FEATURES)))
            p = pa.array((s >= threshold).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(s), p], names=[*batch.schema.names, "quality_score", "quality_predicted"]
            )

    return docs.mapInArrow(run, schema)


def held_out_training(label_column: str = "doc_id"):
    """The condition that admits a labelled row to training: the fold of remainder 2 is held out."""
    return crc_mod(label_column, 4) != 2
