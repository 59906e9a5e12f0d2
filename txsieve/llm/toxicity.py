"""Toxicity: bags of subword embeddings, averaged, into a linear softmax, trained jointly in numpy.

A word is its character n-grams (three to five, with marks at both ends) and itself, hashed to
``buckets`` rows of an embedding table; its vector is their mean, so an unseen misspelling shares most
of it. A text is the mean of its words' vectors, however many there are, and a linear softmax gives
its two classes. Embeddings and softmax are trained together on whole texts by accelerated proximal
gradient steps: each bucket's input is scaled by its spread over the texts, and the length of each
bucket's vector is penalised, so the table keeps the subwords that set toxic texts apart and is zero
elsewhere; a few toxic words in a long text then stand out against nothing.

A mean over few words is noisier than one over many, so the score is calibrated by length: a
logistic map of the logarithms of the mean's toxic part and of the number of words, and their product,
fitted on margins of texts that the table of their fold was not trained on.

The model is linear after the mean, so scoring needs one number per distinct word; they are kept in a
bounded table per Python worker.

Labels: a bounded sample (``PER_CLASS`` texts of the classes 0 and 1, in hash order) trains on the driver, on
the whole texts' word counts. Every whole text is scored.

Defined cases: null and empty texts, and texts without words, score as the clean class does without
evidence; with labels of one class or none, the score is the share of 1 among them (0 if none);
repeated rows and ids are scored one by one; an empty table gives no rows.
"""

from __future__ import annotations

import copy
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, prepare
from .text import mix

WORD = re.compile(r"[^\W\d_]+")
GRAMS, BUCKETS, CACHE, PER_CLASS = (3, 4, 5), 1 << 18, 300_000, (2000, 1000)


def words(text: str | None) -> list[str]:
    """Runs of letters of the lower-cased text."""
    return WORD.findall(text.lower()) if text else []


def subwords(vocabulary: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket ids of all words' subwords, and where each word's begin. One pass over one buffer."""
    codes = np.frombuffer("".join(f"\x02{w}\x03" for w in vocabulary).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    lengths = np.array([len(w) + 2 for w in vocabulary])
    word = np.repeat(np.arange(len(vocabulary)), lengths)
    hashes, owners = [], []
    for n in GRAMS:
        m = len(codes) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint64)
        for i in range(n):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + m])
        inside = word[:m] == word[n - 1 :]
        hashes.append(h[inside])
        owners.append(word[:m][inside])
    whole = np.add.reduceat(mix(codes * np.uint64(31) + (np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.uint64)), np.cumsum(lengths) - lengths)
    hashes.append(mix(whole))
    owners.append(np.arange(len(vocabulary)))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    ids = (np.concatenate(hashes)[order] % np.uint64(buckets)).astype(np.int64)
    return ids, np.searchsorted(owner[order], np.arange(len(vocabulary)))


class Sparse:
    """A texts x buckets matrix in both orders, for products from either side; rows come in order."""

    def __init__(self, row: np.ndarray, col: np.ndarray, x: np.ndarray, n_rows: int, n_cols: int):
        self.row, self.col, self.x, self.shape = row, col, x, (n_rows, n_cols)
        self.filled, self.first = np.unique(row, return_index=True)
        order = np.argsort(col, kind="stable").astype(np.int32)
        self.row_c, self.x_c = row[order], x[order]
        self.filled_c, self.first_c = np.unique(col[order], return_index=True)

    def times(self, s: np.ndarray) -> np.ndarray:
        out = np.zeros(self.shape[0])
        if len(self.x):
            out[self.filled] = np.add.reduceat(self.x * s.astype(np.float32)[self.col], self.first, dtype=np.float64)
        return out

    def back(self, g: np.ndarray) -> np.ndarray:
        out = np.zeros(self.shape[1])
        if len(self.x):
            out[self.filled_c] = np.add.reduceat(self.x_c * g.astype(np.float32)[self.row_c], self.first_c, dtype=np.float64)
        return out

    def like(self, x: np.ndarray, x_c: np.ndarray) -> Sparse:
        out = copy.copy(self)
        out.x, out.x_c = x, x_c
        return out

    def squared(self) -> Sparse:
        return self.like(self.x**2, self.x_c**2)

    def scaled(self, by: np.ndarray) -> Sparse:
        """Columns times ``by``."""
        by = by.astype(np.float32)
        sizes = np.diff(np.r_[self.first_c, len(self.x_c)])
        return self.like(self.x * by[self.col], self.x_c * np.repeat(by[self.filled_c], sizes))

    def only(self, kept: np.ndarray) -> Sparse:
        """The kept columns."""
        at = kept[self.col]
        return Sparse(self.row[at], (np.cumsum(kept) - 1).astype(np.int32)[self.col[at]], self.x[at], self.shape[0], int(kept.sum()))


def subword_matrix(bags: list[dict[str, int]], buckets: int, least_texts: int) -> tuple[Sparse, np.ndarray, np.ndarray]:
    """Texts x buckets that ``least_texts`` texts share; these buckets; the number of words of each text.

    Two passes over a few texts at a time, so that what the rare subwords take is never held.
    """
    at: dict[str, int] = {}
    text, word, count = [], [], []
    for i, bag in enumerate(bags):
        for w, n in bag.items():
            text.append(i)
            word.append(at.setdefault(w, len(at)))
            count.append(n)
    text, word, count = np.array(text, np.int32), np.array(word, np.int32), np.array(count, np.float32)
    words_of = np.bincount(text, count, len(bags))
    ids, start = subwords(list(at), buckets)
    ids, per = ids.astype(np.int32), np.diff(np.r_[start, len(ids)])
    share = count / words_of[text] / per[word]

    def parts():
        for lo in range(0, len(bags), 100):
            a, b = np.searchsorted(text, (lo, lo + 100))
            reps = per[word[a:b]]
            if reps.sum():
                flat = np.repeat(start[word[a:b]] - np.r_[0, np.cumsum(reps)[:-1]], reps) + np.arange(reps.sum())
                key, back = np.unique(np.repeat(text[a:b].astype(np.int64), reps) * buckets + ids[flat], return_inverse=True)
                yield key, back, np.repeat(share[a:b], reps)

    seen = np.zeros(buckets, np.int64)
    for key, *_ in parts():
        seen += np.bincount(key % buckets, minlength=buckets)
    used = np.flatnonzero(seen >= least_texts)
    place = np.full(buckets, -1, np.int32)
    place[used] = np.arange(len(used))
    rows, cols, xs = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [np.zeros(0, np.float32)]
    for key, back, value in parts():
        col, x = place[key % buckets], np.bincount(back, value)
        rows.append((key // buckets)[col >= 0].astype(np.int32))
        cols.append(col[col >= 0])
        xs.append(x[col >= 0].astype(np.float32))
    return Sparse(np.concatenate(rows), np.concatenate(cols), np.concatenate(xs), len(bags), len(used)), used, words_of


@dataclass
class SubwordSoftmax:
    """E (buckets x dim), W (dim x 2), b (2), and a logistic map from mean and length to a score."""

    buckets: int = BUCKETS
    dim: int = 8
    epochs: int = 100
    penalty: float = 0.025
    least_texts: int = 8
    folds: int = 3
    seed: int = 3
    constant: float | None = None
    per_bucket: np.ndarray = field(default=None, repr=False)
    map: tuple = (1.0, 0.0, 0.0, 0.0)
    floor: float = 1.0

    def fit(self, bags: list[dict[str, int]], labels: np.ndarray) -> SubwordSoftmax:
        """``bags``: the word counts of each text. Calibration uses margins from outside the fold."""
        self.constant = float(labels.mean()) if len(labels) else 0.0
        if not 0 < self.constant < 1 or not any(bags):
            return self
        self.constant = None
        raw, used, n_words = subword_matrix(bags, self.buckets, min(self.least_texts, max(1, len(bags) // 50)))
        fold = np.arange(len(labels)) % self.folds
        margin, ok = np.zeros(len(labels)), True
        for f in range(self.folds):
            rest = fold != f
            ok &= 0 < labels[rest].mean() < 1
            if ok:
                margin[~rest] = raw.times(self._descend(raw, labels, rest))[~rest]
        table = self._descend(raw, labels, np.ones(len(labels), bool))
        self._calibrate(margin if ok else raw.times(table), n_words, labels)
        self.per_bucket = np.zeros(self.buckets)
        self.per_bucket[used] = table
        return self

    def _descend(self, raw: Sparse, labels: np.ndarray, learn: np.ndarray) -> np.ndarray:
        """The score of each used bucket, E (w1 - w0): proximal gradient with momentum on E, W, b.

        After the first steps, buckets that are at zero and whose gradient is far from moving them
        are left out of the rest.
        """
        y = labels
        weight = np.where(y == 1, 0.5 / max(1, (y * learn).sum()), 0.5 / max(1, ((1 - y) * learn).sum())) * learn
        total = raw.back(weight)
        square = raw.squared().back(weight)
        spread = np.sqrt(np.maximum(square - total**2, 1e-16))
        data = raw.scaled(1 / spread)
        rng = np.random.default_rng(self.seed)
        v = rng.normal(size=data.shape[1])
        for _ in range(8):  # the curvature, by power iteration
            v = data.back(weight * data.times(v / np.linalg.norm(v)))
        pace = 1 / (0.275 * max(np.linalg.norm(v), 1e-12))
        e = rng.normal(0, 1e-4, (data.shape[1], self.dim))
        w, b, t = rng.normal(0, 1, (self.dim, 2)), np.zeros(2), 1.0
        w /= np.linalg.norm(w[:, 1] - w[:, 0])
        ahead, ahead_b, active = e.copy(), b.copy(), np.arange(data.shape[1])
        for step in range(self.epochs):
            d = w[:, 1] - w[:, 0]
            logit = data.times(ahead @ d) + ahead_b[1] - ahead_b[0]
            g = weight * (y - 1 / (1 + np.exp(-np.clip(logit, -30, 30))))
            back = data.back(g)
            new = ahead + pace * np.outer(back, d)
            length = np.linalg.norm(new, axis=1)
            new *= np.maximum(0, 1 - pace * self.penalty / np.maximum(length, 1e-300))[:, None]
            new_b = ahead_b + 0.5 * g.sum() * np.array([-1.0, 1.0])
            # the softmax follows its own gradient; its scale is fixed, as that of the embeddings is free
            w += pace * np.outer(ahead.T @ back, [-1.0, 1.0])
            w /= np.linalg.norm(w[:, 1] - w[:, 0])
            t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
            ahead, ahead_b = new + (t - 1) / t_new * (new - e), new_b + (t - 1) / t_new * (new_b - b)
            e, b, t = new, new_b, t_new
            if step == self.epochs // 6:
                kept = (length > 0) & ((np.abs(back) > 0.5 * self.penalty) | (np.abs(e).max(1, initial=0) > 0))
                data, active, e, ahead = data.only(kept), active[kept], e[kept], ahead[kept]
        out = np.zeros(raw.shape[1])
        out[active] = e @ (w[:, 1] - w[:, 0])
        return out / spread

    def _inputs(self, margins: np.ndarray, words: np.ndarray) -> np.ndarray:
        m, n = np.log(np.maximum(margins, 0) / self.floor + 1), np.log1p(words)
        return np.stack([m, n, m * n, np.ones(len(m))], 1)

    def _calibrate(self, margins: np.ndarray, words: np.ndarray, labels: np.ndarray) -> None:
        """Logistic regression by Newton steps, both classes weighing the same."""
        self.floor = max(1e-9, 0.05 * float(np.maximum(margins, 0)[labels == 1].mean()))
        f = self._inputs(margins, words)
        scale = np.abs(f).max(0) + 1e-9
        f = f / scale
        balance = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
        theta = np.zeros(f.shape[1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(f @ theta, -30, 30)))
            h = (f * (balance * p * (1 - p))[:, None]).T @ f + 1e-2 * np.eye(len(theta))
            theta += np.linalg.solve(h, f.T @ (balance * (labels - p)) - 1e-2 * theta)
        self.map = tuple((theta / scale).tolist())

    def word_scores(self, vocabulary: list[str]) -> np.ndarray:
        if not vocabulary:
            return np.zeros(0)
        ids, start = subwords(vocabulary, self.buckets)
        return np.add.reduceat(self.per_bucket[ids], start) / np.diff(np.r_[start, len(ids)])

    def score(self, margins: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Of texts with these means of word scores, and numbers of words."""
        if self.constant is not None:
            return np.full(len(margins), self.constant)
        return 1 / (1 + np.exp(-np.clip(self._inputs(margins, words) @ np.array(self.map), -30, 30)))


def training_bags(rows: DataFrame) -> DataFrame:
    """(doc_id, label, words, counts) of (doc_id, text, label) rows, from whole texts."""

    def run(batches):
        for batch in batches:
            bags = [Counter(words(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([list(b) for b in bags], pa.list_(pa.string())),
                 pa.array([list(b.values()) for b in bags], pa.list_(pa.int64()))],
                names=["doc_id", "label", "words", "counts"],
            )

    return rows.select(F.col("doc_id").cast("long"), "text", "label").mapInArrow(
        run, "doc_id long, label int, words array<string>, counts array<long>"
    )


def fit(docs: DataFrame, labels: DataFrame, label: str, keep, per_class: tuple[int, int] = PER_CLASS, **settings) -> SubwordSoftmax:
    """Fit on at most so many labelled texts of class 0 and of class 1: the rare subwords of clean texts need more of them."""
    prepare(docs.sparkSession)
    model = SubwordSoftmax(**settings)
    sample = labelled_sample(labels, label, per_class, keep)
    rows = (
        training_bags(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "words", "counts")
        .limit(sum(per_class))
        .collect()
    )
    y = np.array([r.label for r in rows], float)
    bags = [dict(zip(r.words, r.counts, strict=True)) for r in rows]
    del rows
    return model.fit(bags, y)


def score(docs: DataFrame, model: SubwordSoftmax, threshold: float = 0.7) -> DataFrame:
    """doc_id, score, predicted of each row."""
    prepare(docs.sparkSession)

    def run(batches):
        known: dict[str, float] = {}
        for batch in batches:
            means, sizes = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for lo in range(0, batch.num_rows if model.constant is None else 0, 256):
                part = [words(t) for t in batch.column(1).slice(lo, 256).to_pylist()]
                sizes[lo : lo + len(part)] = [len(t) for t in part]
                if len(known) > CACHE:
                    known.clear()
                fresh = list({w for t in part for w in t}.difference(known))
                if fresh:
                    known.update(zip(fresh, model.word_scores(fresh).tolist(), strict=True))
                for i, t in enumerate(part):
                    means[lo + i] = sum(map(known.__getitem__, t)) / len(t) if t else 0.0
            s = model.score(means, sizes)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")
