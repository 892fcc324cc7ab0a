"""Quality classifier: positive-unlabelled learning with the non-negative risk estimator."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.llm.common import held_out, texts
from strataflow.llm.rolling import Words, chunks

_CHUNK = 2 << 20
#: Byte classes, counted for each text as shares of its bytes.
_CLASSES = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:", b"!?", b"'\"()-", b"#$%&*+/<=>@[\\]^_`{|}~", b" ", b"\n\r\t", bytes(range(128, 256))]
_CLASS = np.full(256, len(_CLASSES), np.uint8)
for _k, _c in enumerate(_CLASSES):
    _CLASS[list(_c)] = _k
N_FEATURES = len(_CLASSES) + 1 + 13


def _distinct(group: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values, count of the commonest value) in each of n groups, group ascending."""
    if not len(values):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((values, group))
    g, v = group[order], values[order]
    edge = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (v[1:] != v[:-1])]))
    size = np.diff(np.append(edge, len(v)))
    top = np.zeros(n)
    np.maximum.at(top, g[edge], size)
    return np.bincount(g[edge], minlength=n).astype(float), top


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of numbers for each text: byte classes, word shapes, repetition, lines. All of the text counts."""
    n, size = len(offsets) - 1, np.diff(offsets)
    full = np.maximum(size, 1)[:, None]
    text = np.repeat(np.arange(n), size)
    kinds = _CLASS[data] if len(data) else np.zeros(0, np.uint8)
    shares = np.bincount(text * (len(_CLASSES) + 1) + kinds, minlength=n * (len(_CLASSES) + 1)).reshape(n, -1) / full
    w = Words(data, offsets, lower=True)
    of = np.repeat(np.arange(n), w.counts)
    words = np.maximum(w.counts, 1)
    length = (w.ends - w.starts).astype(float)
    mean = np.bincount(of, length, n) / words
    spread = np.sqrt(np.maximum(np.bincount(of, length**2, n) / words - mean**2, 0))
    last = kinds[w.ends - 1] if len(w.ends) else np.zeros(0, np.uint8)
    before = kinds[np.maximum(w.ends - 2, 0)] if len(w.ends) else np.zeros(0, np.uint8)
    odd = (last >= 4) & (last <= 6)
    doubled = odd & (length > 1) & (before == last)
    upper = kinds[w.starts] == 1 if len(w.starts) else np.zeros(0, bool)
    same = np.zeros(len(of), bool)
    same[1:] = (of[1:] == of[:-1]) & (w.hashes[1:] == w.hashes[:-1])
    distinct, top = _distinct(of, w.hashes, n)
    at, grams = w.windows(3)
    in_text = of[at]
    gram_n = np.maximum(np.bincount(in_text, minlength=n), 1)
    gram_d, gram_top = _distinct(in_text, grams, n)
    lines = np.bincount(text[data == 10], minlength=n) + 1 if len(data) else np.ones(n)
    share = lambda mask: np.bincount(of[mask], minlength=n) / words
    cols = [np.log1p(w.counts), mean, spread, share(odd), share(doubled), share(upper), share(length == 1), share(same), distinct / words, top / words, gram_d / gram_n, gram_top / gram_n, np.log1p(lines)]
    return np.column_stack([shares, *cols])


class NonNegativePU:
    """A small network fitted to the non-negative unbiased risk of positives and unlabelled rows.

    Risk: prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)) with the sigmoid loss; where the second part of a
    batch falls below zero, its gradient is turned round instead, so that the fit does not go on to overfit.
    """

    def __init__(self, hidden: int = 16, epochs: int = 60, batch: int = 512, rate: float = 0.01, decay: float = 1e-4, seed: int = 7):
        self.hidden, self.epochs, self.batch, self.rate, self.decay, self.seed = hidden, epochs, batch, rate, decay, seed

    def _normal(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def fit(self, positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> NonNegativePU:
        rng = np.random.default_rng(self.seed)
        both = np.concatenate([positive, unlabelled])
        self.mean, self.scale = both.mean(axis=0), both.std(axis=0) + 1e-6
        p, u = self._normal(positive), self._normal(unlabelled)
        d, h = p.shape[1], self.hidden
        self.weights = [rng.normal(0, d**-0.5, (d, h)), np.zeros(h), rng.normal(0, h**-0.5, h), np.zeros(1)]
        m, v, t = [np.zeros_like(w) for w in self.weights], [np.zeros_like(w) for w in self.weights], 0
        steps = max(1, -(-len(u) // self.batch))
        for _ in range(self.epochs):
            shuffled = rng.permutation(len(u))
            for k in range(steps):
                xu, xp = u[shuffled[k * self.batch : (k + 1) * self.batch]], p[rng.integers(0, len(p), self.batch)]
                zp, hp = self._raw(xp)
                zu, hu = self._raw(xu)
                sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))  # the loss of y is sigmoid(-y z)
                negative = su.mean() - prior * sp.mean()
                slope_p, slope_u = sp * (1 - sp) / len(zp), su * (1 - su) / len(zu)
                if negative >= 0:
                    gp, gu = -2 * prior * slope_p, slope_u
                else:
                    gp, gu = prior * slope_p, -slope_u
                grads = [a + b + self.decay * w for a, b, w in zip(self._back(xp, hp, gp), self._back(xu, hu, gu), self.weights, strict=True)]
                t += 1
                for i, g in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    self.weights[i] = self.weights[i] - self.rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        return self

    def _raw(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b, c, d = self.weights
        h = np.tanh(x @ a + b)
        return np.clip(h @ c + d[0], -30, 30), h

    def _back(self, x: np.ndarray, h: np.ndarray, g: np.ndarray) -> list[np.ndarray]:
        inner = np.outer(g, self.weights[2]) * (1 - h * h)
        return [x.T @ inner, inner.sum(axis=0), h.T @ g, np.array([g.sum()])]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self._raw(self._normal(x))[0]))


def training_features(docs: DataFrame, labels: DataFrame, label_col: str, max_rows: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray, float | None]:
    """(kind, features, prior) from the training folds: kind 1 positive, 0 unlabelled; the class prior.

    At most max_rows different rows (id and text) of each kind, those of the least keys, a hash of the row. Of
    positives these are taken among the rows of the max_rows least hashed ids. Unlabelled rows are looked for
    under a bound on the key that four times max_rows should meet, and under a higher one as long as too few
    different ones are found; so the sample does not depend on it. The prior is the share of positives among all
    labelled rows of these folds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in chunks(batches, 0, _CHUNK):
            x = features(data, offsets)
            yield pa.RecordBatch.from_arrays([rows.column(1), pa.array(list(x), pa.list_(pa.float64()))], ["key", "x"])

    def least(rows: DataFrame) -> np.ndarray:
        made = rows.select("text", "key").mapInArrow(run, "key long, x array<double>").dropDuplicates(["key"])
        got = made.orderBy(F.shiftrightunsigned("key", 11), "key").limit(max_rows).toArrow()["x"].combine_chunks()
        return got.flatten().to_numpy().reshape(len(got), N_FEATURES)

    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    prior = known.agg(F.avg((F.col(label_col) == 1).cast("double"))).first()[0]
    ids = known.where(F.col(label_col) == 1).select(F.col(id_col).cast("long").alias("doc_id")).distinct()
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    each = texts(docs, id_col, text_col).where(F.col("doc_id").isNotNull()).withColumn("key", F.xxhash64("doc_id", "text"))
    positive, rows = least(each.join(F.broadcast(ids), "doc_id")), docs.count()  # max_rows ids are broadcast
    share = min(1.0, 4 * max_rows / max(rows, 1))
    while True:
        web = least(each.where(~held_out(F.col("doc_id")) & (F.shiftrightunsigned("key", 11) < int(share * (1 << 53)))))
        if len(web) >= max_rows or share >= 1:
            break
        share = min(1.0, 8 * share)
    kind, x = np.repeat([0, 1], [len(web), len(positive)]), np.concatenate([web, positive])
    order = np.lexsort([*x.T, kind])
    return kind[order], x[order], prior


def fit_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_rows: int = 8000, id_col: str = "doc_id", text_col: str = "text") -> NonNegativePU | float:
    """The model, or a constant score where there is no positive row to learn from.

    Fitted on the driver from the feature rows of at most max_rows positives and max_rows unlabelled documents
    of the training folds, however often an id or a row is repeated; the labels of negatives are used for the
    estimate of the prior alone.
    """
    kind, x, prior = training_features(docs, labels, label_col, max_rows, id_col, text_col)
    if prior is None or not (kind == 1).any() or not (kind == 0).any():
        return 0.5 if prior is None else float(prior)
    return NonNegativePU().fit(x[kind == 1], x[kind == 0], float(np.clip(prior, 0.02, 0.98)))


def scores_of(model: NonNegativePU | float, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.full(len(offsets) - 1, model) if isinstance(model, float) else model.score(features(data, offsets))


def quality_scores(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_rows: int = 8000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted): how likely a document's label is 1.

    Rows whose crc32(doc_id as text) mod 3 is 1 are held out: neither their labels nor their texts are learned
    from. A score comes from the text alone, all of it. Null texts are empty texts, which get a score as any
    other; null ids stay null and are never learned from; equal rows get equal scores and are learned from once.
    A score of exactly 0.5 predicts 1. A text of any length is scored whole. Without a positive
    label every score is the share of positives, or 0.5 without labels. An empty table: no rows.

    One pass over the documents without a shuffle; the model is a few hundred numbers.
    """
    model = fit_quality(docs, labels, label_col, max_rows, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in chunks(batches, 1, _CHUNK):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(scores_of(model, data, offsets))], ["doc_id", "score"])

    out = texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, label_col: str = "quality", max_rows: int = 8000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose score reaches the threshold; one exactly at it stays.

    Null texts are scored as empty ones and stay null where they stay. Null ids and equal rows are judged as any
    row, by the text alone; a text of any length is scored whole. Without labels all rows score 0.5. An empty
    table gives an empty table.
    """
    model, at = fit_quality(docs, labels, label_col, max_rows, id_col, text_col), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column(at).fill_null("")
            bare = iter([pa.RecordBatch.from_arrays([text], ["text"])])
            score = np.concatenate([np.zeros(0), *[scores_of(model, data, offsets) for _, data, offsets in chunks(bare, 0, _CHUNK)]])
            yield b.filter(pa.array(score >= threshold))

    return docs.mapInArrow(run, docs.schema)
