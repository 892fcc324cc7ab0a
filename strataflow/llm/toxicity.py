"""Toxicity: a linear-chain conditional random field tags toxic words; marginals give scores and offsets."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.llm.common import held_out, texts
from strataflow.llm.rolling import Words, chunks, mix, span_hashes_to

_CHUNK = 1 << 20
_EDGE = np.zeros(256, bool)
_EDGE[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
BUCKETS = 1 << 20
#: Feature kinds of a word: the word itself and its first letters.
_PREFIXES = (3, 4, 5, 6, 7)
_KINDS = 1 + len(_PREFIXES)


def word_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Buckets of the features of every word of some texts: itself and its prefixes, lower-cased, without signs at
    its ends; 0 for a prefix that is as long as the word, and for a word of signs alone."""
    low = [data[s:e].tobytes().decode("utf-8", "replace").lower().encode() for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    data = np.frombuffer(b"".join(low), np.uint8)
    w = Words(data, np.cumsum([0, *map(len, low)]), hashed=False)
    out = np.zeros((len(w.starts), _KINDS), np.int32)
    inner = np.flatnonzero(~_EDGE[data])
    if not len(inner):
        return out
    start = inner[np.minimum(np.searchsorted(inner, w.starts), len(inner) - 1)]
    end = inner[np.maximum(np.searchsorted(inner, w.ends) - 1, 0)] + 1
    own = np.flatnonzero((start >= w.starts) & (end > start) & (end <= w.ends))
    start, end = start[own], end[own]
    letter = np.flatnonzero((data & 0xC0) != 0x80)  # where each letter begins
    first = np.searchsorted(letter, start)
    ends = [end, *[letter[np.minimum(first + k, len(letter) - 1)] for k in _PREFIXES]]
    whole = [np.ones(len(own), bool), *[(first + k < len(letter)) & (e < end) for k, e in zip(_PREFIXES, ends[1:], strict=True)]]
    for kind, (h, ok) in enumerate(zip(span_hashes_to(data, start, ends), whole, strict=True)):
        seeded = mix(h ^ np.uint64(0x9E3779B97F4A7C15 * (kind + 1) % (1 << 64)))
        out[own, kind] = np.where(ok, seeded % np.uint64(BUCKETS - 1) + np.uint64(1), 0)
    return out


def _features(word: bytes) -> tuple[int, ...]:
    """The buckets of one word."""
    return tuple(word_features(np.frombuffer(word, np.uint8), np.array([0, len(word)]))[0].tolist())


def marginals(score: np.ndarray, first: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(p, pairs, log Z): P(tag = 1) of each word, expected transitions (2 x 2), for chains laid end to end.

    score: of tag 1 against tag 0. first: where each chain begins. trans: 2 x 2 scores of neighbouring tags.
    Forward and backward passes are products of 2 x 2 matrices, and a chain's first matrix forgets what stood
    before it; so all chains are one sequence, cut into equal lanes. Lanes first go through side by side for
    their whole products, these are linked, and a second time with the right start. Exact for any length.
    """
    n = len(score)
    if not n:
        return np.zeros(0), np.zeros((2, 2)), 0.0
    lanes = max(1, int(4 * math.sqrt(n)))
    width = -(-n // lanes)
    size = lanes * width
    fresh = np.zeros(size, bool)
    fresh[first[first < n]] = True
    fresh[n:] = True
    top = np.maximum(score, 0)
    emit = np.ones((2, size))
    emit[0, :n], emit[1, :n] = np.exp(-top), np.exp(np.clip(score - top, -700, 0))
    shift = trans.max()
    (s00, s01), (s10, s11) = step = np.exp(trans - shift)  # from row, to column
    by_time = lambda x: np.ascontiguousarray(x.reshape(lanes, width).T)
    e0, e1, f = by_time(emit[0]), by_time(emit[1]), by_time(fresh)
    scales = np.ones((width, lanes))

    def forward(a0: np.ndarray, a1: np.ndarray, keep: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """a0, a1: row vectors of tag scores, one a lane or (with a first axis) several."""
        for t in range(width):
            new = f[t]
            both = a0 + a1
            a0, a1 = np.where(new, both, a0 * s00 + a1 * s10) * e0[t], np.where(new, both, a0 * s01 + a1 * s11) * e1[t]
            scale = (a0 + a1).sum(axis=0) if a0.ndim > 1 else a0 + a1
            a0, a1 = a0 / scale, a1 / scale
            if keep is not None:
                keep[0, t], keep[1, t], scales[t] = a0, a1, scale
        return a0, a1

    def backward(b0: np.ndarray, b1: np.ndarray, keep: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """b0, b1: column vectors of what follows, one a lane or several."""
        for t in range(width - 1, -1, -1):
            if keep is not None:
                keep[0, t], keep[1, t] = b0, b1
            b0, b1 = b0 * e0[t], b1 * e1[t]
            both = b0 + b1
            b0, b1 = np.where(f[t], both, s00 * b0 + s01 * b1), np.where(f[t], both, s10 * b0 + s11 * b1)
            scale = (b0 + b1).sum(axis=0) if b0.ndim > 1 else b0 + b1
            b0, b1 = b0 / scale, b1 / scale
        return b0, b1

    one, none = np.ones(lanes), np.zeros(lanes)
    eye = np.stack([one, none]), np.stack([none, one])
    w0, w1 = forward(*eye, None)  # w0[k]: to tag 0 from tag k
    start, now = [], (0.5, 0.5)
    for p0, p1, q0, q1 in zip(w0[0].tolist(), w0[1].tolist(), w1[0].tolist(), w1[1].tolist(), strict=True):
        start.append(now)
        x, y = now[0] * p0 + now[1] * p1, now[0] * q0 + now[1] * q1
        now = x / (x + y), y / (x + y)
    alpha = np.zeros((2, width, lanes))
    forward(*(np.array(x) for x in zip(*start, strict=True)), alpha)
    v0, v1 = backward(*eye, None)  # v0[k]: from tag 0 to tag k
    end, now = [], (0.5, 0.5)
    for p0, p1, q0, q1 in zip(*(x[::-1].tolist() for x in (v0[0], v0[1], v1[0], v1[1])), strict=True):
        end.append(now)
        x, y = p0 * now[0] + p1 * now[1], q0 * now[0] + q1 * now[1]
        now = x / (x + y), y / (x + y)
    beta = np.zeros((2, width, lanes))
    backward(*(np.array(x) for x in zip(*end[::-1], strict=True)), beta)
    a, b = (x.transpose(0, 2, 1).reshape(2, size)[:, :n] for x in (alpha, beta))
    both = a * b
    p = both[1] / both.sum(axis=0)
    inner = np.flatnonzero(~fresh[1:n]) + 1
    after = (emit[:, :n] * b)[:, inner]
    pairs = a[:, inner - 1][:, None] * step[:, :, None] * after[None]
    pairs = (pairs / pairs.sum(axis=(0, 1))).sum(axis=2)
    log_z = float(np.log(scales.T.reshape(size)[:n]).sum() + top.sum() + shift * len(inner))
    return p, pairs, log_z


def evidence(p: np.ndarray, first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """What a document's marginals come to: the expected toxic words, these in a thousand words, the highest marginal."""
    out = np.zeros((len(counts), 3))
    full = counts > 0
    if full.any():
        total = np.add.reduceat(p, first[full])
        out[full] = np.column_stack([np.log1p(total), np.log1p(1000 * total / counts[full]), np.maximum.reduceat(p, first[full])])
    return out


def fit_judge(x: np.ndarray, toxic: np.ndarray, weight: np.ndarray, decay: float = 0.05, steps: int = 50) -> np.ndarray:
    """Logistic regression of the documents' labels on their evidence, by Newton's method; the last weight is the bias."""
    x = np.column_stack([x, np.ones(len(x))])
    beta, ridge = np.zeros(x.shape[1]), np.diag([decay] * (x.shape[1] - 1) + [1e-6])
    for _ in range(steps):
        s = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        move = np.linalg.solve((x * (weight * s * (1 - s) + 1e-9)[:, None]).T @ x + ridge, x.T @ (weight * (s - toxic)) + ridge @ beta)
        beta -= move / max(1.0, float(np.abs(move).max()) / 2)
        if np.abs(move).max() < 1e-8:
            break
    return beta


class ToxicSpans:
    """The field: bucket weights and a bias for the tag of a word, scores for neighbouring tags; what documents are judged by."""

    def __init__(self, weights: np.ndarray, bias: float, trans: np.ndarray, judge: np.ndarray | None = None):
        self.weights, self.bias, self.trans, self.judge = weights, bias, trans, judge

    def tag(self, data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray]:
        w = Words(data, offsets, hashed=False)
        score = self.weights[word_features(data, offsets)].sum(axis=1, dtype=np.float64) + self.bias
        p, _, _ = marginals(score, w.first[:-1], self.trans)
        return w, p


class Tokens:
    """Texts as numbers: a vocabulary with a row of feature buckets for each word, and each text's words in it."""

    def __init__(self, texts: Iterable[str]):
        known: dict[bytes, int] = {}
        self.docs = [np.array([known.setdefault(w, len(known)) for w in t.encode().split()], np.int32) for t in texts]
        words, parts = list(known), [np.zeros((0, _KINDS), np.int32)]
        known.clear()
        for at in range(0, len(words), 1 << 15):
            raw = np.frombuffer(b" ".join(words[at : at + (1 << 15)]), np.uint8)
            parts.append(word_features(raw, np.array([0, len(raw)])))
        self.features = np.concatenate(parts)

    def seen(self) -> list[np.ndarray]:
        """Each text's distinct features."""
        out = [np.unique(self.features[np.unique(d)]) for d in self.docs]
        return [f[f > 0] for f in out]


class _Merged:
    """Documents merged into groups: union and find."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> None:
        self.parent[self.root(i)] = self.root(j)

    def roots(self) -> np.ndarray:
        return np.array([self.root(i) for i in range(len(self.parent))], np.int64)


def _lows(values: np.ndarray, count: int) -> np.ndarray:
    """So many MinHash values of a set of numbers."""
    import xxhash

    seeds = np.array([[xxhash.xxh64_intdigest(b"%d.%d" % (i, j)) | 1 for j in range(2)] for i in range(count)], np.uint64)
    out = np.full(count, np.iinfo(np.uint64).max)
    for at in range(0, len(values), 1 << 14):
        out = np.minimum(out, mix(values[None, at : at + (1 << 14)].astype(np.uint64) * seeds[:, :1] + seeds[:, 1:]).min(axis=1))
    return out


def _shingles(tokens: Tokens) -> list[np.ndarray]:
    """Each text's distinct hashes of three neighbouring words, by their first features; a shorter text is one."""
    out, odd = [], np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
    for d in tokens.docs:
        w = tokens.features[d, 0].astype(np.uint64)
        parts = [w[k : len(w) - 2 + k] if len(w) >= 3 else w[k : k + 1] for k in range(min(3, len(w)))]
        out.append(np.unique(mix(sum(p * m for p, m in zip(parts, odd)))) if parts else np.zeros(0, np.uint64))
    return out


def _merge_copies(tokens: Tokens, merged: _Merged, least: float = 0.3) -> None:
    """Merges texts whose word shingles have a Jaccard similarity of `least`, however many they are.

    Equal sets are merged first. Of the others every pair is compared by 64 MinHash values, and pairs that may
    reach `least` are verified on the shingles. Time follows the square of the distinct texts of the sample.
    """
    first: dict[bytes, int] = {}
    shingles = _shingles(tokens)
    for i, s in enumerate(shingles):
        if len(s):
            merged.join(i, first.setdefault(s.tobytes(), i))
    own = list(first.values())
    lows = np.array([_lows(shingles[i], 64) for i in own], np.uint64).reshape(len(own), 64)
    for a, i in enumerate(own):
        for b in np.flatnonzero((lows[:a] == lows[a]).sum(axis=1) >= 64 * least / 2).tolist():
            j = own[b]
            if merged.root(i) != merged.root(j):
                shared = len(np.intersect1d(shingles[i], shingles[j], assume_unique=True))
                if shared >= least * (len(shingles[i]) + len(shingles[j]) - shared):
                    merged.join(i, j)


def _groups(tokens: Tokens, seen: list[np.ndarray]) -> np.ndarray:
    """The group of near copies of each document.

    Documents that share three tenths of their word shingles, and then those that share one of six bands of four
    MinHash values of their features. There only features of few groups count (fifty, or one in fifty of them),
    as texts of one language share the others anyhow; a group found before counts once, whatever its size.
    """
    merged = _Merged(len(seen))
    _merge_copies(tokens, merged)
    group = merged.roots()
    often = np.zeros(BUCKETS, np.int64)
    for members in _members(group):
        often[np.unique(np.concatenate([seen[i] for i in members]))] += 1
    most = max(3, min(50, len(np.unique(group)) // 50))
    table: dict[tuple, int] = {}
    for i, s in enumerate(seen):
        rare = s[often[s] <= most]
        if len(rare):
            for band, values in enumerate(_lows(rare, 24).reshape(6, 4).tolist()):
                merged.join(i, table.setdefault((band, *values), i))
    return merged.roots()


def _members(group: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(group, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(group[order])) + 1)


def toxic_features(tokens: Tokens, toxic: np.ndarray, group: np.ndarray | None = None, precision: float = 0.4) -> np.ndarray:
    """Features that mark toxic words, by the documents' labels alone.

    Each group of near copies counts once, or every word of a copied toxic text would seem toxic. A feature is
    taken if at least `precision` of its groups are toxic and so many would hardly be by chance: by the
    Chernoff bound on the share of toxic groups, over all features that are as frequent, less than one in
    seven times. What also stands in clean texts gets marginals below one; the document is judged by all of them.
    """
    seen = tokens.seen()
    group = _groups(tokens, seen) if group is None else group
    counts = np.zeros((2, BUCKETS), np.int32)
    n_bad = 0
    for members in _members(group):
        bad = int(toxic[members].max())
        n_bad += bad
        counts[bad, np.unique(np.concatenate([seen[i] for i in members]))] += 1
    total = counts.sum(axis=0)
    had = np.flatnonzero(total)
    n, at = total[had], counts[1, had] / total[had]
    share = n_bad / max(1, len(np.unique(group)))
    if not 0 < share < 1:
        return np.zeros(0, np.int64)
    need = np.log(len(n) - np.searchsorted(np.sort(n), n)) + 2
    rest = np.where(at < 1, (1 - at) * np.log(np.maximum(1 - at, 1e-12) / (1 - share)), 0)
    far = n * (at * np.log(np.maximum(at, 1e-12) / share) + rest)
    return had[(at >= precision) & (at > share) & (far >= need)]


def token_labels(tokens: Tokens, toxic: np.ndarray, group: np.ndarray | None = None) -> list[np.ndarray]:
    """The labelled tokens: words of toxic documents that have a toxic feature."""
    marked = np.isin(tokens.features, toxic_features(tokens, toxic, group)).any(axis=1)
    return [marked[d] & bool(t) for d, t in zip(tokens.docs, toxic, strict=True)]


def fit_field(tokens: Tokens, tags: list[np.ndarray], steps: int = 25, rate: float = 0.5, decay: float = 2e-4, block: int = 50_000) -> ToxicSpans:
    """Penalised maximum likelihood of the tags, by Adam over whole passes in blocks of about `block` words."""
    parts, now, size = [], [], 0
    for k, d in enumerate(tokens.docs):
        now.append(k)
        size += len(d)
        if size >= block or k == len(tokens.docs) - 1:
            parts.append((np.concatenate([tokens.docs[i] for i in now]), np.cumsum([0, *[len(tokens.docs[i]) for i in now]])[:-1], np.concatenate([tags[i] for i in now])))
            now, size = [], 0
    total = max(1.0, float(sum(y.sum() for _, _, y in parts)))
    seen = np.zeros((2, 2))
    for w, first, y in parts:
        inner = np.ones(len(w), bool)
        inner[first[first < len(w)]] = False
        at = np.flatnonzero(inner)
        np.add.at(seen, (y[at - 1].astype(int), y[at].astype(int)), 1)
    words = len(tokens.features)
    known, shape = np.unique(tokens.features, return_inverse=True)  # the buckets that the texts use; the others keep weight 0
    shape = shape.reshape(words, _KINDS).astype(np.int32)
    none, size = int(np.searchsorted(known, 1)), len(known)  # bucket 0 stands for no feature
    theta = np.zeros(size + 5)
    theta[size] = math.log((total + 1) / (sum(len(w) for w, _, _ in parts) + 100))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        each = theta[shape[:, 0]] + theta[size]
        for k in range(1, _KINDS):
            each += theta[shape[:, k]]
        miss, g = np.zeros(words), np.zeros_like(theta)
        g[size + 1 :] = -seen.ravel()
        for w, first, y in parts:
            p, pairs, _ = marginals(each[w], first, theta[size + 1 :].reshape(2, 2))
            np.add.at(miss, w, p - y)
            g[size + 1 :] += pairs.ravel()
        for k in range(_KINDS):
            g[:size] += np.bincount(shape[:, k], miss, size)
        g[:none], g[size] = 0, miss.sum()
        g /= total
        bias = g[size]
        g += decay * theta
        g[size] = bias  # the bias does not decay
        m *= 0.9
        m += 0.1 * g
        v *= 0.99
        v += 0.01 * g * g
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
    weights = np.zeros(BUCKETS, np.float32)
    weights[known] = theta[:size]
    return ToxicSpans(weights, float(theta[size]), theta[size + 1 :].reshape(2, 2))


def _fitting(sizes: list[tuple[int, int]], max_bytes: int) -> set[int]:
    """The ids of rows (id, bytes), in their order, that together stay within max_bytes; what does not fit is passed over."""
    taken, total = set(), 0
    for doc_id, size in sizes:
        if total + size <= max_bytes:
            taken.add(doc_id)
            total += size
    return taken


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", max_rows: int = 2000, id_col: str = "doc_id", text_col: str = "text", max_bytes: int = 1 << 26) -> ToxicSpans | float:
    """The field fitted to at most max_rows toxic and max_rows other labelled documents of the training folds.

    Those of least hashed id are taken, whole texts of any length, as long as each kind's texts come to at most
    max_bytes, so the driver's memory has a bound. Without a toxic or without another row: the share of toxic ones as a constant score.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.select(F.col(id_col).cast("long").alias("doc_id"), (F.col(label_col) == 1).cast("int").alias("toxic"))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    by = F.xxhash64("doc_id"), F.col("doc_id")
    chosen = known.where("toxic = 1").orderBy(*by).limit(max_rows).union(known.where("toxic = 0").orderBy(*by).limit(max_rows))
    each = texts(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id")
    sizes = each.groupBy("doc_id", "toxic").agg(F.sum(F.octet_length("text") + 64).alias("size")).orderBy(*by).collect()
    fit = set().union(*(_fitting([(r["doc_id"], r["size"]) for r in sizes if r["toxic"] == t], max_bytes) for t in (0, 1)))
    over = [r["doc_id"] for r in sizes if r["doc_id"] not in fit]
    rows = (each.where(~F.col("doc_id").isin(over)) if over else each).select("doc_id", "text", "toxic").toArrow()
    rows = rows.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    toxic = rows["toxic"].to_numpy()
    if not (toxic == 1).any() or not (toxic == 0).any():
        return float(toxic.mean()) if len(toxic) else 0.0
    texts_of = rows["text"]
    del rows
    tokens = Tokens(t.as_py() for t in texts_of)
    del texts_of  # only the numbers stay
    return fit_documents(tokens, toxic)


def fit_documents(tokens: Tokens, toxic: np.ndarray) -> ToxicSpans:
    """The field from the tokens that documents' labels mark, and the judgement of documents by its marginals.

    A group of near copies weighs as one document in the judgement.
    """
    group = _groups(tokens, tokens.seen())
    model = fit_field(tokens, token_labels(tokens, toxic, group))
    each = model.weights[tokens.features].sum(axis=1, dtype=np.float64) + model.bias
    counts = np.array([len(d) for d in tokens.docs])
    first = np.cumsum(counts) - counts
    p, _, _ = marginals(each[np.concatenate([np.zeros(0, np.int32), *tokens.docs])], first, model.trans)
    _, of, sizes = np.unique(group, return_inverse=True, return_counts=True)
    model.judge = fit_judge(evidence(p, first, counts), toxic.astype(float), 1 / sizes[of])
    return model


def _judged(p: np.ndarray, w: Words, judge: np.ndarray) -> np.ndarray:
    """A document's score from its marginals, 0 without words."""
    x = evidence(p, w.first[:-1], w.counts)
    return np.where(w.counts > 0, 1 / (1 + np.exp(-np.clip(x @ judge[:-1] + judge[-1], -30, 30))), 0.0)


def toxicity(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", max_rows: int = 2000, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted, spans): toxic documents and where they are toxic.

    Forward and backward passes over the whole text give each word's marginal probability of the toxic tag. The
    score of a document is a logistic function of what these come to: the expected toxic words, their share and
    the highest marginal. Spans are runs of words whose marginal reaches the threshold, as [start, end) in UTF-8
    bytes. Rows whose crc32(doc_id as text) mod 3 is 1 are held out and not learned
    from. Null, blank and empty texts score 0 with no spans; null ids stay null; equal rows get equal results;
    a marginal or score exactly at the threshold counts; a text of any length goes through whole, in memory that
    follows its length; an empty table gives an empty table. Without labels all scores are 0.

    One pass over the documents without a shuffle; the broadcast model has a fixed size, 2 ** 20 weights (4 MB).
    """
    field = docs.sparkSession.sparkContext.broadcast(train(docs, labels, label_col, max_rows, id_col, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = field.value
        for rows, data, offsets in chunks(batches, 1, _CHUNK):
            if isinstance(model, float):
                score, spans = np.full(rows.num_rows, model), [[] for _ in range(rows.num_rows)]
            else:
                w, p = model.tag(data, offsets)
                score, spans = _judged(p, w, model.judge), [[] for _ in range(rows.num_rows)]
                last = -2
                for k in np.flatnonzero(p >= threshold).tolist():
                    t = int(np.searchsorted(w.first, k, "right")) - 1
                    s, e = int(w.starts[k] - offsets[t]), int(w.ends[k] - offsets[t])
                    if last == k - 1 and spans[t]:
                        spans[t][-1]["end"] = e
                    else:
                        spans[t].append({"start": s, "end": e})
                    last = k
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(score), pa.array(spans, kind)], ["doc_id", "score", "spans"])

    out = texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, spans array<struct<start: long, end: long>>")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "spans")
