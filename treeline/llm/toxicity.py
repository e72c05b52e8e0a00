"""Toxic spans by a linear-chain conditional random field.

Document labels become token labels: a token of a toxic document is toxic if the word or its beginning (four or
six bytes) is far likelier in toxic than in clean documents. A two-state chain with these features is trained in
numpy on windows of tokens by forward-backward gradients. Each whole text is tagged by exact marginals; sums of marginals
are the inputs of a logistic document score, and runs of likely toxic tokens are the offending offsets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words as W
from ._sampling import first_rows, held_out, place, sampled, stretches
from ._store import staged, table

#: Labelled rows of each class that training reads, and characters read of a text.
TRAIN_ROWS, TRAIN_CHARS = 1500, 12_000
#: Windows of tokens that the chain is trained on, their length, and steps of training.
WINDOWS, WINDOW, STEPS = 24_000, 24, 120
SEGMENT = 64
THRESHOLD = 0.3
#: Marginals below it say nothing about a document.
FLOOR = 0.1
#: A byte of a token is a letter, a digit or part of a character beyond ASCII.
_STOP = np.ones(256, bool)
_STOP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
FEATURES = 3


def tokens(column: pa.Array):
    """(bytes, row offsets, token starts, ends, token offsets of rows) of a string column."""
    data, at = W.column_bytes(column)
    start, end, rows = W.spans(data, at, _STOP)
    return data, at, start, end, rows


def feature_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """(n, 3): the word, and its first four and six bytes if it is longer."""
    out = np.empty((len(start), FEATURES), np.uint64)
    out[:, 0] = W.hashes(data, start, end)
    for k, size in ((1, 4), (2, 6)):
        out[:, k] = W.hashes(data, start, np.minimum(end, start + size)) + np.uint64(k)
    return out


@dataclass
class Model:
    keys: np.ndarray  # sorted feature hashes
    weights: np.ndarray
    bias: float
    moves: np.ndarray  # (2, 2) exp of the transition scores
    link: np.ndarray  # logistic weights of the document's summary

    def emissions(self, features: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(features), self.bias)
        at = np.minimum(np.searchsorted(self.keys, features), len(self.keys) - 1)
        return self.bias + np.where(self.keys[at] == features, self.weights[at], 0.0).sum(axis=1)


def _scan(moves: np.ndarray, e: np.ndarray, on: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Marginals of state 1 in (n, length) segments, given messages a into their first and b into their last tokens."""
    n, size = e.shape
    left = np.empty((size, n, 2))
    for t in range(size):
        x0 = a[:, 0] * moves[0, 0] + a[:, 1] * moves[1, 0]
        x1 = (a[:, 0] * moves[0, 1] + a[:, 1] * moves[1, 1]) * e[:, t]
        z = x0 + x1
        a = np.where(on[:, t, None], np.stack([x0 / z, x1 / z], 1), a)
        left[t] = a
    out = np.empty((n, size))
    for t in range(size - 1, -1, -1):
        p0, p1 = left[t, :, 0] * b[:, 0], left[t, :, 1] * b[:, 1]
        out[:, t] = p1 / (p0 + p1)
        y0, y1 = b[:, 0], b[:, 1] * e[:, t]
        c0, c1 = moves[0, 0] * y0 + moves[0, 1] * y1, moves[1, 0] * y0 + moves[1, 1] * y1
        z = c0 + c1
        b = np.where(on[:, t, None], np.stack([c0 / z, c1 / z], 1), b)
    return out


def marginals(moves: np.ndarray, scores: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact marginals of every token, for chains rows[i]:rows[i + 1] of `scores`.

    Chains are cut into segments: products of a segment's step matrices carry messages over it, a short pass over each
    chain's segments gives the messages into them, and all segments are then scanned side by side.
    """
    sizes = np.diff(rows)
    cuts = -(-sizes // SEGMENT)
    first = np.concatenate([[0], np.cumsum(cuts)])
    n = int(first[-1])
    if not n:
        return np.zeros(0)
    chain = np.repeat(np.arange(len(sizes)), cuts)
    place = np.arange(n) - first[chain]
    begin = rows[chain] + place * SEGMENT
    size = np.minimum(SEGMENT, rows[chain + 1] - begin)
    on = np.arange(SEGMENT) < size[:, None]
    index = np.where(on, begin[:, None] + np.arange(SEGMENT), 0)
    e = np.exp(np.clip(scores, -30, 30))[index]
    a, b = np.zeros((n, 2)), np.ones((n, 2))
    a[:, 0] = 1.0
    if n > len(sizes):
        p = np.zeros((n, 2, 2))
        p[:, 0, 0] = p[:, 1, 1] = 1.0
        for t in range(SEGMENT):
            x0 = p[:, :, 0] * moves[0, 0] + p[:, :, 1] * moves[1, 0]
            x1 = (p[:, :, 0] * moves[0, 1] + p[:, :, 1] * moves[1, 1]) * e[:, t, None]
            new = np.stack([x0, x1], 2)
            p = np.where(on[:, t, None, None], new / new.sum(axis=(1, 2), keepdims=True), p)
        for k in range(1, int(cuts.max())):
            s = first[:-1][cuts > k] + k
            m = np.einsum("ni,nij->nj", a[s - 1], p[s - 1])
            a[s] = m / m.sum(axis=1, keepdims=True)
        for k in range(int(cuts.max()) - 2, -1, -1):
            s = first[:-1][cuts > k + 1] + k
            m = np.einsum("nij,nj->ni", p[s + 1], b[s + 1])
            b[s] = m / m.sum(axis=1, keepdims=True)
    return _scan(moves, e, on, a, b)[on]


def _summary(p: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Of each document: one, the log of its expected toxic tokens (of those above FLOOR), the largest marginal, and their share."""
    sums = np.concatenate([[0.0], np.cumsum(np.where(p > FLOOR, p, 0.0))])
    total = np.maximum(sums[rows[1:]] - sums[rows[:-1]], 0)
    top = np.zeros(len(total))
    full = rows[1:] > rows[:-1]
    if full.any():
        top[full] = np.maximum.reduceat(p, rows[:-1][full])
    return np.stack([np.ones(len(total)), np.log1p(total), top, np.minimum(1.0, 10 * total / np.maximum(1, np.diff(rows)))], 1)


def _lexicon(features: np.ndarray, rows: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of words, and of prefixes, that occur in toxic documents far more than chance allows.

    A word's evidence is counted in distinct contexts (the words before and after), as copies of one toxic document would
    otherwise make all of its words look toxic; a context that any clean document has counts as clean. A prefix counts
    distinct words, so that one frequent toxic word doesn't speak for all that begin like it.
    """
    words = features[:, 0]
    before, after = np.roll(words, 1), np.roll(words, -1)
    full = rows[1:] > rows[:-1]
    before[rows[:-1][full]] = 0
    after[rows[1:][full] - 1] = 0
    good = np.repeat(toxic, np.diff(rows)) == 0

    def strong(units, owners):
        """Owners whose units are clean in no document, beyond chance."""
        _, some, inverse = np.unique(units, return_index=True, return_inverse=True)
        only = np.bincount(inverse, good) == 0
        keys, inverse, n = np.unique(owners[some], return_inverse=True, return_counts=True)
        k = np.bincount(inverse, only, len(keys))
        base = np.clip(only.mean(), 1e-6, 1 - 1e-6)
        rate = np.clip(k / n, 1e-9, 1 - 1e-9)
        gain = n * (rate * np.log(rate / base) + (1 - rate) * np.log((1 - rate) / (1 - base)))
        return keys, gain, k, n, base

    keys, gain, k, n, base = strong(W.mix(words * W.SHINGLE[0] + before * W.SHINGLE[1] + after * W.SHINGLE[2]), words)
    bad = keys[(gain > 16) & (k / n > max(0.8, (1 + base) / 2))]
    prefixes = []
    for f in range(1, FEATURES):
        keys, gain, k, n, base = strong(words, features[:, f])
        around = strong(W.mix(features[:, f] * W.SHINGLE[0] + before * W.SHINGLE[1] + after * W.SHINGLE[2]), features[:, f])
        frequent = around[0][(around[1] > 16) & (around[2] / around[3] > 0.95)]
        prefixes.append(keys[np.isin(keys, frequent) & (n >= 8) & (k / n > 0.95)])
    return bad, np.unique(np.concatenate(prefixes))


def _among(x: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of `x` are among the sorted keys."""
    return keys[np.minimum(np.searchsorted(keys, x), len(keys) - 1)] == x if len(keys) else np.zeros(len(x), bool)


def _train_chain(features: np.ndarray, tags: np.ndarray, windows: np.ndarray):
    """Chain weights by Adam on the windows' likelihood. features (m, 3) vocabulary places, tags (m,), windows (n, length) token places."""
    size = int(features.max()) + 1
    theta = [np.zeros(size), np.array([-2.0]), np.array([[0.0, -1.0], [0.0, 0.0]])]
    moment = [np.zeros_like(x) for x in theta]
    square = [np.zeros_like(x) for x in theta]
    y = tags[windows]
    seen = np.bincount(features[windows][y == 1].ravel(), minlength=size).astype(float)
    pair = np.zeros((2, 2))
    np.add.at(pair, (np.concatenate([np.zeros((len(y), 1), int), y[:, :-1]], 1), y), 1)
    for step in range(1, STEPS + 1):
        w, bias, move = theta
        e = np.exp(np.clip(w[features[windows]].sum(axis=2) + bias, -30, 30))
        m = np.exp(move)
        n, length = e.shape
        left, right = np.empty((length, n, 2)), np.empty((length, n, 2))
        a = np.zeros((n, 2))
        a[:, 0] = 1
        for t in range(length):
            x = a @ m
            x[:, 1] *= e[:, t]
            a = left[t] = x / x.sum(axis=1, keepdims=True)
        b = np.ones((n, 2))
        expected = np.zeros((2, 2))
        p = np.empty((n, length))
        for t in range(length - 1, -1, -1):
            right[t] = b
            q = left[t] * b
            p[:, t] = q[:, 1] / q.sum(axis=1)
            y1 = b * np.stack([np.ones(n), e[:, t]], 1)
            before = left[t - 1] if t else np.tile([1.0, 0.0], (n, 1))
            joint = before[:, :, None] * m * y1[:, None, :]
            expected += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            b = y1 @ m.T
            b /= b.sum(axis=1, keepdims=True)
        grad_w = seen - np.bincount(features[windows].ravel(), np.repeat(p.ravel(), FEATURES), size)
        grads = [grad_w - 0.05 * w, np.array([(y - p).sum()]), pair - expected - 0.05 * move]
        for i, g in enumerate(grads):
            moment[i] = 0.9 * moment[i] + 0.1 * g
            square[i] = 0.99 * square[i] + 0.01 * g * g
            theta[i] = theta[i] + 0.15 * (moment[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.99**step)) + 1e-6)
    return theta


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Newton's method with a small ridge."""
    beta = np.zeros(x.shape[1])
    ridge = np.diag([0.01] + [0.1] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + ridge
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge @ beta)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fit(texts: list[str], toxic: np.ndarray, weight: np.ndarray) -> Model:
    """A model of labelled texts; weight: rows that each stands for. Without both classes no token is toxic."""
    none = Model(np.zeros(0, np.uint64), np.zeros(0), -20.0, np.ones((2, 2)), np.array([-20.0, 0, 0, 0]))
    if not len(toxic) or toxic.min() == toxic.max():
        return none
    data, _, start, end, rows = tokens(pa.array(texts, pa.string()))
    hashed = feature_hashes(data, start, end)
    words, prefixes = _lexicon(hashed, rows, toxic)
    W.trim()
    if not len(words) + len(prefixes):
        base = float(np.average(toxic, weights=weight))
        return Model(none.keys, none.weights, -20.0, none.moves, np.array([np.log(base / (1 - base)), 0, 0, 0]))
    doc = np.repeat(toxic, np.diff(rows))
    hit = _among(hashed[:, 0], words)
    for f in range(1, FEATURES):
        hit |= _among(hashed[:, f], prefixes)
    tags = (hit & (doc == 1)).astype(np.int64)
    rng = np.random.Generator(np.random.PCG64(11))
    usable = np.flatnonzero(np.diff(rows) >= WINDOW)
    if not len(usable):
        usable, length = np.flatnonzero(np.diff(rows) > 0), 1
    else:
        length = WINDOW
    ends = np.cumsum(np.where(np.isin(np.arange(len(toxic)), usable), np.maximum(np.diff(rows) - length + 1, 0), 0))
    drawn = rng.integers(0, ends[-1], WINDOWS // 2)
    d = np.searchsorted(ends, drawn, "right")
    begin = rows[d] + drawn - np.where(d > 0, ends[np.maximum(d - 1, 0)], 0)
    close = np.flatnonzero(tags)
    close = rng.choice(close, min(len(close), WINDOWS // 2), replace=False)
    owner = np.searchsorted(rows, close, "right") - 1
    near = close - rng.integers(0, length, len(close))
    low, high = rows[owner], rows[owner + 1] - length
    near = np.clip(near, low, np.maximum(high, low))[high >= low]
    windows = np.concatenate([begin, near])[:, None] + np.arange(length)
    keys, counts = np.unique(hashed[np.unique(windows), 0], return_counts=True)
    keys = np.union1d(keys[counts >= 3], prefixes)
    # Only the windows' tokens get places in the vocabulary.
    used, windows = np.unique(windows, return_inverse=True)
    windows, local = windows.reshape(-1, length), hashed[used]
    places = np.full(local.shape, len(keys), np.int64)
    for f in range(FEATURES):
        known = _among(local[:, f], keys)
        places[known, f] = np.searchsorted(keys, local[known, f])
    w, bias, move = _train_chain(places, tags[used], windows)
    del places, local
    keep = np.abs(w[: len(keys)]) > 1e-3
    model = Model(keys[keep], w[: len(keys)][keep], float(bias[0]), np.exp(move), np.zeros(4))
    p = np.empty(len(hashed))
    for i in range(0, len(rows) - 1, 128):
        some = rows[i : i + 129]
        p[some[0] : some[-1]] = marginals(model.moves, model.emissions(hashed[some[0] : some[-1]]), some - some[0])
    model.link = _logistic(_summary(p, rows), toxic.astype(float), weight)
    return model


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits on a bounded sample of the labelled texts that aren't held out: TRAIN_ROWS of each class, up to TRAIN_CHARS of a text, of a longer one four stretches.

    Rows without text, id or label don't count. An id with several labels is toxic if one says so; of texts that repeat an
    id, one counts.
    """
    marked = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.where(F.length("text") > 0).select("doc_id", "text")
    ids = staged(marked.join(texts.select("doc_id").distinct(), "doc_id", "left_semi"), "labelled")
    chosen = staged(sampled(ids, "toxic", TRAIN_ROWS), "sample")
    rows = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "_n", place().alias("place"), stretches("text", TRAIN_CHARS).alias("text"))
    got = first_rows(rows.groupBy("doc_id", "toxic", "_n", "place").agg(F.min("text").alias("text")).collect(), "toxic", TRAIN_ROWS)
    toxic = np.array([r["toxic"] for r in got], np.int64)
    sizes = np.bincount(toxic, minlength=2)
    weight = np.array([r["_n"] / sizes[r["toxic"]] for r in got], float)
    model = fit([r["text"] for r in got], toxic, weight / max(weight.sum(), 1e-9) * len(weight))
    W.trim()
    return model


def tag(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, offsets): of each whole text the document score and the toxic spans, start:end in code points, comma-joined. Null text counts as empty; a text without tokens gets the score of no toxic tokens."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for batch in W.slices(whole, "text", 2 << 20):
                data, at, start, end, rows = tokens(batch.column("text"))
                some, inverse = W.distinct(data, start, end)
                scores = m.emissions(feature_hashes(data, start[some], end[some]))[inverse]
                p = marginals(m.moves, scores, rows)
                z = _summary(p, rows) @ m.link
                spans = [""] * batch.num_rows
                bad = np.flatnonzero(p > 0.5)
                if len(bad):
                    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                    owner = np.searchsorted(rows, bad, "right") - 1
                    new = np.flatnonzero((np.diff(bad, prepend=-9) != 1) | (np.diff(owner, prepend=-1) != 0))
                    last = np.append(new[1:], len(bad)) - 1
                    for d, a, b in zip(owner[new].tolist(), bad[new].tolist(), bad[last].tolist(), strict=True):
                        spans[d] += f"{',' if spans[d] else ''}{points[start[a]] - points[at[d]]}:{points[end[b]] - points[at[d]]}"
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30)))), pa.array(spans)], names=["doc_id", "score", "offsets"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, offsets string")


def clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` whose score stays below the threshold."""
    fields = docs.schema
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for batch in W.slices(whole, "text", 2 << 20):
                data, _, start, end, rows = tokens(batch.column("text"))
                some, inverse = W.distinct(data, start, end)
                p = marginals(m.moves, m.emissions(feature_hashes(data, start[some], end[some]))[inverse], rows)
                z = _summary(p, rows) @ m.link
                yield batch.filter(pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))) < threshold))

    return docs.mapInArrow(run, fields)


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = tag(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "offsets")
