"""Language by a bidirectional gated recurrent network over bytes.

The network reads running text (A-Z as a-z) byte by byte in both directions and labels every position with probabilities
of the languages; a document pools its letters' positions. For reading, texts are cut into chunks side by side; a chunk's
state starts from the CONTEXT bytes on either side of it, so words are read in the context of those around them. Training is
backpropagation through time in numpy, on windows of running text.
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

#: Rows of each language that training reads, characters read of a text, and the languages beyond which the rows of each grow fewer.
TRAIN_ROWS, TRAIN_CHARS, LANGUAGES = 300, 5_000, 64
#: Units of each direction; bytes of a training window; steps, windows of a step, and the share of a step's rate by which weights decay.
UNITS, WINDOW, STEPS, BATCH, DECAY = 12, 24, 600, 384, 1.0
#: Bytes that a chunk labels, bytes read on either side of it, and chunks read side by side.
CHUNK, CONTEXT, SIDE = 192, 24, 2048
#: A step that leaves the state as it is: beyond a text's ends.
PAD = 256
_LETTER = np.zeros(257, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Model:
    names: list[str]
    net: list[np.ndarray]  # of each direction: bytes to update, reset and candidate, state to these; then output of each direction and bias


def _sigmoid(x):
    return np.tanh(x * 0.5) * 0.5 + 0.5


def _read(net, steps: np.ndarray):
    """State before each of `steps` (length, n), what made the next, and the last state."""
    by_z, by_r, by_c, to_z, to_r, to_c = net
    h = np.zeros((steps.shape[1], len(to_z)), by_z.dtype)
    kept = []
    for s in steps:
        z, r = _sigmoid(by_z[s] + h @ to_z), _sigmoid(by_r[s] + h @ to_r)
        c = np.tanh(by_c[s] + (r * h) @ to_c)
        kept.append((h, z, r, c))
        h = h + z * (c - h)
    return kept, h


def _read_back(net, steps, kept, d_states):
    """Gradients of one direction by going back through time. d_states: of the state after each step."""
    to_z, to_r, to_c = net[3:]
    d_to = [np.zeros_like(p) for p in net[3:]]
    d_by = [np.empty((*steps.shape, len(to_z)), to_z.dtype) for _ in range(3)]
    dh = np.zeros_like(kept[0][0])
    for t in range(len(steps) - 1, -1, -1):
        h, z, r, c = kept[t]
        dh = dh + d_states[t]
        dc, dz = dh * z * (1 - c * c), dh * (c - h) * z * (1 - z)
        back = dc @ to_c.T
        dr = back * h * r * (1 - r)
        for d, x, left in zip(d_to, (dz, dr, dc), (h, h, r * h), strict=True):
            d += left.T @ x
        for d, x in zip(d_by, (dz, dr, dc), strict=True):
            d[t] = x
        dh = dh * (1 - z) + back * r + dz @ to_z.T + dr @ to_r.T
    flat = steps.ravel()
    tables = [np.stack([np.bincount(flat, x, PAD + 1) for x in d.reshape(len(flat), -1).T], 1).astype(d.dtype) for d in d_by]
    for d in tables:
        d[PAD] = 0
    return tables + d_to


def gradients(net, steps: np.ndarray, weight: np.ndarray, labels: np.ndarray):
    """(mean loss, gradients) of windows (length, n) of bytes; every position has its window's label. weight (length, n): 0 for positions that don't count."""
    back = steps[::-1]
    fore, last_f = _read(net[:6], steps)
    hind, last_h = _read(net[6:12], back)
    ahead = np.stack([k[0] for k in fore[1:]] + [last_f])
    behind = np.stack([k[0] for k in hind[1:]] + [last_h])[::-1]
    logits = ahead @ net[12] + behind @ net[13] + net[14]
    p = np.exp(logits - logits.max(axis=2, keepdims=True))
    p /= p.sum(axis=2, keepdims=True)
    n, total = np.arange(len(labels)), max(weight.sum(), 1e-9)
    loss = -(np.log(p[:, n, labels] + 1e-30) * weight).sum() / total
    d = p.copy()
    d[:, n, labels] -= 1
    d *= (weight / total)[:, :, None]
    k = d.shape[2]
    out = [ahead.reshape(-1, ahead.shape[2]).T @ d.reshape(-1, k), behind.reshape(-1, behind.shape[2]).T @ d.reshape(-1, k), d.sum(axis=(0, 1))]
    grads = _read_back(net[:6], steps, fore, d @ net[12].T) + _read_back(net[6:12], back, hind, (d @ net[13].T)[::-1])
    return loss, grads + out


def first_net(languages: int, rng: np.random.Generator, kind=np.float32) -> list[np.ndarray]:
    u, net = UNITS, []
    for _ in range(2):
        tables = [rng.normal(0, 0.3, (PAD + 1, u)) for _ in range(3)]
        for d, value in zip(tables, (-60, 0, 0), strict=True):
            d[PAD] = value
        net += tables + [rng.normal(0, u**-0.5, (u, u)) for _ in range(3)]
    return [p.astype(kind) for p in [*net, rng.normal(0, 0.3, (u, languages)), rng.normal(0, 0.3, (u, languages)), np.zeros(languages)]]


def _windows(texts: list[np.ndarray], pick: np.ndarray, rng) -> np.ndarray:
    """A window of each picked text from any place, as (WINDOW, n) bytes with pads behind; half of them are shorter, as short texts are."""
    out = np.full((WINDOW, len(pick)), PAD, np.int64)
    for i, k in enumerate(pick.tolist()):
        text, size = texts[k], WINDOW if i % 2 else int(rng.integers(8, WINDOW))
        at = int(rng.integers(0, max(1, len(text) - size + 1)))
        part = text[at : at + size]
        out[: len(part), i] = part
    return out


def fit(texts: list[np.ndarray], labels: np.ndarray, names: list[str]) -> Model:
    """Trains on texts (bytes in lower case) with labels; letters count as positions."""
    rng = np.random.Generator(np.random.PCG64(5))
    n = len(names)
    net = first_net(n, rng)
    moment, square = [np.zeros_like(p) for p in net], [np.zeros_like(p) for p in net]
    by = [np.flatnonzero(labels == k) for k in range(n)]
    # More languages than a batch holds take turns, in more steps, so that each is read as often.
    batch = min(n, BATCH)
    steps = STEPS * -(-n // max(1, batch))
    for step in range(1, steps + 1) if n > 1 else ():
        turn = [by[((step - 1) * batch + i) % n] for i in range(batch)]
        pick = np.concatenate([rng.choice(i, max(1, BATCH // batch)) for i in turn])
        seen = _windows(texts, pick, rng)
        _, grads = gradients(net, seen, _LETTER[seen].astype(np.float32), labels[pick])
        scale = min(1.0, 1.0 / max(1e-9, np.sqrt(sum(float((g * g).sum()) for g in grads))))
        rate = 0.02 * (1 - step / (steps + 1))
        for p, g, m, s in zip(net, grads, moment, square, strict=True):
            g = g * scale
            p[:PAD] *= 1 - rate * DECAY
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return Model(names, net)


def _states(net, steps: np.ndarray, first: int, count: int) -> np.ndarray:
    """(count, n, units): the states after steps first, first + 1, ... of `steps` (length, n)."""
    by, to = net[:3], net[3:]
    shape = (steps.shape[1], len(to[0]))
    h, z, r, c, x = (np.zeros(shape, np.float32) for _ in range(5))
    out = np.empty((count, *shape), np.float32)
    for t, s in enumerate(steps[: first + count]):
        for gate, table_, weight in ((z, by[0], to[0]), (r, by[1], to[1])):
            np.take(table_, s, axis=0, out=gate)
            gate += np.matmul(h, weight, out=x)
            gate *= 0.5
            np.tanh(gate, out=gate)
            gate *= 0.5
            gate += 0.5
        r *= h
        np.take(by[2], s, axis=0, out=c)
        c += np.matmul(r, to[2], out=x)
        np.tanh(c, out=c)
        c -= h
        c *= z
        h += c
        if t >= first:
            out[t - first] = h
    return out


def pooled(model: Model, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, positions): of each text data[at[i]:at[i + 1]] the sum of its letters' probabilities, and their number."""
    n, k = len(at) - 1, len(model.names)
    sums, positions = np.zeros((n, k)), np.zeros(n)
    low, letters = _LOWER[data], np.concatenate([[0], np.cumsum(_LETTER[data])])
    sizes = np.diff(at)
    cuts = -(-sizes // CHUNK)
    owner = np.repeat(np.arange(n), cuts)
    begin = at[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * CHUNK
    full = letters[np.minimum(begin + CHUNK, at[owner + 1])] > letters[begin]
    owner, begin = owner[full], begin[full]
    length = CHUNK + 2 * CONTEXT
    side = max(64, SIDE * 64 // max(64, k))
    for i in range(0, len(owner), side):
        who, start = owner[i : i + side], begin[i : i + side]
        where = start - CONTEXT + np.arange(length)[:, None]
        inside = (where >= at[who]) & (where < at[who + 1])
        steps = np.where(inside, low[np.clip(where, 0, len(low) - 1)], PAD)
        ahead = _states(model.net[:6], steps, CONTEXT, CHUNK)
        behind = _states(model.net[6:12], steps[::-1], CONTEXT, CHUNK)[::-1]
        p = model.net[12].T @ ahead.reshape(-1, UNITS).T + model.net[13].T @ behind.reshape(-1, UNITS).T + model.net[14][:, None]
        p -= p.max(axis=0)
        np.exp(p, out=p)
        p /= p.sum(axis=0)
        count = (_LETTER[steps[CONTEXT : CONTEXT + CHUNK]]).astype(np.float32)
        p = (p.reshape(k, CHUNK, -1) * count).sum(axis=1)
        for j in range(k):
            sums[:, j] += np.bincount(who, p[j], n)
        positions += np.bincount(who, count.sum(axis=0), n)
    return sums, positions


def train(docs: DataFrame) -> Model:
    """Fits on a bounded sample of the rows that aren't held out: TRAIN_ROWS of every language, or as many as keep all of them to TRAIN_ROWS * LANGUAGES, but one at least; up to TRAIN_CHARS of a text, of a longer one four stretches of its words.

    Null lang or id and texts without letters don't count; of rows that repeat an id and lang, one does.
    """
    usable = docs.where("lang is not null and doc_id is not null").where(F.col("text").rlike(r"\p{L}")).where(~held_out())
    ids = staged(usable.select("doc_id", "lang").distinct(), "labelled")
    languages = ids.select("lang").distinct().count()
    quota = min(TRAIN_ROWS, max(1, TRAIN_ROWS * LANGUAGES // max(1, languages)))
    chosen = staged(sampled(ids, "lang", quota), "sample").select("doc_id", "lang")
    rows = usable.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"])
    words = F.when(F.length("text") <= TRAIN_CHARS, F.col("text")).otherwise(F.trim(F.regexp_replace("text", r"[^\p{L}\p{M}]+", " ")))
    rows = rows.withColumn("text", words).select("doc_id", "lang", place().alias("place"), stretches("text", TRAIN_CHARS).alias("text"))
    got = first_rows(rows.groupBy("doc_id", "lang", "place").agg(F.min("text").alias("text")).collect(), "lang", quota)
    names = sorted({r["lang"] for r in got})
    spot = {x: k for k, x in enumerate(names)}
    texts = [_LOWER[np.frombuffer(r["text"].encode(), np.uint8)] for r in got]
    model = fit(texts, np.array([spot[r["lang"]] for r in got], np.int64), names)
    W.trim()
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of each whole text: the language whose mean probability over the letters' positions is largest, of equal ones the first by name, and that mean.

    `und` with score 0 if the text is null or has no letter, or no language was learned. Rows are independent: repeated and
    null ids stay as they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for batch in W.slices(whole, "text", 2 << 20):
                texts, k = batch.column("text"), len(m.names)
                letters = np.array([t is not None and any(map(str.isalpha, t)) for t in texts.to_pylist()], bool) & (k > 0)
                best, score = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
                if letters.any():
                    sums, positions = pooled(m, *W.column_bytes(texts))
                    share = sums / np.maximum(positions, 1)[:, None]
                    best, score = share.argmax(axis=1), np.clip(share.max(axis=1), 0, 1)
                names = [m.names[b] if ok else "und" for b, ok in zip(best.tolist(), letters.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(np.where(letters, score, 0.0))], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op10_language(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, train(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
