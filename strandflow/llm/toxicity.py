"""Operator 9, toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word is the sum of a hashed word vector and the mean of its hashed character-trigram vectors.  Windows of ``WINDOW`` words,
a new one every ``STEP``, run through two gated recurrent layers (one from either end), attention pools their states, and
a logistic unit scores the window.  A document's score is that of its most toxic window, calibrated to a probability.

Labels mark documents, not windows: a toxic document teaches with the window that a first word model, then the network
itself, finds most toxic, and a clean one with all its windows.  The network is fitted on a bounded sample: ``SAMPLE`` labelled
documents of each class, the first in an order of hashed ids, and at most ``WINDOWS`` clean windows.  Every window of every
document is scored.  Only the text enters a score.

A score is the text's alone, whatever texts share its batch: states are rounded to ``STATE`` bits and weights to as many bits
as keep every product sum exact in single precision, so a matrix product is the same in any order, shape and place; all
else works element by element.

Defined results: null and empty texts get the score of an empty window; equal texts get equal scores; null labels and labels without a document
teach nothing; without labels of both classes every score is the share of toxic labels, 0 without any; repeated rows are
scored each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.llm.common import fresh, id_and_text, keeps, per_batch, use, utf8

WINDOW, STEP = 32, 24
#: Documents of each class, and clean windows, that the network is fitted on at most; bytes of a document that is fitted on.
SAMPLE, WINDOWS, LONGEST = 1500, 16_000, 1 << 15
#: Bits after the point of a state when scoring, and of inputs and their weights, whose products are summed in double precision.
STATE, INPUT = 11, 16
WORDS, TRIGRAMS, DIM, HIDDEN, EPOCHS, BATCH, RATE = 1 << 15, 1 << 13, 16, 8, 6, 128, 0.01
_STRIP = b".,;:!?\"'()[]{}<>*#&%$|-_"
#: Words whose projections a worker keeps.
CACHE = 1 << 17


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of lower-case words: buckets (0 is padding), the buckets of all their character trigrams, and how many each has."""
    bare = [w.strip(_STRIP) or w for w in words]
    buckets = 1 + np.fromiter(map(zlib.crc32, bare), np.int64, len(bare)) % (WORDS - 1)
    marked = [f"^{w.decode('utf-8', 'replace').lower()}$ " for w in bare]
    x = np.frombuffer("".join(marked).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    n = np.fromiter(map(len, marked), np.int64, len(marked))
    code = ((x[:-2] << np.uint64(42)) ^ (x[1:-1] << np.uint64(21)) ^ x[2:]) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)
    # Trigrams of ^word$ only: neither those with the blank that ends it nor those beyond; ^$ counts as one.
    start = np.cumsum(n) - n
    many = np.maximum(n - 3, 1)
    take = np.repeat(start - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
    return buckets, (code[take] % np.uint64(TRIGRAMS)).astype(np.int64), many


def windows(n: int) -> list[tuple[int, int]]:
    """Overlapping windows over n words; one empty window for none."""
    out, i = [], 0
    while True:
        out.append((i, min(n, i + WINDOW)))
        if i + WINDOW >= n:
            return out
        i += STEP


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _rounded(x: np.ndarray, bits: int) -> np.ndarray:
    return np.rint(x * x.dtype.type(1 << bits)) * x.dtype.type(2.0**-bits)


def _exact(w: np.ndarray) -> np.ndarray:
    """Weights rounded so that sums of their products with states in [-1, 1] of STATE bits have at most 24 bits."""
    most = float(np.abs(w).sum(axis=0).max())
    return _rounded(w, max(0, 24 - STATE - 1 - int(np.ceil(np.log2(most + 1e-9)))))


class Network:
    """Parameters, and forward and backward passes over windows given as matrices of word rows."""

    def __init__(self, seed: int = 7):
        g = np.random.default_rng(seed)
        r = lambda *s, k=1.0: (g.standard_normal(s) * k).astype(np.float32)
        d, h = DIM, HIDDEN
        self.p = {"ew": r(WORDS, d, k=0.1), "ec": r(TRIGRAMS, d, k=0.1), "wo": r(2 * h, k=0.3), "bo": np.zeros(1, np.float32), "wa": r(2 * h, h, k=0.3), "ba": np.zeros(h, np.float32), "va": r(h, k=0.3)}
        for s in "fb":
            self.p |= {f"wx{s}": r(d, 3 * h, k=d**-0.5), f"uh{s}": r(h, 3 * h, k=h**-0.5), f"bx{s}": np.zeros(3 * h, np.float32)}
        self.p["ew"][0] = 0
        self.scale, self.shift = 1.0, 0.0

    def inputs(self, words: list[bytes]) -> np.ndarray:
        """A vector for each word."""
        if not words:
            return np.zeros((0, DIM), np.float32)
        buckets, flat, n = word_features(words)
        chars = np.add.reduceat(self.p["ec"][flat], np.cumsum(n) - n, axis=0) / n[:, None].astype(np.float32)
        return self.p["ew"][buckets] + chars

    def projections(self, words: list[bytes]) -> np.ndarray:
        """Both directions' gate inputs for each word, some thousand words at a time."""
        out = np.zeros((len(words), 6 * HIDDEN), np.float32)
        weights = [_rounded(self.p[f"wx{s}"].astype(np.float64), INPUT) for s in "fb"]
        for i in range(0, len(words), 16_384):
            x = _rounded(self.inputs(words[i : i + 16_384]).astype(np.float64), INPUT)
            out[i : i + 16_384] = np.concatenate([x @ w + self.p[f"bx{s}"] for s, w in zip("fb", weights, strict=True)], axis=1)
        return out

    def run(self, px: np.ndarray, idx: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Logits of windows: idx (n, WINDOW) are rows of px; no more is kept than a step needs, but for the states."""
        n, h = len(idx), HIDDEN
        steps = max(1, int(lengths.max(initial=0)))
        states = np.zeros((steps, n, 2 * h), np.float32)
        for s, order in ((0, range(steps)), (1, range(steps - 1, -1, -1))):
            u, state = _exact(self.p["uh" + "fb"[s]]), np.zeros((n, h), np.float32)
            for t in order:
                x = px[idx[:, t], 3 * h * s : 3 * h * (s + 1)]
                y = state @ u
                gate = _sigmoid(x[:, : 2 * h] + y[:, : 2 * h])
                new = np.tanh(x[:, 2 * h :] + gate[:, h:] * y[:, 2 * h :])
                new += gate[:, :h] * (state - new)
                new = _rounded(new, STATE)
                on = (t < lengths)[:, None]
                state = np.where(on, new, state) if not on.all() else new
                states[t, :, s * h : (s + 1) * h] = state
        a = _rounded(np.tanh(states @ _exact(self.p["wa"]) + self.p["ba"]), STATE) @ _exact(self.p["va"])
        a = np.where(np.arange(steps)[:, None] < lengths[None, :], a, np.float32(-1e9))
        a = np.exp(a - a.max(axis=0))
        # Sums step by step, not by a reduction whose order may follow the shape.
        total, pooled = np.zeros(n, np.float32), np.zeros((n, 2 * h), np.float32)
        for t in range(steps):
            total += a[t]
            pooled += a[t][:, None] * states[t]
        out = np.full(n, self.p["bo"][0], np.float32)
        for j in range(2 * h):
            out += np.where(lengths > 0, pooled[:, j] / total, np.float32(0)) * self.p["wo"][j]
        return out

    def learn(self, x: np.ndarray, lengths: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[dict, np.ndarray, float]:
        """Gradients of the weighted log loss for inputs x (n, WINDOW, DIM); those of x; the loss."""
        n, h, T, p = len(x), HIDDEN, x.shape[1], self.p
        on = (np.arange(T)[:, None] < lengths[None, :])[:, :, None]
        xs, keep, states = x.transpose(1, 0, 2), {}, np.zeros((T, n, 2 * h), np.float32)
        for s in (0, 1):
            c, state = "fb"[s], np.zeros((n, h), np.float32)
            gx = xs @ p[f"wx{c}"] + p[f"bx{c}"]
            for t in range(T) if s == 0 else range(T - 1, -1, -1):
                yv = state @ p[f"uh{c}"]
                gate = _sigmoid(gx[t, :, : 2 * h] + yv[:, : 2 * h])
                new = np.tanh(gx[t, :, 2 * h :] + gate[:, h:] * yv[:, 2 * h :])
                keep[s, t] = (state, gate, new, yv[:, 2 * h :])
                state = np.where(on[t], new + gate[:, :h] * (state - new), state)
                states[t, :, s * h : (s + 1) * h] = state
        e = np.tanh(states @ p["wa"] + p["ba"])
        a = np.where(on[:, :, 0], e @ p["va"], np.float32(-1e9))
        a = np.exp(a - a.max(axis=0))
        a /= a.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", a, states)
        q = _sigmoid(pooled @ p["wo"] + p["bo"][0])
        loss = float(-(weight * (y * np.log(q + 1e-7) + (1 - y) * np.log(1 - q + 1e-7))).sum() / weight.sum())
        g = {}
        d = ((q - y) * weight / weight.sum()).astype(np.float32)
        g["wo"], g["bo"] = pooled.T @ d, d.sum(keepdims=True)
        dp = d[:, None] * p["wo"]
        ds = a[:, :, None] * dp
        da = np.einsum("nh,tnh->tn", dp, states)
        da = a * (da - (a * da).sum(axis=0))
        de = da[:, :, None] * p["va"] * (1 - e * e)
        g["va"] = np.einsum("tn,tnh->h", da, e)
        g["wa"], g["ba"] = np.einsum("tnk,tnh->kh", states, de), de.sum(axis=(0, 1))
        ds += de @ p["wa"].T
        dx = np.zeros_like(xs)
        for s in (0, 1):
            c, back = "fb"[s], np.zeros((n, h), np.float32)
            dgx = np.zeros((T, n, 3 * h), np.float32)
            du = np.zeros_like(p[f"uh{c}"])
            for t in range(T - 1, -1, -1) if s == 0 else range(T):
                state, gate, new, yn = keep[s, t]
                dh = ds[t, :, s * h : (s + 1) * h] + back
                live = np.where(on[t], dh, 0)
                z, r = gate[:, :h], gate[:, h:]
                dn = live * (1 - z) * (1 - new * new)
                dz = live * (state - new) * z * (1 - z)
                dr = dn * yn * r * (1 - r)
                dy = np.concatenate((dz, dr, dn * r), axis=1)
                dgx[t] = np.concatenate((dz, dr, dn), axis=1)
                du += state.T @ dy
                back = np.where(on[t], live * z, dh) + dy @ p[f"uh{c}"].T
            g[f"uh{c}"], g[f"bx{c}"] = du, dgx.sum(axis=(0, 1))
            g[f"wx{c}"] = np.einsum("tnd,tnh->dh", xs, dgx)
            dx += dgx @ p[f"wx{c}"].T
        return g, dx.transpose(1, 0, 2), loss


class _Adam:
    def __init__(self, p: dict, rate: float):
        self.m, self.v, self.t, self.rate = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0, rate

    def step(self, p: dict, g: dict) -> None:
        self.t += 1
        rate = self.rate * (1 - 0.999**self.t) ** 0.5 / (1 - 0.9**self.t)
        for k, x in g.items():
            self.m[k] += 0.1 * (x - self.m[k])
            self.v[k] += 0.001 * (x * x - self.v[k])
            p[k] -= rate * self.m[k] / (np.sqrt(self.v[k]) + 1e-7)


def _matrix(docs: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of documents of word numbers: numbers (0: padding), lengths, and the document of each."""
    rows = [(i, a, b) for i, d in enumerate(docs) for a, b in windows(len(d))]
    idx = np.zeros((len(rows), WINDOW), np.int64)
    for k, (i, a, b) in enumerate(rows):
        idx[k, : b - a] = docs[i][a:b]
    return idx, np.array([b - a for _, a, b in rows]), np.array([i for i, _, _ in rows])


def fit(texts: list[bytes], toxic: list[int], totals: tuple[float, float], seed: int = 7) -> Network:
    """Train on documents and their labels; ``totals`` are the numbers of clean and toxic labels they stand for."""
    net, g = Network(seed), np.random.default_rng(seed)
    vocabulary: dict[bytes, int] = {b"": 0}
    docs = [[vocabulary.setdefault(w, len(vocabulary)) for w in t.lower().split()] for t in texts]
    y = np.array(toxic, np.float32)
    words = list(vocabulary)
    bucket, flat, n = word_features(words)
    at, wid = np.cumsum(n) - n, np.r_[0, bucket[1:]]
    # First word model: smoothed log odds of a document's being toxic given the word's bucket.
    pos, neg = np.ones(WORDS), np.ones(WORDS)
    for d, label in zip(docs, y, strict=True):
        (pos if label else neg)[np.unique(bucket[d])] += 1
    odds = np.log(pos / (y.sum() + 2)) - np.log(neg / (len(y) - y.sum() + 2))
    odds[(pos + neg) < 6] = 0
    idx, lengths, owner = _matrix(docs)
    evidence = np.where(idx > 0, odds[bucket][idx], -9).max(axis=1)
    clean = np.flatnonzero(y[owner] == 0)
    if len(clean) > WINDOWS:
        clean = g.choice(clean, WINDOWS, replace=False)
    adam = _Adam(net.p, RATE)

    def vectors(ids):
        # The mean of the trigrams' vectors of each distinct word, for the words of a batch.
        span = n[ids]
        take = np.repeat(at[ids] - np.cumsum(span) + span, span) + np.arange(span.sum())
        chars = np.add.reduceat(net.p["ec"][flat[take]], np.cumsum(span) - span, axis=0) / span[:, None]
        return (net.p["ew"][wid[ids]] + chars).astype(np.float32), take, span

    for epoch in range(EPOCHS):
        if epoch >= 2:
            px = net.projections(words)
            evidence = np.concatenate([net.run(px, idx[i : i + 2048], lengths[i : i + 2048]) for i in range(0, len(idx), 2048)])
        order = np.lexsort((-evidence, owner))
        best = order[np.r_[True, owner[order][1:] != owner[order][:-1]]]
        rows = np.concatenate((clean, best[y[owner[best]] == 1]))
        g.shuffle(rows)
        adam.rate = RATE * (1 if epoch < EPOCHS - 2 else 0.3)
        for i in range(0, len(rows), BATCH):
            k = rows[i : i + BATCH]
            T = max(1, int(lengths[k].max()))
            ids, inverse = np.unique(idx[k, :T], return_inverse=True)
            x, take, span = vectors(ids)
            x[ids == 0] = 0
            inverse = inverse.reshape(len(k), T)
            target = y[owner[k]]
            weight = np.where(target == 1, 2.0, 1.0).astype(np.float32)
            grads, dx, _ = net.learn(x[inverse], lengths[k], target, weight)
            dv = np.zeros_like(x)
            np.add.at(dv, inverse.ravel(), dx.reshape(-1, DIM))
            dv[ids == 0] = 0
            ew, ec = np.zeros_like(net.p["ew"]), np.zeros_like(net.p["ec"])
            np.add.at(ew, wid[ids], dv)
            np.add.at(ec, flat[take], np.repeat(dv / span[:, None], span, axis=0))
            adam.step(net.p, grads | {"ew": ew, "ec": ec})
    # Calibration: the best window's logit of each document against its label, weighted to the labels' shares.
    px = net.projections(words)
    logit = np.concatenate([net.run(px, idx[i : i + 2048], lengths[i : i + 2048]) for i in range(0, len(idx), 2048)])
    top = np.full(len(docs), -np.inf)
    np.maximum.at(top, owner, logit)
    weight = np.where(y == 1, totals[1] / max(1, y.sum()), totals[0] / max(1, (1 - y).sum()))
    weight /= weight.sum()
    a, b = 0.5, -1.0
    for _ in range(100):
        q = _sigmoid(a * top + b)
        r, s = weight * (q - y), weight * q * (1 - q) + 1e-9
        hess = np.array([[(s * top * top).sum() + 1e-3, (s * top).sum()], [(s * top).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(hess, np.array([(r * top).sum() + 1e-3 * (a - 0.5), r.sum()]))
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
    net.scale, net.shift = float(max(a, 0.05)), float(b)
    return net


class Scorer:
    """Scores texts, with the gate inputs of the words met lately."""

    def __init__(self, net: Network):
        self.net = net
        self.px = np.zeros((CACHE, 6 * HIDDEN), np.float32)
        self.px[0] = net.projections([b""])[0]
        self.row: dict[bytes, int] = {b"": 0}

    def rows(self, words: list[bytes]) -> list[int]:
        new = [w for w in dict.fromkeys(words) if w not in self.row]
        if len(self.row) + len(new) > CACHE:
            self.row = {b"": 0}
            new = list(dict.fromkeys(words))
            if len(new) >= len(self.px):
                self.px = np.concatenate((self.px, np.zeros((len(new) + 1 - len(self.px), self.px.shape[1]), np.float32)))
        if new:
            at = len(self.row)
            self.px[at : at + len(new)] = self.net.projections(new)
            self.row.update(zip(new, range(at, at + len(new)), strict=True))
        return list(map(self.row.__getitem__, words))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        top = np.full(len(texts), -np.inf)
        held, owner = [], []

        def flush():
            if not held:
                return
            words = [w for x in held for w in x]
            flat = np.array(self.rows(words), np.int64)
            lengths = np.array([len(x) for x in held])
            idx = np.zeros((len(held), WINDOW), np.int64)
            idx[np.arange(WINDOW)[None, :] < lengths[:, None]] = flat
            np.maximum.at(top, owner, self.net.run(self.px, idx, lengths))
            held.clear()
            owner.clear()

        for i, t in enumerate(texts):
            words = t.lower().split()
            for a, b in windows(len(words)):
                held.append(words[a:b])
                owner.append(i)
                if len(held) >= 1024:
                    flush()
        flush()
        return _sigmoid(self.net.scale * top + self.net.shift)


class Constant:
    """What there is without labels of both classes."""

    def __init__(self, share: float):
        self.share = share

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return np.full(len(texts), self.share)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", only=None) -> Network | Constant:
    """Fit on a bounded sample of the labelled rows for which ``only`` (a condition on ``doc_id``) holds.

    Of the sampled documents those of at most ``LONGEST`` bytes teach, so what comes to the driver has a bound in bytes.
    """
    marks = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    if only is not None:
        marks = marks.where(only(F.col("doc_id")))
    counts = {r.y: r.n for r in marks.groupBy("y").agg(F.count("*").alias("n")).collect()}
    clean, toxic = counts.get(0, 0), counts.get(1, 0)
    if not clean or not toxic:
        return Constant(1.0 if toxic else 0.0)
    spark = docs.sparkSession
    ids: dict[int, int] = {}
    for y in (0, 1):
        for r in marks.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).collect():
            ids[r.doc_id] = max(r.y, ids.get(r.doc_id, 0))
    # At most 2 * SAMPLE ids: a bounded broadcast.  A repeated id teaches once.
    chosen = spark.createDataFrame(list(ids.items()), "doc_id long, y int")
    rows = id_and_text(docs, id_col, text_col).where(F.length("text") <= LONGEST).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y")).collect()
    rows.sort(key=lambda r: r.doc_id)
    y = [r.y for r in rows]
    if len(set(y)) < 2:
        return Constant(toxic / (clean + toxic))
    return fit([bytes(r.text) for r in rows], y, (clean, toxic))


_SCORERS: dict[str, Scorer | Constant] = {}
keeps("toxicity", _SCORERS)


def _scorer(shared, tag: str) -> Scorer | Constant:
    use("toxicity")
    if tag not in _SCORERS:
        _SCORERS.clear()
        model = shared.value
        _SCORERS[tag] = Scorer(model) if isinstance(model, Network) else model
    return _SCORERS[tag]


def _share(docs: DataFrame, model):
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return shared, f"{docs.sparkSession.sparkContext.applicationId}-{shared._jbroadcast.id()}"


def score(docs: DataFrame, model: Network | Constant, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score of every whole text."""
    shared, tag = _share(docs, model)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(_scorer(shared, tag).scores(b.column("text").to_pylist()), pa.float64())], ["doc_id", "score"])

    return id_and_text(docs, id_col, text_col).mapInArrow(per_batch(run), "doc_id long, score double")


def drop_toxic(docs: DataFrame, model: Network | Constant, threshold: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below the threshold, all columns as they were; no shuffle."""
    shared, tag = _share(docs, model)
    name = fresh(docs, "__utf8")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        keep = _scorer(shared, tag).scores(b.column(name).to_pylist()) < threshold
        return b.filter(pa.array(keep)).select([c for c in b.schema.names if c != name])

    return docs.withColumn(name, utf8(text_col)).mapInArrow(per_batch(run), docs.schema)
