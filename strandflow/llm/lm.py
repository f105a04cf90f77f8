"""Operator 6, language-model scoring: a causal self-attention model over subword ids, trained in numpy.

All training rows are learnt from, in passes over a table of all texts' ids that is written once.  Pass one counts every id and
its neighbours, from which ids get their classes.  Pass two counts every id behind every class, and every pair of classes.  Pass
three trains the attention: it begins with the counted probabilities of a class after a class, each task learns from its own rows (of
each text at least one window and one in ``SHARE``, so what teaches grows with the corpus), and the tasks' parameters are averaged by
the windows they have seen.  What tasks report are vectors of the model's size, summed in two steps.  No sample of texts is drawn.

The model gives P(id | context) = P(class of id | context) * P(id | class, id before).  Classes are the most frequent ids, each its
own, and groups of the rest by the company they keep; the first factor is one causal attention layer over a context window,
the second smoothed corpus counts, so the whole is a distribution over all ids and an end.  Windows of ``WINDOW`` inputs overlap;
each id is scored once, in the window that gives it the most context; a batch of windows is one masked attention.  The
score is that of the library's normalised ids, in which case and runs of spaces are one.

The base score sums word by word: frequent words (at most ``HEAD``, a proven bound) are broadcast, the counts of all others
are joined by word, which can't be hot as no such word is frequent.

Defined results: null and empty texts are the end alone; a null id counts as an empty text in the fold; without
training rows the model is uniform over ids and the base is log10(1) a word; repeated rows are scored each;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import copy
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandflow.llm.common import ascii_words, cut, id_and_text, keeps, small_batches, use, utf8
from strandflow.llm.tokens import WordIds, encoder

WINDOW, STEP, DIM, CLASSES, SINGLE, ROWS = 32, 24, 16, 64, 24, 2000
#: Steps of ``Attention.fit``, which learns from streams in memory; windows of a step and its first rate; words that are broadcast at most.
STEPS, BATCH, RATE, HEAD = 1200, 48, 0.01, 1 << 18
#: Of a text's windows one in SHARE teaches, and one at least; steps after which a task's rate falls; buckets of an id's neighbours on either side.
SHARE, SLOWS, SIDES = 16, 200, 16
#: Ids of a task that are few, and how often their windows teach then.
FEW, AGAIN = 1 << 20, 2
#: Numbers in a block of a vector that tasks report, and groups of tasks in the first step of its sum.
PIECE, GROUPS = 1 << 15, 64
#: Ids that a task counts at once; weight of a class's share where few classes were before it.
COUNTED, SHY = 1 << 21, 10.0
#: Weight of P(id | class) where P(id | class, what is before) has few counts.
DRAWN = 4.0
#: Distinct words that a task counts before it passes them on.
FLUSH = 300_000


def word_counts(texts: DataFrame) -> DataFrame:
    """w, c: every word of the texts, and the end (an empty word) once for each text."""

    def count(batches):
        seen: Counter = Counter()
        for b in small_batches(batches):
            for t in b.column("text").to_pylist():
                seen.update(ascii_words(t))
            seen[b""] += b.num_rows
            if len(seen) > FLUSH:
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["w", "c"])
                seen = Counter()
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["w", "c"])

    return texts.select("text").mapInArrow(count, "w binary, c long").groupBy("w").agg(F.sum("c").alias("c"))


def summed(rows: DataFrame, whole, size: int) -> np.ndarray:
    """The sum over all tasks of the vectors of ``size`` numbers that ``whole`` makes of a task's batches (None: nothing)."""
    schema = "block int, part int, at binary, data binary"

    def batch(blocks: dict[int, np.ndarray], part: int) -> pa.RecordBatch:
        # Only what isn't zero: places in the block, and numbers.
        places = [np.flatnonzero(x) for x in blocks.values()]
        data = [x[at].astype("<f8").tobytes() for at, x in zip(places, blocks.values(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int32()), pa.array([part] * len(data), pa.int32()), pa.array([at.astype("<u2").tobytes() for at in places], pa.binary()), pa.array(data, pa.binary())], ["block", "part", "at", "data"])

    def report(batches):
        v = whole(small_batches(batches))
        if v is not None:
            yield batch({k // PIECE: x for k in range(0, size, PIECE) if (x := v[k : k + PIECE]).any()}, TaskContext.get().partitionId() % GROUPS)

    def add(batches):
        blocks: dict[int, np.ndarray] = {}
        for b in small_batches(batches):
            for k, at, raw in zip(*(b.column(c).to_pylist() for c in ("block", "at", "data")), strict=True):
                blocks.setdefault(k, np.zeros(PIECE))[np.frombuffer(at, "<u2")] += np.frombuffer(raw, "<f8")
        if blocks:
            yield batch(blocks, 0)

    some = rows.mapInArrow(report, schema).repartition("block", "part").mapInArrow(add, schema)
    out = np.zeros(-(-size // PIECE) * PIECE)
    for r in some.repartition("block").mapInArrow(add, schema).collect():
        out[r.block * PIECE + np.frombuffer(bytes(r.at), "<u2").astype(np.int64)] += np.frombuffer(bytes(r.data), "<f8")
    return out[:size]


def _flat(b: pa.RecordBatch, kind: np.dtype, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a batch's texts, each with its end, and where each text begins."""
    use("passes")
    ids = [np.frombuffer(x, kind).astype(np.int64) for x in b.column("ids").to_pylist()]
    sizes = np.fromiter(map(len, ids), np.int64, len(ids)) + 1
    begin = np.cumsum(sizes) - sizes
    flat = np.full(int(sizes.sum()), end, np.int64)
    for at, x in zip(begin.tolist(), ids, strict=True):
        flat[at : at + len(x)] = x
    return flat, begin


def bucket(ids: np.ndarray) -> np.ndarray:
    return (ids * 0x9E3779B1 & 0xFFFFFFFF) * SIDES >> 32


def neighbours(stored: DataFrame, kind: np.dtype, end: int) -> np.ndarray:
    """(end + 1, 1 + 2 * SIDES): how often each id is there, and with what buckets of ids before and after it."""
    wide = 1 + 2 * SIDES

    def whole(batches):
        v = None
        for b in batches:
            flat, begin = _flat(b, kind, end)
            side, at = bucket(flat), flat * wide
            # Cells of what is before and of what is after; across two texts neither counts.
            before, after = at[1:] + side[:-1] + 1, at[:-1] + side[1:] + 1 + SIDES
            before[begin[1:] - 1], after[begin[1:] - 1] = flat[begin[1:]] * wide, 0
            if v is None:
                v = np.zeros((end + 1) * wide, np.int64)
            v += np.bincount(before, minlength=len(v))
            v += np.bincount(after, minlength=len(v))
            # Cell 0 took the gaps between texts; the first text's first id has no cell yet.
            v[0] -= len(begin) - 1
            v[at[0]] += 1
        if v is None:
            return None
        # An id is there as often as something, or the beginning, is before it.
        table = v.reshape(end + 1, wide)
        table[:, 0] += table[:, 1 : 1 + SIDES].sum(axis=1)
        return v.astype(np.float64)

    return summed(stored, whole, (end + 1) * wide).reshape(end + 1, wide)


def classes(counts: np.ndarray, near: np.ndarray, seed: int = 5) -> np.ndarray:
    """The class of each id: frequent ones alone, all others by k-means over their neighbours' buckets; the last for ids never seen."""
    g = np.random.default_rng(seed)
    n, end = len(counts), len(counts) - 1
    out = np.full(n, CLASSES - 1)
    order = np.argsort(-counts, kind="stable")
    order = order[counts[order] > 0]
    single = [x for x in order if x != end][: SINGLE - 1]
    out[single], out[end] = np.arange(len(single)), SINGLE - 1
    rest = np.array([x for x in order if x != end][SINGLE - 1 :], np.int64)
    groups = CLASSES - 1 - SINGLE
    if len(rest) <= groups:
        out[rest] = SINGLE + np.arange(len(rest))
        return out
    # Square roots of shares; the length tells ids that begin, end or are a word from others.
    table = near[rest].astype(np.float64)
    table = np.sqrt(table / np.maximum(1, table.sum(axis=1, keepdims=True)))
    centre = table[g.choice(min(len(rest), 1500), groups, replace=False)]
    for _ in range(12):
        group = (table @ centre.T * 2 - (centre * centre).sum(axis=1)).argmax(axis=1)
        for k in range(groups):
            if (group == k).any():
                centre[k] = np.average(table[group == k], axis=0, weights=counts[rest[group == k]])
    out[rest] = SINGLE + group
    return out


class _Adam:
    def __init__(self, p: dict):
        self.p, self.t = p, 0
        self.m, self.v = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}

    def step(self, grad: dict, rate: float) -> None:
        self.t += 1
        rate *= (1 - 0.999**self.t) ** 0.5 / (1 - 0.9**self.t)
        for k, d in grad.items():
            self.m[k] += 0.1 * (d - self.m[k])
            self.v[k] += 0.001 * (d * d - self.v[k])
            self.p[k] -= rate * self.m[k] / (np.sqrt(self.v[k]) + 1e-8)


class Attention:
    """One causal attention layer and a softmax over classes, over input rows (frequent ids, else classes)."""

    def __init__(self, counts: np.ndarray, cls: np.ndarray, closes: np.ndarray, seed: int = 11):
        """``closes``: whether an id ends a word."""
        g = np.random.default_rng(seed)
        self.cls, self.end = cls, len(counts) - 1
        self.before = np.where(closes, CLASSES, cls)
        self.alone, self.within = (counts + 0.5) / np.bincount(cls, weights=counts + 0.5, minlength=CLASSES)[cls], None
        # Input rows: 0 is the beginning, then the frequent ids, then a row for each class.
        self.row = 1 + ROWS + cls
        top = np.argsort(-counts, kind="stable")[:ROWS]
        self.row[top] = 1 + np.arange(len(top))
        self.kin = np.r_[CLASSES, cls[top], np.zeros(ROWS - len(top), int), np.arange(CLASSES)]
        n, r = 1 + ROWS + CLASSES, lambda *s, k: (g.standard_normal(s) * k).astype(np.float32)
        share = np.bincount(cls, weights=counts, minlength=CLASSES) + 0.5
        self.p = {"e": r(n, DIM, k=0.02), "ec": r(CLASSES + 1, DIM, k=0.3), "pos": r(WINDOW, DIM, k=0.1), "q": r(DIM, DIM, k=0.25), "k": r(DIM, DIM, k=0.25), "v": r(DIM, DIM, k=0.25), "o": r(DIM, DIM, k=0.25), "c": r(DIM, CLASSES, k=0.25), "g": np.zeros((CLASSES + 1, CLASSES), np.float32), "b": np.log(share / share.sum()).astype(np.float32)}
        # A class without ids gets no probability.
        self.p["b"][np.bincount(cls, minlength=CLASSES) == 0] = -1e4
        self.mask = np.where(np.tri(WINDOW, dtype=bool), 0, -1e9).astype(np.float32)

    def count(self, seen: np.ndarray) -> Attention:
        """P(id | its class, what is before) from counts (what is before, id), drawn towards P(id | its class)."""
        full = np.stack([np.bincount(self.cls, weights=row, minlength=CLASSES) for row in seen])
        self.within = np.log((seen + DRAWN * self.alone) / (full[:, self.cls] + DRAWN)).astype(np.float32)
        return self

    def begin(self, pairs: np.ndarray) -> Attention:
        """Start from counts (class before or CLASSES, class): P(class | class before), to which the attention adds its part."""
        share = pairs.sum(axis=0) + 0.5
        live = np.bincount(self.cls, minlength=CLASSES) > 0
        share = np.log(share / share.sum())
        after = np.log((pairs + SHY * np.exp(share)) / (pairs.sum(axis=1, keepdims=True) + SHY))
        self.p["b"] = np.where(live, share, -1e4).astype(np.float32)
        self.p["g"] = np.where(live, after - share, 0).astype(np.float32)
        return self

    def places(self, ids: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """What is before each id of some texts: the class of the id before, or CLASSES where a word or a text begins."""
        prev = np.r_[CLASSES, self.before[ids[:-1]]]
        prev[begin] = CLASSES
        return prev

    def loss(self, rows: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, dict]:
        """Mean loss of a batch (windows, WINDOW) and the gradients."""
        p, kin, n = self.p, self.kin[rows], weight.sum()
        x = p["e"][rows] + p["ec"][kin] + p["pos"]
        q, k, v = x @ p["q"], x @ p["k"], x @ p["v"]
        a = q @ k.transpose(0, 2, 1) * DIM**-0.5 + self.mask
        a = np.exp(a - a.max(axis=2, keepdims=True))
        a /= a.sum(axis=2, keepdims=True)
        m = a @ v
        h = x + m @ p["o"]
        z = h @ p["c"] + p["g"][kin] + p["b"]
        z -= z.max(axis=2, keepdims=True)
        e = np.exp(z)
        s = e.sum(axis=2, keepdims=True)
        i, j = np.indices(target.shape)
        loss = float(-((z[i, j, target] - np.log(s[:, :, 0])) * weight).sum() / n)
        dz = e / s
        dz[i, j, target] -= 1
        dz *= (weight / n)[:, :, None]
        flat = lambda y: y.reshape(-1, y.shape[-1])
        # Sums by class are products with a 0-1 matrix; by input row, runs of the rows in order.
        ones = np.zeros((rows.size, CLASSES + 1), np.float32)
        ones[np.arange(rows.size), kin.ravel()] = 1
        g = {"c": flat(h).T @ flat(dz), "b": dz.sum(axis=(0, 1)), "g": ones.T @ flat(dz)}
        dh = dz @ p["c"].T
        g["o"] = flat(m).T @ flat(dh)
        dm = dh @ p["o"].T
        da, dv = dm @ v.transpose(0, 2, 1), a.transpose(0, 2, 1) @ dm
        da = a * (da - (a * da).sum(axis=2, keepdims=True)) * DIM**-0.5
        dq, dk = da @ k, da.transpose(0, 2, 1) @ q
        dx = dh + dq @ p["q"].T + dk @ p["k"].T + dv @ p["v"].T
        for name, d in (("q", dq), ("k", dk), ("v", dv)):
            g[name] = flat(x).T @ flat(d)
        g["pos"], g["e"], g["ec"] = dx.sum(axis=0), np.zeros_like(p["e"]), ones.T @ flat(dx)
        order = np.argsort(rows, axis=None, kind="stable")
        there = rows.ravel()[order]
        first = np.flatnonzero(np.r_[True, there[1:] != there[:-1]])
        g["e"][there[first]] = np.add.reduceat(flat(dx)[order], first)
        return loss, g

    def fit(self, streams: list[np.ndarray], seed: int = 3, steps: int | None = None) -> Attention:
        """Adam over random windows of the streams (each of ids with the end)."""
        steps = STEPS if steps is None else steps
        rows, target, weight = (np.concatenate(x) if x else np.zeros((0, WINDOW)) for x in zip(*(self.windows(s) for s in streams), strict=True)) if streams else (np.zeros((0, WINDOW)),) * 3
        g, adam = np.random.default_rng(seed), _Adam(self.p)
        for t in range(1, steps + 1 if len(rows) else 1):
            take = g.integers(0, len(rows), BATCH)
            adam.step(self.loss(rows[take], target[take], weight[take])[1], RATE * (1 - t / (steps + 1)))
        return self

    def go_on(self, streams) -> int:
        """Adam over one window in SHARE of each stream, one at least, in order; how many windows there were.

        Streams of at most FEW ids together, as of a small table, teach with all their windows, AGAIN times or in STEPS steps.
        """
        adam, held, seen, few, size = _Adam(self.p), [], 0, [], 0

        def step(least: int) -> None:
            if sum(len(x[0]) for x in held) < least:
                return
            rows, target, weight = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            for i in range(0, len(rows), BATCH):
                if len(rows) - i < least:
                    held.append((rows[i:], target[i:], weight[i:]))
                else:
                    adam.step(self.loss(rows[i : i + BATCH], target[i : i + BATCH], weight[i : i + BATCH])[1], RATE * (1 + adam.t / SLOWS) ** -0.5)

        for ids in streams:
            many = self.many(len(ids))
            # Which one comes first follows from the text, so that all places of texts teach.
            take = np.arange(zlib.crc32(ids.tobytes()) % min(SHARE, many), many, SHARE)
            for i in range(0, len(take), 4096):
                held.append(self.windows(ids, take[i : i + 4096]))
                if len(held) >= BATCH or len(held[-1][0]) >= BATCH:
                    step(BATCH)
            seen += len(take)
            size += len(ids)
            if size > FEW:
                few.clear()
            else:
                few.append(ids)
        step(1)
        if few:
            self.fit(few, steps=min(STEPS, -(-AGAIN * sum(self.many(len(x)) for x in few) // BATCH)))
        return seen

    def many(self, n: int) -> int:
        """How many windows n ids have."""
        return 1 + max(0, -(-(n - WINDOW) // STEP))

    def windows(self, ids: np.ndarray, which: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Input rows, target classes and which are scored, of one stream (or some of its windows): all in the first window, then the last STEP."""
        n = len(ids)
        starts = STEP * (np.arange(self.many(n)) if which is None else which)
        at = starts[:, None] + np.arange(WINDOW)
        ok = (at < n) & ((starts == 0)[:, None] | (np.arange(WINDOW) >= WINDOW - STEP))
        to, before = np.minimum(at, n - 1), np.maximum(at - 1, 0)
        rows = np.where((at > 0) & (at < n), self.row[ids[np.minimum(before, n - 1)]], 0)
        return rows, np.where(at < n, self.cls[ids[to]], 0), ok

    def ready(self) -> Attention:
        """What scoring needs of each input row and place, multiplied out.

        A last column of ones beside the values gives the attention's divisor with its sums.
        """
        p, x = self.p, self.p["e"] + self.p["ec"][self.kin]
        wide = np.concatenate((p["q"] * DIM**-0.5, p["k"], p["v"]), axis=1)
        self.qkv = np.concatenate((x @ wide, np.zeros((len(x), 1), np.float32)), axis=1)
        self.qkv_pos = np.concatenate((p["pos"] @ wide, np.ones((WINDOW, 1), np.float32)), axis=1)
        self.out, self.out_pos = x @ p["c"] + p["g"][self.kin] + p["b"], p["pos"] @ p["c"]
        self.mix, self.seen = p["o"] @ p["c"], np.tri(WINDOW, dtype=np.float32)
        # Whether no sum of exponentials can overflow or vanish, so that scoring needs no shift: an attention's mean lies
        # between its values' extremes, and a product of two vectors is at most that of their lengths.
        parts = [self.out, self.out_pos, self.qkv[:, 2 * DIM : -1] @ self.mix, self.qkv_pos[:, 2 * DIM : -1] @ self.mix]
        live = np.bincount(self.cls, minlength=CLASSES) > 0
        high, low = sum(x[:, live].max() for x in parts), sum(x[:, live].min() for x in parts)
        far = lambda i: np.linalg.norm(self.qkv[:, i : i + DIM], axis=1).max() + np.linalg.norm(self.qkv_pos[:, i : i + DIM], axis=1).max()
        self.bounded = bool(high < 80 and low > -80 and far(0) * far(DIM) < 60)
        return self

    def log10s(self, streams: list[np.ndarray]) -> np.ndarray:
        """log10 probability of each stream of ids (each ends with the end)."""
        sizes = np.array([len(s) for s in streams])
        ids = np.concatenate(streams)
        base = np.cumsum(sizes) - sizes
        before = np.r_[0, self.row[ids[:-1]], np.zeros(WINDOW, int)]
        before[base] = 0
        after = np.r_[self.cls[ids], np.zeros(WINDOW, int)]
        many = 1 + np.maximum(0, -(-(sizes - WINDOW) // STEP))
        owner = np.repeat(np.arange(len(sizes)), many)
        k = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
        start, stop = base[owner] + k * STEP, (base + sizes)[owner]
        prev = self.places(ids, base)
        got = np.add.reduceat(self.within[prev, ids].astype(np.float64), base)
        each = np.zeros(len(owner))
        for i in range(0, len(owner), 256):
            at = start[i : i + 256, None] + np.arange(WINDOW)
            rows = before[np.minimum(at, len(ids))]
            x = np.take(self.qkv, rows, axis=0, mode="clip")
            x += self.qkv_pos
            a = x[:, :, :DIM] @ x[:, :, DIM : 2 * DIM].transpose(0, 2, 1)
            if not self.bounded:
                a -= np.where(self.seen > 0, a, -np.inf).max(axis=2, keepdims=True)
                np.minimum(a, 0, out=a)
            np.exp(a, out=a)
            a *= self.seen
            scored = (at < stop[i : i + 256, None]) & ((k[i : i + 256] == 0)[:, None] | (np.arange(WINDOW) >= WINDOW - STEP))
            w, t = np.nonzero(scored)
            y = (a @ x[:, :, 2 * DIM :])[w, t]
            z = (y[:, :DIM] / y[:, DIM:]) @ self.mix
            z += np.take(self.out, rows[w, t], axis=0, mode="clip")
            z += np.take(self.out_pos, t, axis=0, mode="clip")
            if not self.bounded:
                z -= z.max(axis=1, keepdims=True)
            picked = z[np.arange(len(z)), after[at[w, t]]]
            np.exp(z, out=z)
            total = z @ np.ones(CLASSES, np.float32)
            each[i : i + 256] = np.bincount(w, picked - np.log(total), minlength=len(at))
        return (got + np.bincount(owner, each, minlength=len(sizes))) / np.log(10)


def train(stored: DataFrame, tokenizer: str) -> Attention:
    """Learn from all rows of ``stored`` (doc_id, ids) that are taught."""
    enc = encoder(tokenizer)
    kind, end = enc.kind, enc.size
    taught = stored.where("taught")
    near = neighbours(taught.select("ids"), kind, end)
    counts = near[:, 0].astype(np.int64)
    model = Attention(counts, classes(counts, near[:, 1:]), np.array([*(enc.closes()), True]))
    names = sorted(model.p)
    size = sum(model.p[k].size for k in names)
    cells, pairs = (CLASSES + 1) * (end + 1), (CLASSES + 1) * CLASSES
    shared = stored.sparkSession.sparkContext.broadcast(model)

    def tally(batches):
        own, v, held = shared.value, None, []

        def add() -> None:
            at = np.concatenate([x for x, _ in held])
            v[:cells] += np.bincount(at, minlength=cells)
            v[cells:] += np.bincount(np.concatenate([x for _, x in held]), minlength=pairs)
            held.clear()

        for b in batches:
            flat, begin = _flat(b, kind, end)
            if v is None:
                v = np.zeros(cells + pairs, np.int64)
            cls = own.cls[flat]
            before = np.r_[CLASSES, cls[:-1]]
            before[begin] = CLASSES
            held.append((own.places(flat, begin) * (end + 1) + flat, before * CLASSES + cls))
            if sum(len(x) for x, _ in held) >= COUNTED:
                add()
        if held:
            add()
        return None if v is None else v.astype(np.float64)

    seen = summed(taught.select("ids"), tally, cells + pairs)
    model.begin(seen[cells:].reshape(CLASSES + 1, CLASSES))
    shared.unpersist()
    begun = stored.sparkSession.sparkContext.broadcast(model)

    def learn(batches):
        def streams():
            for b in batches:
                flat, begin = _flat(b, kind, end)
                yield from np.split(flat, begin[1:])

        own = copy.deepcopy(begun.value)
        windows = own.go_on(streams())
        return np.concatenate(([windows], windows * np.concatenate([own.p[k].ravel() for k in names]).astype(np.float64))) if windows else None

    got = summed(taught.select("ids"), learn, 1 + size)
    begun.unpersist()
    if got[0]:
        params, at = got[1:] / got[0], 0
        for k in names:
            model.p[k] = params[at : at + model.p[k].size].reshape(model.p[k].shape).astype(np.float32)
            at += model.p[k].size
    return model.count(seen[:cells].reshape(CLASSES + 1, end + 1)).ready()


_BASES: dict[str, tuple] = {}
_MODELS: dict[str, Attention] = {}
keeps("ids", _BASES)
keeps("passes", _MODELS)


def _head(counts: DataFrame) -> dict[bytes, int]:
    """The most frequent words with their counts: as many whole counts as HEAD holds, words of at most 64 bytes."""
    # Counts of counts: exact to 4096, then in steps of one per cent, so a few thousand rows.
    step = F.when(F.col("c") <= 4096, F.col("c")).otherwise(4096 + F.floor(F.log(F.col("c") / 4096.0) / 0.01).cast("long"))
    short = counts.where("length(w) <= 64").withColumn("step", step)
    room, least = HEAD, None
    for r in short.groupBy("step").agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect():
        if r.n > room:
            break
        room, least = room - r.n, r.step
    return {} if least is None else {bytes(r.w): r.c for r in short.where(F.col("step") >= least).select("w", "c").collect()}


class _Base(dict):
    """Word -> log10 of its share; what it lacks is noted and counts nothing yet."""

    def __init__(self, head: dict[bytes, int], total: int):
        super().__init__({w: float(np.log10((c + 1) / total)) for w, c in head.items()})
        self.lacks: list[bytes] = []

    def __missing__(self, word: bytes) -> float:
        self.lacks.append(word)
        return 0.0


def distinct_words(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words of some texts (binary), and for each word of each text in turn its text and its place among those."""
    # Bytes as they are: what isn't UTF-8 stays so.
    as_text = pa.Array.from_buffers(pa.string(), len(texts), texts.buffers(), offset=texts.offset)
    split = pc.ascii_split_whitespace(pc.ascii_lower(as_text))
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy())
    coded = split.flatten().cast(pa.binary()).dictionary_encode()
    words, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    # Blanks at either end leave empty words.
    some = np.array([bool(w) for w in words], bool)[at] if b"" in words else slice(None)
    return words, owner[some], at[some]


def ids_of_texts(enc, texts: list[bytes], words: list[bytes], owner: np.ndarray, at: np.ndarray, kept: WordIds) -> list[bytes]:
    """What the encoder's ``ids`` gives for each text, put together from its words where that is the same."""
    plain = np.fromiter(map(enc.by_words, texts), bool, len(texts))
    own = plain[owner]
    at, needed = at[own], np.zeros(len(words), bool)
    needed[at] = True
    parts = [kept[w] if x else b"" for w, x in zip(words, needed.tolist(), strict=True)]
    flat, many = np.frombuffer(b"".join(parts), enc.kind), np.fromiter(map(len, parts), np.int64, len(parts)) // enc.kind.itemsize
    first, n = (np.cumsum(many) - many)[at], many[at]
    raw = flat[np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum()))].tobytes()
    stop = (np.cumsum(np.bincount(owner[own], n, len(texts))).astype(np.int64) * enc.kind.itemsize).tolist()
    return [raw[i:j] if x else enc.ids(t.decode("utf-8", "replace")) for i, j, x, t in zip([0, *stop], stop, plain.tolist(), texts, strict=False)]


def score(docs: DataFrame, tokenizer: str, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every whole text.

    ``held_out`` is a condition on ``doc_id``; the rows for which it holds teach nothing.
    """
    spark = docs.sparkSession
    texts = id_and_text(docs, id_col, text_col)
    taught = texts.where(~held_out)
    counts = cut(word_counts(taught), "words")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    denominator = n + v + 1
    shared = spark.sparkContext.broadcast(_head(counts))
    tag = f"{spark.sparkContext.applicationId}-{shared._jbroadcast.id()}"

    def prepare(batches):
        enc, uid = encoder(tokenizer), TaskContext.get().partitionId() << 33
        if tag not in _BASES:
            _BASES.clear()
            base = _Base(shared.value, denominator)
            _BASES[tag] = base, WordIds(enc, base)
        base, kept = _BASES[tag]
        for b in small_batches(batches):
            texts, n = b.column("text").to_pylist(), b.num_rows
            words, owner, at = distinct_words(b.column("text"))
            base.lacks = []
            values, lacking = np.array([base[w] for w in words], float), set(base.lacks)
            lacks = np.array([w in lacking for w in words], bool)[at]
            base.lacks = []
            end = base[b""]
            lost, what = owner[lacks], at[lacks]
            if base.lacks:
                # Without a count at hand the end is one more word that each text lacks.
                order = np.argsort(lost := np.r_[lost, np.arange(n)], kind="stable")
                lost, what = lost[order], np.r_[what, np.full(n, len(words))][order]
            sizes, none = np.bincount(owner, minlength=n) + 1, np.bincount(lost, minlength=n)
            known, sums = sizes - none, np.bincount(owner, values[at], n) + end
            missing = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(none)], pa.int32()), pa.array([*words, b""], pa.binary()).take(pa.array(what)))
            ids = ids_of_texts(enc, texts, words, owner, at, kept)
            columns = [pa.array(np.arange(uid, uid + n)), b.column("doc_id"), b.column("taught"), pa.array(sizes, pa.int64()), pa.array(known, pa.int64()), pa.array(sums, pa.float64()), missing, pa.array(ids, pa.binary())]
            uid += n
            yield pa.RecordBatch.from_arrays(columns, ["uid", "doc_id", "taught", "n_tokens", "known", "sum", "missing", "ids"])

    stored = cut(texts.withColumn("taught", ~held_out).mapInArrow(prepare, "uid long, doc_id long, taught boolean, n_tokens long, known long, sum double, missing array<binary>, ids binary"), "ids")
    enc = encoder(tokenizer)
    kind, end = enc.kind, enc.size
    learnt = spark.sparkContext.broadcast(train(stored, tokenizer))
    name = f"{spark.sparkContext.applicationId}-{learnt._jbroadcast.id()}"

    def run(batches):
        if name not in _MODELS:
            _MODELS.clear()
            _MODELS[name] = learnt.value
        attention = _MODELS[name]
        for b in small_batches(batches, 1 << 20, 512):
            flat, begin = _flat(b.select(["ids"]), kind, end)
            columns = [b.column("uid"), b.column("doc_id"), b.column("n_tokens"), b.column("known"), b.column("sum"), pa.array(attention.log10s(np.split(flat, begin[1:])), pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["uid", "doc_id", "n_tokens", "known", "sum", "score"])

    scored = stored.select("uid", "doc_id", "n_tokens", "known", "sum", "ids").mapInArrow(run, "uid long, doc_id long, n_tokens long, known long, sum double, score double")
    rest = stored.select("uid", F.explode("missing").alias("w")).join(counts, "w", "left")
    added = rest.groupBy("uid").agg(F.sum(F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(float(denominator)))).alias("more"), F.sum((F.col("c") > 0).cast("long")).alias("more_known"))
    joined = scored.join(added, "uid", "left")
    return joined.select("doc_id", held_out.alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"), (F.col("sum") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score")


def held_out_fold(folds: int, fold: int, doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves ``fold``; a null id counts as an empty text."""
    return F.crc32(utf8(doc_id)) % folds == fold
