"""Operator 1, quality classifier: a weak-label model and a hashed linear scorer.

Overlapping heuristic labellers each vote good, bad or nothing on every text.  Documents with equal votes are counted
together, all documents of the table, and expectation-maximisation on those counts (at most three to the power of the labellers)
estimates each labeller's accuracy and the share of good documents; a document's posterior is its weak label.  A logistic
scorer over hashed words and hashed levels of the texts' measures is then fitted on the posteriors of a bounded sample of
``SAMPLE`` documents, the first in an order of hashed ids, of which those of at most ``LONGEST`` bytes teach, and scores every whole text.  No label is read.

Defined results: null and empty texts get the vote of a short text and its score; equal texts get equal scores; repeated
rows are scored each; a null id takes part but not in the sample; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.llm.common import id_and_text, keeps, per_batch, small_batches

#: Texts that the scorer is fitted on at most, and bytes of such a text; buckets of words and of measures; passes and rate.
SAMPLE, LONGEST, WORDS, LEVELS, EPOCHS, RATE = 3000, 1 << 15, 1 << 15, 1 << 8, 8, 0.5
KEEP = 0.5
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_SIGNS = b"#*%$&|<>{}[]\\^~=_@"
#: Measures of a text and the bounds of their levels.
BOUNDS = {
    "signs": (0.002, 0.01, 0.03, 0.06, 0.12, 0.25),
    "upper": (0.02, 0.06, 0.15, 0.3, 0.5, 0.8),
    "repeats": (0.01, 0.03, 0.08, 0.2, 0.4, 0.7),
    "pairs": (0.2, 0.35, 0.5, 0.7, 0.9),
    "top": (0.05, 0.1, 0.2, 0.3, 0.5, 0.8),
    "lines": (0.05, 0.15, 0.3, 0.5, 0.8),
    "marks": (0.02, 0.05, 0.1, 0.2, 0.5),
    "bars": (0.01, 0.03, 0.08, 0.15, 0.3),
    "length": (2.5, 3.5, 4.5, 6.0, 8.0, 12.0),
    "words": (1, 8, 16, 32, 64, 256, 1024),
    "stops": (0.02, 0.05, 0.1, 0.2, 0.3),
}


def measures(text: bytes) -> dict[str, float]:
    """Shares of signs, capitals, repeated words, distinct pairs, the most frequent word, repeated lines, loud marks and bars; lengths."""
    words = text.split()
    n, size = max(1, len(words)), max(1, len(text))
    letters = size - len(text.translate(None, _UPPER + _LOWER))
    lines = [x for x in text.split(b"\n") if x.strip()]
    counts = Counter(words)
    ordered = sorted(counts.values(), reverse=True)[:1]
    return {
        "signs": (len(text) - len(text.translate(None, _SIGNS))) / size,
        "upper": (len(text) - len(text.translate(None, _UPPER))) / max(1, letters),
        "repeats": sum(map(eq, words, words[1:])) / n,
        "pairs": len(set(zip(words, words[1:], strict=False))) / (n - 1) if n >= 10 else 1.0,
        "top": ordered[0] / n if ordered and n >= 10 else 0.0,
        "lines": 1 - len(set(lines)) / len(lines) if lines else 0.0,
        "marks": (text.count(b"!!") + text.count(b"??")) / n,
        "bars": counts[b"|"] / n,
        "length": len(b"".join(words)) / n,
        "words": float(len(words)),
        # Words of at most three bytes: what function words are, in the languages written with spaces.
        "stops": sum(c for w, c in counts.items() if len(w) <= 3) / n,
    }


#: Labellers: a measure, votes bad above or below, good within.
LABELLERS = {
    "few signs": lambda m: -1 if m["signs"] > 0.06 else 1 if m["signs"] < 0.01 else 0,
    "few capitals": lambda m: -1 if m["upper"] > 0.5 else 1 if m["upper"] < 0.15 else 0,
    "words go on": lambda m: -1 if m["repeats"] > 0.2 else 1 if m["repeats"] < 0.03 else 0,
    "words are joined anew": lambda m: -1 if m["pairs"] < 0.4 else 1 if m["pairs"] > 0.7 else 0,
    "no word rules": lambda m: -1 if m["top"] > 0.3 else 1 if 0 < m["top"] < 0.15 else 0,
    "lines differ": lambda m: -1 if m["lines"] > 0.3 else 0,
    "no shouting": lambda m: -1 if m["marks"] > 0.1 else 1 if m["marks"] < 0.02 else 0,
    "no tables": lambda m: -1 if m["bars"] > 0.1 else 1 if m["bars"] < 0.01 else 0,
    "usual words": lambda m: -1 if not 2.5 <= m["length"] <= 12 else 1 if 3.5 <= m["length"] <= 8 else 0,
    "long enough": lambda m: -1 if m["words"] < 2 else 1 if m["words"] >= 16 else 0,
    "short words too": lambda m: -1 if m["stops"] < 0.05 and m["words"] >= 20 else 1 if m["stops"] > 0.15 else 0,
}


def votes(text: bytes) -> str:
    """One letter for each labeller: g, b or a dash."""
    m = measures(text)
    return "".join("-gb"[f(m)] for f in LABELLERS.values())


def vote_counts(texts: DataFrame) -> dict[str, int]:
    """How many documents have each combination of votes; counted in the tasks first."""

    def count(batches):
        seen: Counter = Counter()
        for b in small_batches(batches):
            seen.update(map(votes, b.column("text").to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["v", "c"])

    return {r.v: r.c for r in texts.select("text").mapInArrow(count, "v string, c long").groupBy("v").agg(F.sum("c").alias("c")).collect()}


class WeakLabels:
    """Labellers that err independently given the class; their vote probabilities and the classes' shares by EM."""

    def __init__(self, counts: dict[str, int], turns: int = 60):
        self.patterns = sorted(counts)
        x = np.array([["-gb".index(c) for c in p] for p in self.patterns], int).reshape(len(self.patterns), len(LABELLERS))
        c = np.array([counts[p] for p in self.patterns], float)
        hot = np.eye(3)[x] if len(x) else np.zeros((0, len(LABELLERS), 3))
        # Begin with the vote: one strong objection weighs as much as two approvals.
        lean = (x == 1).sum(axis=1) - 3.0 * (x == 2).sum(axis=1)
        good = 1 / (1 + np.exp(-lean / 2)) if len(x) else np.zeros(0)
        self.prior, self.table = 0.5, np.full((2, len(LABELLERS), 3), 1 / 3)
        for _ in range(turns if len(x) else 0):
            share = np.stack((1 - good, good)) * c
            self.prior = float((share[1].sum() + 1) / (c.sum() + 2))
            self.table = (np.einsum("kp,plv->klv", share, hot) + 0.5) / (share.sum(axis=1) + 1.5)[:, None, None]
            log = np.einsum("plv,klv->kp", hot, np.log(self.table)) + np.log([[1 - self.prior], [self.prior]])
            good = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
        self.good = dict(zip(self.patterns, good.tolist(), strict=True))

    def posterior(self, pattern: str) -> float:
        if pattern in self.good:
            return self.good[pattern]
        x = ["-gb".index(c) for c in pattern]
        log = [np.log(self.table[k, range(len(x)), x]).sum() + np.log((1 - self.prior, self.prior)[k]) for k in (0, 1)]
        return float(1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50))))

    def accuracies(self) -> dict[str, float]:
        """How often each labeller is right where it votes."""
        right = self.prior * self.table[1, :, 1] + (1 - self.prior) * self.table[0, :, 2]
        cast = right + self.prior * self.table[1, :, 2] + (1 - self.prior) * self.table[0, :, 1]
        return dict(zip(LABELLERS, (right / cast).tolist(), strict=True))


class _Buckets(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 17:
            self.clear()
        self[word] = k = zlib.crc32(word.lower()) % WORDS
        return k


_BUCKETS = _Buckets()
keeps("quality", _BUCKETS)


def levels(text: bytes) -> np.ndarray:
    """Hashed levels of the measures."""
    m = measures(text)
    return np.array([zlib.crc32(f"{k}:{np.searchsorted(b, m[k], 'right')}".encode()) % LEVELS for k, b in BOUNDS.items()])


class Scorer:
    """Logistic regression on the mean of the words' weights and the sum of the levels' weights."""

    def __init__(self):
        self.words, self.levels, self.bias = np.zeros(WORDS), np.zeros(LEVELS), 0.0

    def fit(self, texts: list[bytes], target: np.ndarray, seed: int = 2) -> Scorer:
        g = np.random.default_rng(seed)
        rows = []
        for t in texts:
            k = np.fromiter(map(_BUCKETS.__getitem__, t.split()), np.int64)
            at, c = np.unique(k, return_counts=True)
            rows.append((at, c / max(1, len(k)), levels(t)))
        rate = RATE
        for _ in range(EPOCHS):
            for i in g.permutation(len(rows)):
                at, x, lv = rows[i]
                err = target[i] - 1 / (1 + np.exp(-np.clip(self.words[at] @ x + self.levels[lv].sum() + self.bias, -30, 30)))
                self.words[at] += rate * err * x
                np.add.at(self.levels, lv, 0.2 * rate * err)
                self.bias += 0.2 * rate * err
            rate *= 0.7
        return self

    def score(self, text: bytes) -> float:
        words = text.split()
        k = np.fromiter(map(_BUCKETS.__getitem__, words), np.int64, len(words))
        z = (self.words[k].mean() if len(k) else 0.0) + self.levels[levels(text)].sum() + self.bias
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[WeakLabels, Scorer]:
    """Weak labels from all documents; the scorer from a bounded sample of them."""
    texts = id_and_text(docs, id_col, text_col)
    weak = WeakLabels(vote_counts(texts))
    ids = [r.doc_id for r in texts.where("doc_id is not null").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).collect()]
    if not ids:
        return weak, Scorer()
    # At most SAMPLE ids: a bounded broadcast.  A repeated id teaches once.
    chosen = docs.sparkSession.createDataFrame([(i,) for i in dict.fromkeys(ids)], "doc_id long")
    rows = texts.where(F.length("text") <= LONGEST).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")).collect()
    sample = [bytes(r.text) for r in sorted(rows, key=lambda r: r.doc_id)]
    return weak, Scorer().fit(sample, np.array([weak.posterior(votes(t)) for t in sample]))


def score(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (higher: better) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([shared.value.score(t) for t in b.column("text").to_pylist()], pa.float64())], ["doc_id", "score"])

    return id_and_text(docs, id_col, text_col).mapInArrow(per_batch(run), "doc_id long, score double")
