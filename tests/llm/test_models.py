import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandflow.llm import lm, quality, toxicity
from strandflow.llm.tokens import WordIds, encoder

WORD = P.path("word_bpe_49k.json")
#: What the score must be better than, as a share of the log probability that counts of pairs give.
BIGRAM = 0.97
DOCS, LABELS = "/root/testdata/sf0.01/documents.parquet", "/root/testdata/sf0.01/labels.parquet"


def remainder(doc, n):
    return zlib.crc32(b"" if doc is None else str(doc).encode()) % n


# toxicity


def test_toxicity_gradients():
    net, g = toxicity.Network(3), np.random.default_rng(0)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, lengths = g.standard_normal((5, 6, toxicity.DIM)), np.array([6, 3, 1, 0, 5])
    y, w = np.array([1.0, 0, 1, 0, 1]), np.array([1.0, 2, 1, 1, 1])
    grads, dx, _ = net.learn(x, lengths, y, w)
    for name in ("uhf", "wxb", "wa", "va", "wo", "bxf", "ba", "bo"):
        p = net.p[name]
        at = tuple(g.integers(0, s) for s in p.shape)
        old, eps = p[at], 1e-4
        p[at] = old + eps
        up = net.learn(x, lengths, y, w)[2]
        p[at] = old - eps
        down = net.learn(x, lengths, y, w)[2]
        p[at] = old
        assert abs((up - down) / (2 * eps) - grads[name][at]) < 1e-4
    x[1, 2, 4] += 1e-4
    up = net.learn(x, lengths, y, w)[2]
    x[1, 2, 4] -= 2e-4
    assert abs((up - net.learn(x, lengths, y, w)[2]) / 2e-4 - dx[1, 2, 4]) < 1e-4


def test_toxicity_scores_are_the_texts_alone():
    import pandas as pd

    texts = [t.encode() for t in pd.read_parquet("/root/testdata/sf0.001/documents.parquet").text] + [b"", b"a", b"same", b"same"]
    g = np.random.default_rng(5)
    net = toxicity.fit(texts, (g.random(len(texts)) < 0.2).astype(int).tolist(), (4, 1))
    want = toxicity.Scorer(net).scores(texts)
    assert len(set(want.tolist())) > 50
    for k in (3, 20, 200):
        order, got, scorer = g.permutation(len(texts)), np.zeros(len(texts)), toxicity.Scorer(net)
        for part in np.array_split(order, k):
            got[part] = scorer.scores([texts[i] for i in part])
        assert (got == want).all()
    # A plain version: one window, one unit at a time, in double precision.
    p = {k: v.astype(float) for k, v in net.p.items()}
    sig = lambda x: 1 / (1 + np.exp(-x))

    def logit(words):
        if not words:
            return p["bo"][0]
        x = net.inputs(words).astype(float)
        states = []
        for s, seq in (("f", x), ("b", x[::-1])):
            h, out = np.zeros(toxicity.HIDDEN), []
            for v in seq:
                gz, gr, gn = np.split(v @ p[f"wx{s}"] + p[f"bx{s}"], 3)
                hz, hr, hn = np.split(h @ p[f"uh{s}"], 3)
                z, r = sig(gz + hz), sig(gr + hr)
                new = np.tanh(gn + r * hn)
                h = new + z * (h - new)
                out.append(h)
            states.append(out if s == "f" else out[::-1])
        both = np.concatenate(states, axis=1)
        a = np.exp(np.tanh(both @ p["wa"] + p["ba"]) @ p["va"])
        return (a / a.sum()) @ both @ p["wo"] + p["bo"][0]

    for i in [*range(0, len(texts), 9), -4, -3, -2, -1]:
        words = texts[i].lower().split()
        top = max(logit(words[a:b]) for a, b in toxicity.windows(len(words)))
        assert abs(sig(net.scale * top + net.shift) - want[i]) < 5e-3


def test_toxicity_windows_cover_all_words():
    for n in (0, 1, 31, 32, 33, 56, 57, 1000):
        w = toxicity.windows(n)
        assert {i for a, b in w for i in range(a, b)} == set(range(n)) and all(b - a <= toxicity.WINDOW for a, b in w)


def test_toxicity_on_held_out_documents(spark):
    docs, labels = spark.read.parquet(DOCS), spark.read.parquet(LABELS)
    model = toxicity.train(docs, labels, only=lambda _: ~lm.held_out_fold(4, 2))
    rows = toxicity.score(docs, model).join(labels.where("toxic is not null"), "doc_id").collect()
    held = [r for r in rows if remainder(r.doc_id, 4) == 2]
    good = [(r.score >= 0.3) == bool(r.toxic) for r in held]
    assert len(held) > 50 and np.mean(good) > 0.9
    clean = toxicity.drop_toxic(docs, model, 0.3)
    assert clean.columns == docs.columns and 0.75 * docs.count() < clean.count() < docs.count()


def test_toxicity_odd_inputs(spark, odd_docs):
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(odd_docs, toxicity.train(odd_docs, empty)).collect()} == {0.0}
    labels = spark.createDataFrame([(1, 0), (3, 1), (7, 0), (8, 0), (None, 1), (2, None), (99, 1)], "doc_id long, toxic int")
    model = toxicity.train(odd_docs, labels)
    rows = toxicity.score(odd_docs, model).collect()
    by = {}
    for r, in zip(rows, strict=True):
        by.setdefault(r.doc_id, set()).add(r.score)
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert by[7] == by[8] and len(by[3]) == 1 and by[None] == by[1] == by[2]
    assert toxicity.score(odd_docs.limit(0), model).count() == 0 and toxicity.drop_toxic(odd_docs, model, 2.0).count() == odd_docs.count()


# language model


def test_lm_gradients():
    counts = np.arange(1, 201)
    cls = np.arange(200) % lm.CLASSES
    m, g = lm.Attention(counts, cls, np.zeros(200, bool)), np.random.default_rng(0)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    rows, target, weight = g.integers(0, 200, (3, lm.WINDOW)), g.integers(0, lm.CLASSES, (3, lm.WINDOW)), g.integers(0, 2, (3, lm.WINDOW)).astype(float)
    _, grads = m.loss(rows, target, weight)
    for name in ("q", "k", "v", "o", "c", "b", "pos"):
        p = m.p[name]
        at = tuple(g.integers(0, s) for s in p.shape)
        old = p[at]
        p[at] = old + 1e-5
        up = m.loss(rows, target, weight)[0]
        p[at] = old - 1e-5
        down = m.loss(rows, target, weight)[0]
        p[at] = old
        assert abs((up - down) / 2e-5 - grads[name][at]) < 1e-6


def small_model():
    g = np.random.default_rng(1)
    streams = [np.r_[g.integers(0, 40, 60), 50] for _ in range(30)]
    counts = np.bincount(np.concatenate(streams), minlength=51)
    near = np.zeros((51, 2 * lm.SIDES))
    for s in streams:
        np.add.at(near, (s[1:], lm.bucket(s[:-1])), 1)
        np.add.at(near, (s[:-1], lm.SIDES + lm.bucket(s[1:])), 1)
    m = lm.Attention(counts, lm.classes(counts, near), np.arange(51) % 3 == 0)
    seen = np.zeros((lm.CLASSES + 1, 51))
    for s in streams:
        np.add.at(seen, (m.places(s, np.array([0])), s), 1)
    lm_steps, lm.STEPS = lm.STEPS, 60
    try:
        return m.fit(streams).count(seen).ready(), streams
    finally:
        lm.STEPS = lm_steps


def test_lm_passes_equal_plain_counts(spark, odd_docs, monkeypatch):
    enc = encoder(WORD)
    kind, end = enc.kind, enc.size
    texts = [(r.doc_id, (r.text or "").encode()) for r in odd_docs.collect()]
    streams = [np.r_[np.frombuffer(enc.ids(t.decode()), kind).astype(np.int64), end] for _, t in texts]
    stored = spark.createDataFrame([(d, True, enc.ids(t.decode())) for d, t in texts], "doc_id long, taught boolean, ids binary").repartition(3)
    near = lm.neighbours(stored, kind, end)
    want = np.zeros_like(near)
    for s in streams:
        np.add.at(want[:, 0], s, 1)
        np.add.at(want[:, 1:], (s[1:], lm.bucket(s[:-1])), 1)
        np.add.at(want[:, 1:], (s[:-1], lm.SIDES + lm.bucket(s[1:])), 1)
    assert (near == want).all()
    monkeypatch.setattr(lm, "STEPS", 5)
    m = lm.train(stored, WORD)
    assert (m.alone == (want[:, 0] + 0.5) / np.bincount(m.cls, weights=want[:, 0] + 0.5, minlength=lm.CLASSES)[m.cls]).all()
    seen = np.zeros((lm.CLASSES + 1, end + 1))
    for s in streams:
        np.add.at(seen, (m.places(s, np.array([0])), s), 1)
    within, m.within = m.within, None
    assert np.allclose(within, m.count(seen).within)


def test_lm_ids_by_words_are_those_of_the_text(odd_docs):
    enc = encoder(WORD)
    odd = ["J\u030c j\u030c H\u0331 \u01f0 I\u0307 \u0130", "A\x85B\xa0C\u2003D\x0bE\x0cF\x1cG", "\u0301a \u0301", "DON'T don't 'S 12\xb2\xbd X1y", "\xc0\xc9\xdf \xffa", "\u03a3\u0391\u03a3 \u03c3", "a\ufffdb", "", "W\u030a\tW\u030a"]
    texts = [x.encode() for x in [*odd, *((r.text or "") for r in odd_docs.collect())]]
    want = [np.asarray(enc.whole(t.decode()), enc.kind).tobytes() for t in texts]
    for frequent in ([], [b"a", b"same", b"don't"]):
        kept = WordIds(enc, frequent)
        for part in (slice(None), slice(1, None), slice(4, 5)):
            words, owner, at = lm.distinct_words(pa.array(texts, pa.binary())[part])
            split = [t.lower().split() for t in texts[part]]
            assert [words[i] for i in at] == [w for x in split for w in x] and (np.bincount(owner, minlength=len(split)) == [len(x) for x in split]).all()
            assert lm.ids_of_texts(enc, texts[part], words, owner, at, kept) == want[part]
        assert set(kept) <= set(frequent)
    # What is not UTF-8 is decoded word by word as it is in whole.
    broken = [b"a\xe2 b\xe2\x28c \xc3"]
    assert lm.ids_of_texts(enc, broken, *lm.distinct_words(pa.array(broken)), WordIds(enc, [])) == [enc.ids(broken[0].decode("utf-8", "replace"))]


def test_lm_draws_no_sample_to_begin_with(spark, monkeypatch):
    """Every taught row counts in what training begins with, whatever its id and size, and the start is P(class | class before)."""
    enc = encoder(WORD)
    kind, end = enc.kind, enc.size
    texts = [(None if i % 3 == 0 else i, f"w{i} some words that are there " * (1 + 4000 * (i == 5))) for i in range(40)]
    stored = spark.createDataFrame([(d, True, enc.ids(t)) for d, t in texts], "doc_id long, taught boolean, ids binary").repartition(3)
    starts, begin = [], lm.Attention.begin
    monkeypatch.setattr(lm.Attention, "begin", lambda self, pairs: starts.append(pairs.copy()) or begin(self, pairs))
    m = lm.train(stored, WORD)
    want = np.zeros((lm.CLASSES + 1, lm.CLASSES))
    for _, t in texts:
        c = m.cls[np.r_[np.frombuffer(enc.ids(t), kind).astype(np.int64), end]]
        np.add.at(want, (np.r_[lm.CLASSES, c[:-1]], c), 1)
    assert len(starts) == 1 and (starts[0] == want).all()
    n = lm.CLASSES
    first = begin(lm.Attention(np.ones(n), np.arange(n), np.zeros(n, bool)), want)
    p = np.exp(first.p["g"] + first.p["b"])
    seen = want.sum(axis=1) > 3000
    assert seen.any() and np.allclose(p[seen], want[seen] / want[seen].sum(axis=1, keepdims=True), atol=0.01)


def test_lm_every_text_teaches_and_more_texts_teach_more():
    m, streams = small_model()
    long = np.r_[np.arange(5000) % 40, 50]
    assert m.many(len(long)) == len(m.windows(long)[0])
    for some in ([long], streams, [*streams, long], [np.array([50])] * 7):
        before = {k: x.copy() for k, x in m.p.items()}
        seen = m.go_on(iter(some))
        assert seen == sum(len(range(int(zlib.crc32(s.tobytes()) % min(lm.SHARE, m.many(len(s)))), m.many(len(s)), lm.SHARE)) for s in some) >= len(some)
        assert any((before[k] != m.p[k]).any() for k in before)


def test_lm_is_a_distribution_causal_and_scores_each_id_once():
    m, streams = small_model()
    for prefix in ([], [3], [3, 9, 12], list(streams[0][:40])):
        total = sum(10 ** (m.log10s([np.array([*prefix, i])])[0] - (m.log10s([np.array(prefix)])[0] if prefix else 0)) for i in range(51))
        assert abs(total - 1) < 1e-3
    # Plain way: each id's loss in the window that scores it.
    for n in (lm.WINDOW, lm.WINDOW + 1, lm.WINDOW + lm.STEP, lm.WINDOW + lm.STEP + 1):
        streams = [*streams, np.arange(n) % 40]
    for s in (streams[0], streams[1][:5], np.array([50]), *streams[-4:]):
        rows, target, ok = m.windows(s)
        assert ok.sum() == len(s)
        prev = np.r_[lm.CLASSES, m.before[s[:-1]]]
        plain = m.loss(rows, target, ok.astype(float))[0] * -ok.sum() + m.within[prev, s].sum()
        assert abs(plain / np.log(10) - m.log10s([s])[0]) < 1e-2
    assert np.allclose(m.log10s(streams), [m.log10s([s])[0] for s in streams], atol=1e-3)


def test_lm_later_windows_give_each_id_eight_before_it():
    m, streams = small_model()
    assert lm.WINDOW - lm.STEP >= 8
    for n in (33, 56, 57, 121):
        _, _, ok = m.windows(np.arange(n) % 40)
        assert ok.sum() == n and not ok[1:, :8].any()


def test_lm_base_scores_equal_plain_counts(spark, odd_docs):
    rows = [(r.doc_id, (r.text or "").encode().lower().split()) for r in odd_docs.collect()]
    counts = Counter()
    for d, w in rows:
        if remainder(d, 7) != 2:
            counts.update([*w, None])
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(d), remainder(d, 7) == 2, len(w) + 1, sum(counts[x] > 0 for x in [*w, None]), n, round(sum(np.log10((counts[x] + 1) / (n + v + 1)) for x in [*w, None]), 6)) for d, w in rows)
    for head in (1 << 18, 3, 0):
        old, lm.HEAD = lm.HEAD, head
        steps, lm.STEPS = lm.STEPS, 20
        try:
            got = lm.score(odd_docs, WORD, lm.held_out_fold(7, 2)).collect()
        finally:
            lm.HEAD, lm.STEPS = old, steps
        assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
        assert all(np.isfinite(r.score) and r.score < 0 for r in got)
    assert lm.score(odd_docs.limit(0), WORD, lm.held_out_fold(7, 2)).count() == 0
    none = lm.score(odd_docs, WORD, F.lit(True)).collect()
    assert len(none) == len(rows) and all(r.train_tokens == 0 and r.base_score == 0 and r.n_known == 0 for r in none)


def test_lm_beats_counts_on_held_out(spark):
    docs = spark.read.parquet(DOCS)
    rows = lm.score(docs, WORD, lm.held_out_fold(7, 2)).where("held_out").collect()
    enc, counts, pairs, firsts = encoder(WORD), Counter(), Counter(), Counter()
    streams = {r.doc_id: [*np.frombuffer(enc.ids(r.text or ""), enc.kind).tolist(), enc.size] for r in docs.collect()}
    for d, s in streams.items():
        if remainder(d, 7) != 2:
            counts.update(s)
            pairs.update(zip([-1, *s], s, strict=False))
            firsts.update([-1, *s[:-1]])
    n, v = sum(counts.values()), enc.size + 1
    one = lambda i: (counts[i] + 0.5) / (n + 0.5 * v)
    held = [streams[r.doc_id] for r in rows]
    plain = sum(np.log10(one(i)) for s in held for i in s)
    # The best weight of the single counts, chosen on the held-out texts themselves.
    bigram = max(sum(np.log10((pairs[p, i] + w * one(i)) / (firsts[p] + w)) for s in held for p, i in zip([-1, *s], s, strict=False)) for w in (30, 300, 3000))
    got = sum(r.score for r in rows)
    print("per id:", [x / sum(map(len, held)) for x in (got, bigram, plain)])
    assert len(rows) > 100 and got > 0.75 * plain and got > BIGRAM * bigram


# quality


def test_em_finds_accuracies():
    g, counts = np.random.default_rng(0), Counter()
    for _ in range(20_000):
        good = g.random() < 0.8
        counts["".join("g" if (g.random() < 0.9) == good else "b" for _ in quality.LABELLERS)] += 1
    weak = quality.WeakLabels(counts)
    assert abs(weak.prior - 0.8) < 0.03 and all(abs(a - 0.9) < 0.03 for a in weak.accuracies().values())
    assert weak.posterior("g" * len(quality.LABELLERS)) > 0.99 > 0.01 > weak.posterior("b" * len(quality.LABELLERS))


def test_quality_against_labels_it_never_reads(spark):
    docs, labels = spark.read.parquet(DOCS), spark.read.parquet(LABELS)
    weak, scorer = quality.train(docs)
    rows = quality.score(docs, scorer).join(labels.where("quality is not null"), "doc_id").collect()
    good = [r for r in rows if r.quality]
    assert np.mean([(r.score >= 0.5) == bool(r.quality) for r in rows]) > 0.95 and np.mean([r.score >= 0.5 for r in good]) > 0.98
    assert sum(quality.vote_counts(docs.selectExpr("cast(text as binary) as text")).values()) == docs.count()


def test_quality_odd_inputs(spark, odd_docs):
    _, scorer = quality.train(odd_docs)
    rows = quality.score(odd_docs, scorer).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add(r.score)
    assert by[7] == by[8] and len(by[3]) == 1 and by[None] == by[1]
    _, none = quality.train(odd_docs.limit(0))
    assert quality.score(odd_docs.limit(0), none).count() == 0


@pytest.mark.parametrize("name", ["op1_quality", "op6_lm_scores", "op9_toxicity"])
def test_queries_have_a_row_for_each_document(spark, name):
    from strandflow.llm.queries import QUERIES

    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
