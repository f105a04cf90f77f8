import random

import numpy as np
import pytest

from strandflow.llm import decontam as D

rng = random.Random(5)
SYL = ["the", "tion", "er", "an", "re", "on", "at", "en", "is", "ti", "es", "or", "in", "ha"]


def prose(n):
    return " ".join("".join(rng.choices(SYL, k=rng.randint(1, 4))) for _ in range(n))


def edit(t, n):
    t = list(t)
    for _ in range(n):
        i = rng.randrange(len(t))
        t[i : i + 1] = rng.choice([[], ["q"], [t[i], "z"]])
    return "".join(t)


@pytest.fixture(scope="module")
def cases():
    items = [prose(40)[:230] for _ in range(12)]
    docs, want = [], {}
    for i in range(60):
        t = prose(300)
        if i % 3 == 0:
            it = items[i % 12]
            t = t[:500] + " " + (it if i % 2 else edit(it[:130], 2)).upper().replace(" ", "\n  ") + " " + t[500:]
            want[i] = i % 12
        docs.append((i, t))
    return items, docs, want


def test_finds_planted_and_leaves_clean(spark, cases):
    items, docs, want = cases
    bench = spark.createDataFrame([*enumerate(items), (90, None), (91, ""), (92, "short")], "item_id long, text string")
    df = spark.createDataFrame([(d, t, 1) for d, t in docs] + [(None, None, 1), (500, "", 1)], "doc_id long, text string, edits int").repartition(3)
    got = {r.doc_id: r.item_id for r in D.find_leaks(df, bench).collect()}
    assert got == want
    kept = D.drop_leaks(df, bench)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d in [None, 500, *(d for d, _ in docs if d not in want)])
    assert D.find_leaks(df.limit(0), bench).count() == 0 and D.find_leaks(df, bench.limit(0)).count() == 0 and D.drop_leaks(df, bench.limit(0)).count() == 62


def test_filters_lose_nothing_against_plain_alignment(cases):
    items, docs, _ = cases
    probes = D.Probes([(i, t.encode()) for i, t in enumerate(items)])

    def plain(p, x):
        row = np.zeros(len(x) + 1, int)
        for i, c in enumerate(p, 1):
            new = np.minimum(row[:-1] + (x != c), row[1:] + 1)
            new = np.concatenate(([i], new))
            row = np.minimum(new, np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new)))
        return int(row.min())

    texts = [edit(" ".join((t[:80], items[i % 12][20:200], t[80:200])), i) for i, (_, t) in enumerate(docs[:30])]
    for t in texts:
        x = D.normalise(t.encode())
        want = {item for k, p in enumerate(probes.text) if plain(p, x) <= D.edits(len(p)) for item, _ in probes.homes[k]}
        assert set(probes.matches(x)) == want
        assert bool(want) <= bool(probes.candidates([x]))


def test_pieces_blocks_and_hashes(spark, cases, monkeypatch):
    items, docs, want = cases
    monkeypatch.setattr(D, "PIECE", 700)
    probes = D.Probes([(i, t.encode()) for i, t in enumerate(items)])
    assert {d: next(iter(m)) for d, t in docs if (m := probes.matches(D.normalise(t.encode())))} == want
    x = D.normalise(b"abcdefghijklmnopabcdefghijklmnop")
    h = D.qgrams(x)
    assert len(h) == len(x) - D.Q + 1 and h[0] == h[16] and len(set(h.tolist())) == 16
    monkeypatch.undo()
    monkeypatch.setattr(D, "BLOCK", 600)
    bench = spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: r.item_id for r in D.find_leaks(df, bench).collect()} == want


@pytest.mark.parametrize("unit,hits", [("ha ", True), ("ha ho hi he ", True), ("ha hx ", False)])
def test_texts_that_repeat_themselves_stay_cheap(unit, hits):
    import time
    import tracemalloc

    probes = D.Probes([(i, (u * 100).encode()) for i, u in enumerate(["ha ", "ha ho hi he ", "hu hy "])])
    x = D.normalise((unit * (1_000_000 // len(unit))).encode())
    tracemalloc.start()
    begin = time.perf_counter()
    assert bool(probes.matches(x)) is hits
    assert time.perf_counter() - begin < 30 and tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()


def test_odd_texts_items_and_ids(spark, cases):
    items, docs, want = cases
    long = prose(60_000)
    rows = [(1, docs[0][1]), (1, docs[0][1]), (None, docs[0][1]), (7, long[:200_000] + " " + items[3] + " " + long[200_000:]), (8, long), (9, items[3])]
    bench = spark.createDataFrame([*enumerate(items), (0, items[0]), (50, items[0]), (None, items[1])], "item_id long, text string")
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = sorted((str(r.doc_id), r.item_id) for r in D.find_leaks(df, bench).collect())
    # Items of one text are found together; equal rows are found each.
    assert got == sorted([("1", 0), ("1", 50)] * 2 + [("None", 0), ("None", 50), ("7", 3), ("9", 3)])
    assert [r.doc_id for r in D.drop_leaks(df, bench).collect()] == [8]


def test_query_equals_plain_probes(spark):
    from strandflow.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    plain = D.Probes([(r.item_id, (r.text or "").encode()) for r in bench])
    # The plain way looks at texts of up to 1,200 characters, a good half of them; the query runs over all.
    plainly = {r.doc_id for r in docs if len(r.text or "") <= 1200}
    want = set()
    for r in docs:
        if r.doc_id not in plainly:
            continue
        x = D.normalise((r.text or "").encode())
        # Every probe at every place of the text, no filter.
        for k, p in enumerate(plain.text):
            low = np.arange(-D.BAND, max(1, len(x)), D.BAND)
            n, _ = plain.align(x, [k] * len(low), low)
            if n.min() <= D.edits(len(p)):
                want |= {(r.doc_id, item) for item, _ in plain.homes[k]}
    assert {(r.doc_id, r.item_id) for r in QUERIES["op2_decontamination"](spark, sf).collect() if r.doc_id in plainly} == want and want
