import random

import numpy as np
import pytest

from strandflow.llm import neardup as N


def plain_set(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(rows, k):
    """doc -> (size, component) from all pairs."""
    sets = [plain_set(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return [(d, len(sets[i]) if sets[i] != {()} else 0, low.get(find(i), d)) for i, (d, _) in enumerate(rows)]


def corpus(seed, groups=12, copies=8, lone=60):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 5))) for _ in range(400)]
    rows, d = [], 0
    for g in range(groups):
        base = rng.choices(words, k=rng.choice([3, 5, 6, 12, 60, 200]))
        for c in range(copies if g else 400):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(t) // 14))):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((d, rng.choice([" ", "\n", " \t"]).join(t)))
            d += 1
    rows += [(d + i, " ".join(rng.choices(words, k=rng.randint(1, 80)))) for i in range(lone)]
    d += lone
    rows += [(d, None), (d + 1, ""), (d + 2, "\t\n"), (d + 3, "A b"), (d + 4, "a B"), (d + 5, "a"), (3, rows[3][1]), (None, rows[5][1]), (None, "only here once"), (None, "only here once")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("k,seed", [(2, 1), (5, 2)])
def test_equals_brute_force(spark, k, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, "x", 1, True, 0) for r in rows], "doc_id long, text string, key string, label int, kept boolean, n_rows int").repartition(5)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in N.near_duplicates(df, k).collect())
    want = sorted((str(d), n, str(c), d is not None and d == c) for d, n, c in brute(rows, k))
    assert got == want
    kept = N.drop_near_copies(df, k)
    assert kept.columns == df.columns
    comp = {(d, t): c for (d, t), (_, _, c) in zip(rows, brute(rows, k), strict=True)}
    seen = [(r.doc_id, r.text) for r in kept.collect()]
    full = [x for x in seen if (x[1] or "").split()]
    assert len({comp[x] if comp[x] is not None else x[1] for x in full}) == len(full)
    assert {str(comp[x]) for x in full} == {str(comp[x]) for x in comp if (x[1] or "").split()}
    assert sum(not (t or "").split() for _, t in seen) == 3
    assert all(d == comp[d, t] for d, t in full)


def test_edges_of_the_threshold_and_empty(spark):
    rows = [(1, "a b c d e"), (2, "a b c d e f"), (3, "p q r s"), (4, "p q r s t")]  # 4 of 5 shingles; 3 of 4
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in N.near_duplicates(df, 2).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    assert N.near_duplicates(df.limit(0)).count() == 0 and N.drop_near_copies(df.limit(0)).count() == 0


def test_signature_estimates_similarity():
    a, b = np.arange(1000, dtype=np.uint64), np.arange(100, 1100, dtype=np.uint64)
    with np.errstate(over="ignore"):
        mix = lambda x: (x * N._MIX) ^ ((x * N._MIX) >> np.uint64(31))
        same = (N.signature(mix(a)) == N.signature(mix(b))).mean()
    assert abs(same - 900 / 1100) < 0.15


def test_large_regions_stay_linear():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 16, N.VALUES)
    ords, keys, nibs = [], [], []
    for i in range(3000):
        x = np.where(rng.random(N.VALUES) < 0.12, rng.integers(0, 16, N.VALUES), base)
        ords.append(b"\0" * 17 + i.to_bytes(8, "big"))
        keys.append(i.to_bytes(16, "big"))
        nibs.append(((x[::2]) | (x[1::2] << 4)).astype(np.uint8).tobytes())
    r = N._Region(ords, keys, [500] * 3000, nibs, [None] * 3000)
    r.go(np.arange(3000), N.SHALLOW)
    assert len(r.out) < 12 * 3000 and len({k for p in r.out for k in p}) == 3000
    half = N._Region(ords, keys, [500] * 3000, nibs, [b"x"] * 1500 + [None] * 1500)
    half.go(np.arange(3000), N.SHALLOW)
    assert half.out and not any(max(p) < keys[1500] for p in half.out)
    one = N._Region(ords, keys, [500] * 3000, nibs, [b"x"] * 3000)
    one.go(np.arange(3000), N.SHALLOW)
    assert not one.out


def region(m, seed, noise, labels=None, n=500):
    """Rows around one centre; their salts part them only after the values of the order."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 16, N.VALUES)
    nibs = []
    for _ in range(m):
        x = np.where(rng.random(N.VALUES) < noise, rng.integers(0, 16, N.VALUES), base)
        nibs.append((x[::2] | (x[1::2] << 4)).astype(np.uint8).tobytes())
    keys = [i.to_bytes(16, "big") for i in range(m)]
    return N._Region([b"\0" * 17 + k for k in keys], keys, [n] * m, nibs, labels or [None] * m)


def open_pairs(r):
    """Pairs between two components that agree well enough, one by one."""
    return {(i, j) for j in range(len(r.keys)) for i in range(j) if (r.labels[i] is None or r.labels[i] != r.labels[j]) and (r.nib[i] == r.nib[j]).sum() >= N.AGREE}


@pytest.mark.parametrize("m,labels", [(24, [b"x"] * 12 + [b"y"] * 12), (300, None), (300, [b"x"] * 200 + [b"y"] * 60 + [None] * 40), (140, [b"x"] * 140)])
def test_every_open_pair_is_offered_or_holds_its_rows_back(m, labels):
    r = region(m, 4, 0.2, labels)
    want = open_pairs(r)
    r.whole(np.arange(m))
    offered = {(int.from_bytes(a, "big"), int.from_bytes(b, "big")) for a, b in r.out}
    assert offered <= want
    assert all((i, j) in offered or {i, j} <= r.back for i, j in want)
    assert set(r.doubtful(np.arange(m)).tolist()) == {i for p in want for i in p}


def test_links_among_equal_brute_force():
    g = np.random.default_rng(0)
    base = g.integers(0, 1 << 62, 150).astype(np.uint64)
    sets = []
    for _ in range(200):
        x, m = base.copy(), g.integers(0, 30)
        x[g.choice(len(x), m, replace=False)] = g.integers(0, 1 << 62, m).astype(np.uint64)
        sets.append(np.unique(x))
    sets += [np.unique(g.integers(0, 50, 8).astype(np.uint64)) for _ in range(100)]
    labels = [i if g.random() < 0.5 else -1 for i in range(len(sets))]

    def joined(links):
        lead = {x: x for x in labels}
        for i, j in links:
            old, new = lead[labels[j]], lead[labels[i]]
            lead = {k: new if v == old else v for k, v in lead.items()}
        return {frozenset(k for k in lead if lead[k] == v) for v in lead.values()}

    both = {(i, j): len(np.intersect1d(sets[i], sets[j])) for j in range(len(sets)) for i in range(j)}
    links = {p for p, x in both.items() if 100 * x >= 80 * (len(sets[p[0]]) + len(sets[p[1]]) - x)}
    got = N.links_among(sets, labels)
    assert {tuple(sorted(p)) for p in got} <= links and joined(got) == joined(links)


def test_a_dense_group_beyond_one_region_equals_brute_force(spark):
    # 5,000 texts of 200 words around one text, most pairs near the threshold: more than a task compares at once.
    rng, m = np.random.default_rng(8), 5000
    assert m > N.HELD
    base, rows, other = rng.integers(0, 1 << 30, 200), [], 1 << 31
    for i in range(m):
        x = base.copy()
        at = rng.choice(200, rng.integers(6, 16), replace=False)
        x[at] = other + np.arange(len(at)) + 16 * i
        rows.append(x)
    df = spark.createDataFrame([(i, " ".join(map(str, x))) for i, x in enumerate(rows)], "doc_id long, text string").repartition(6)
    got = {r.doc_id: r.component_id for r in N.near_duplicates(df, 2).collect()}
    # Only pairs of the base's words are shared, each at its place.
    own = np.array([(x[:-1] == base[:-1]) & (x[1:] == base[1:]) for x in rows]).astype(np.float32)
    both = own @ own.T
    near = (100 * both >= 80 * (2 * 199 - both)) | np.eye(m, dtype=bool)
    want = np.arange(m)
    while True:
        new = np.array([want[near[i]].min() for i in range(m)])
        if (new == want).all():
            break
        want = new
    assert 50 < len(set(want.tolist())) < m - 1000
    assert [got[i] for i in range(m)] == want.tolist()


def test_the_driver_builds_no_tables_for_joins(spark, monkeypatch):
    """Nothing that near-dedup writes has a broadcast join, its map of ids takes a bit an id, and the setting comes back."""
    name, plans, maps, sent = "spark.sql.autoBroadcastJoinThreshold", [], [], type(spark.sparkContext).broadcast
    before, cut = spark.conf.get(name), N.cut

    def seen(df, what):
        plans.append((what, df._jdf.queryExecution().executedPlan().toString()))
        return cut(df, what)

    monkeypatch.setattr(N, "cut", seen)
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, x: maps.append(x) or sent(self, x))
    rows = corpus(5, groups=3, lone=20)
    N.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"), 5).count()
    assert len(plans) > 10 and not [what for what, plan in plans if "Broadcast" in plan]
    assert maps and all(x.nbytes == N.BITMAP // 8 for x in maps)
    assert spark.conf.get(name) == before


def test_repeated_rows_leave_the_smallest_text(spark):
    df = spark.createDataFrame([(1, "b  c d", "y"), (1, "b c d", "z"), (1, "B c d", "x"), (2, "b c d", "w")], "doc_id long, text string, key string").repartition(3)
    assert [tuple(r) for r in N.drop_near_copies(df, 2).collect()] == [(1, "B c d", "x")]


def test_very_long_texts(spark):
    long = " ".join(map(str, range(200_000)))
    df = spark.createDataFrame([(1, long), (2, long + " end"), (3, "1 2 3"), (4, long[: len(long) // 2])], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in N.near_duplicates(df, 2).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
