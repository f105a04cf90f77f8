import hashlib
import re

from strandflow.llm import pii

RX = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def good(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": all(int(x) <= 255 for x in m.split(".")) if kind == "ip" else True, "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]


def base(text):
    return {k: [(m.start(), m.end()) for m in re.finditer(r, text or "") if good(k, m.group())] for k, r in RX.items()}


TEXTS = [
    None, "", "plain", "a@b.c_x@d.e f@@g.h .@x.y", "é🙂 mail joe.doe+1@ex-ample.co.uk, or x@y", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004 10.0.0.255.", "4111 1111 1111 1111 and 4111-1111-1111-1112 5500005555555559",
    "+1 (988) 555-2485 +12 345678 +1234567890123456 ++1 (212) 555 0000.", "9" * 5000 + " 4012888888881881", "x" * 60_000 + "@a.b", "n " + "9" * 10_000 + " " + "9-" * 5000 + "9", "a1" * 5000 + " b", ("a@b.cd 1.1.1.1 " * 900) + "end", "1.2.3", "1 " * 20_000,
]


def test_base_spans_equal_plain_regexes(spark):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(TEXTS)] + [(None, TEXTS[3], 1, "x"), (3, TEXTS[3], 1, "x")], "doc_id long, text string, uid int, email string").repartition(3)
    got = pii.digest(pii.find(df)).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        want = base(TEXTS[3 if r.doc_id is None else r.doc_id])
        said = ",".join(f"{k}:{s}:{e}" for k in pii.KINDS for s, e in want[k])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(want[k]) for k in pii.KINDS], r.doc_id
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert set(filter(None, said.split(","))) <= set(filter(None, r.spans.split(",")))
    assert pii.digest(pii.find(df.limit(0))).count() == 0 and pii.redact(df.limit(0)).count() == 0


def contextual(spark):
    rows = [(i, f"words dial: +1 (212) 555-{1000 + i} then the {i} end") for i in range(12)]
    rows += [(100, "please dial: 555-9876, thanks"), (101, "the 77 of it"), (102, "nothing here"), (103, None)]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({})


def test_contexts_discover_unseen_identifiers(spark):
    got = {r.doc_id: r for r in pii.digest(pii.find(contextual(spark))).collect()}
    assert got[100].spans == "phone:13:21" and got[100].n_phone == 0
    assert got[101].spans == "" and got[102].spans == ""
    assert got[0].spans.count("phone") == 1


def plain_patterns(rows):
    """The graph by loops: (pattern, token, kind or None) rows to pattern -> (score, kind)."""
    import math

    edges = {}
    for p, t, k in rows:
        edges[p, t] = max(filter(None, (edges.get((p, t)), k)), default=None)
    by = {}
    for p, t in edges:
        by.setdefault(p, set()).add(t)
    seeds = {(t, k): 1.0 for (_, t), k in edges.items() if k}
    belief, score = dict(seeds), {}
    for _ in range(pii.TURNS):
        score = {}
        for p, tokens in by.items():
            for k in pii.KINDS:
                got = [belief[t, k] for t in tokens if (t, k) in belief]
                if sum(x >= pii.TRUST for x in got) >= pii.SUPPORT and sum(got) / (len(tokens) + 1) >= pii.TRUST:
                    score[p, k] = sum(got) / (len(tokens) + 1)
        belief = dict(seeds)
        for t in {t for _, t in edges}:
            for k in pii.KINDS:
                said = [math.log1p(-min(score[p, k], 0.999)) for p in by if t in by[p] and (p, k) in score]
                if said:
                    belief[t, k] = max(belief.get((t, k), 0), 1 - math.exp(sum(said)))
    return {p: max((v, k) for (q, k), v in score.items() if q == p) for p, _ in score}


def test_pattern_graph_equals_plain_loops(spark):
    import random

    rng = random.Random(3)
    rows = [(f"p{rng.randrange(25)}", f"t{min(rng.randrange(80), rng.randrange(80))}", "ip" if rng.random() < 0.55 else rng.choice([None, "card"])) for _ in range(900)]
    seen = {}
    rows = [(p, t, seen.setdefault(t, k)) for p, t, k in rows]
    want = plain_patterns(rows)
    got = {r.ctx: (r.score, r.kind) for r in pii.trusted_patterns(spark.createDataFrame(rows, "ctx string, token string, kind string")).collect()}
    assert want and set(got) == set(want)
    assert all(abs(got[p][0] - want[p][0]) < 1e-9 and got[p][1] == want[p][1] for p in want)


def test_found_tokens_make_further_patterns_known(spark):
    # Only "dial:" meets base numbers; short ones behind it are found first, then what stands before the same ones elsewhere.
    rows = [(i, f"please dial: +1 (212) 555-{1000 + i} then go") for i in range(30)]
    rows += [(100 + i, f"please dial: 555-{2000 + i}, thanks") for i in range(10)]
    rows += [(200 + i, f"or extension 555-{2000 + i} maybe") for i in range(10)]
    rows += [(300, "or extension x9-77 maybe"), (400, "chapter 7 of 12 pages"), (401, "in 1999 we had 40 of them")]
    got = {r.doc_id: r.spans for r in pii.digest(pii.find(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got[104] == "phone:13:21" and got[204] == "phone:13:21" and got[300] == "phone:13:18"
    assert got[400] == got[401] == ""


def test_what_a_test_refutes_is_never_added(spark):
    cards = [f"4{i:014d}" for i in range(40)]
    cards = [c + next(d for d in "0123456789" if luhn(c + d)) for c in cards]
    wrong = cards[0][:-1] + str((int(cards[0][-1]) + 1) % 10)
    rows = [(i, f"card {c} ok") for i, c in enumerate(cards)] + [(90, f"card {wrong} ok"), (91, "card 4000-12 ok")]
    got = {r.doc_id: r.spans for r in pii.digest(pii.find(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got[90] == "" and got[91] == "" and got[5] == "card:5:21"


def test_redacts(spark):
    df = contextual(spark).selectExpr("doc_id", "text", "'k' as uid", "length(text) as n_chars")
    got = {r.doc_id: r for r in pii.redact(df).collect()}
    assert got[100].text == "please dial: [PHONE], thanks" and got[100].n_chars == 28 and got[100].uid == "k"
    assert got[3].text == "words dial: [PHONE] then the 3 end" and got[102].text == "nothing here" and got[103].text is None
    assert pii.redact(df).columns == df.columns


def test_main_path_is_native(spark):
    plan = pii.find(contextual(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
