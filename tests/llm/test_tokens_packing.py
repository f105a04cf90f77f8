import zlib

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from strandflow.llm import packing, tokens

WORD = P.path("word_bpe_49k.json")


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_counts_are_the_librarys(spark, odd_docs, name):
    path = P.path(name)
    if name.endswith(".json"):
        tok = Tokenizer.from_file(path)
        n = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    else:
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lambda t: len(sp.encode(t))
    want = sorted((str(r.doc_id), len((r.text or "").encode()), n(r.text or "")) for r in odd_docs.collect())
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in tokens.count_tokens(odd_docs, path).collect()) == want


def test_fast_way_equals_library_on_latin_text():
    enc, tok = tokens.Encoder(WORD), Tokenizer.from_file(WORD)
    every = "".join(map(chr, range(1, 256)))
    for t in (every, "a".join(every), "'S 'RE 'll'd it''s --'t", " x\x85y\xa0z\x1cw\x1fv", "ÀÉß µª"):
        assert np.frombuffer(enc.ids(t), enc.kind).tolist() == tok.encode(t, add_special_tokens=False).ids
        assert enc.n_tokens(t) == len(tok.encode(t, add_special_tokens=False).ids)


def test_fast_way_equals_library_beyond_latin_text():
    import random

    rng = random.Random(4)
    enc, tok = tokens.Encoder(WORD), Tokenizer.from_file(WORD)
    kinds = ["abcXYZ019' \t\n", "éßÀ\xa0\x85²", "漢字かなカ한글", "“”‘’—…€™", "ΣσςАбвЯИ", "\u0300\u0301\u0308\u1100\u1161\u11a8", "🙂👍🏽\u200d\ufe0f", "\u2028\u3000\u2003\u1680", "İıſKÅﬁ", "क्षิ١٢"]
    for n in range(400):
        t = "".join(rng.choice(rng.choice(kinds)) if rng.random() < 0.7 else " " for _ in range(rng.randint(1, 60)))
        assert np.frombuffer(enc.ids(t), enc.kind).tolist() == tok.encode(t, add_special_tokens=False).ids, t
    assert enc.pretokens("plain “quoted” words — and more") is not None
    long = "x" * 300_000 + "é" * 1000 + " 漢 " + "y" * 300_000
    assert enc.n_tokens(long) == len(tok.encode(long, add_special_tokens=False).ids)
    assert not any(len(k) > tokens.LONG for k in enc.count)


def test_cache_stays_bounded():
    c = tokens._Cache(len, {"fixed": 9}, capacity=10)
    for i in range(100):
        assert c[str(i)] == len(str(i)) and len(c) <= 11 and len(c.old) <= 11
    assert c["fixed"] == 9


def test_packing_gives_every_id_once(spark, odd_docs):
    tok = Tokenizer.from_file(WORD)
    for window in (7, 64, 4096):
        pieces = packing.pack(odd_docs, WORD, window=window).collect()
        by_seq = {}
        for p in pieces:
            ids = np.frombuffer(p.ids, "<u4")
            assert len(ids) == p.length and zlib.crc32(p.ids) == p.ids_crc32 and p.length > 0
            by_seq.setdefault(p.sequence_id, []).append(p)
        assert sorted(by_seq) == list(range(len(by_seq)))
        for s, ps in by_seq.items():
            ps.sort(key=lambda p: p.offset)
            assert ps[0].offset == 0 and all(a.offset + a.length == b.offset for a, b in zip(ps, ps[1:], strict=False))
            assert sum(p.length for p in ps) == window or s == len(by_seq) - 1
        docs = sorted((str(r.doc_id), tuple(tok.encode(r.text or "", add_special_tokens=False).ids + [2])) for r in odd_docs.collect())
        runs, flat = [], sorted(pieces, key=lambda p: (p.sequence_id, p.offset))
        for p in flat:
            if p.start == 0:
                runs.append([str(p.doc_id), []])
            assert len(runs[-1][1]) == p.start
            runs[-1][1].extend(np.frombuffer(p.ids, "<u4").tolist())
        assert sorted((d, tuple(i)) for d, i in runs) == docs


def test_sequences_and_empty_table(spark, odd_docs):
    pieces = packing.pack(odd_docs, WORD, window=64)
    whole = packing.sequences(pieces).collect()
    assert all(len(r.ids) == 256 for r in whole if r.sequence_id < len(whole) - 1)
    assert packing.pack(odd_docs.limit(0), WORD).count() == 0
    assert tokens.count_tokens(odd_docs.limit(0), WORD).count() == 0
