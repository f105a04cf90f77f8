"""Operator 5, token counts: a map-side two-tier lookup.

Tier one is a broadcast table of frequent pre-token lengths, tier two a bounded cache in each Python worker that encodes
a pre-token when it is first met.  Pre-tokens of the texts are never shuffled: what is summed across tasks to fill tier one is
a sketch of at most ``SKETCH`` entries a task.  A word between blanks with a character beyond Latin-1 is an entry of its own,
which the library encodes whole when it is met first.  The tiers change speed only; a count is always the library's.

Defined results: null and empty texts count 0 tokens and 0 bytes; repeated rows give repeated rows; an empty table gives
an empty one; further columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.llm.common import id_and_text, keeps, per_batch, small_batches, use

#: Frequent pre-tokens that are broadcast (each of at most 64 characters: a few MB at most), entries that a task offers.
FREQUENT, SKETCH = 65_536, 2_048
#: Entries of a worker's cache, which is emptied when full, and characters of an entry.
CACHE, LONG = 1 << 18, 256

# The normaliser and the pre-token pattern of the word-end BPE vocabulary, and Latin-1's letters,
# numbers and white space, for which the pattern can be applied by Python's re with equal results.
_NORMALIZER = [("NFC", None), ("Replace", "\\s+"), ("Lowercase", None)]
_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_L, _N, _S = "a-zA-Zªµºß-öø-ÿÀ-ÖØ-Þ", "0-9²³¹¼½¾", "\t-\r \x85\xa0"
_LATIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")
#: Bytes of Latin-1's characters in UTF-8.
_LATIN_BYTES = bytes(range(0xC4))
#: What Latin-1 doesn't hold, and blanks: no pre-token, composition or lower-casing goes across one.
_BEYOND, _BLANKS, _BLANK = re.compile("[^\x00-\xff]"), " \t\n\r", re.compile("[ \t\n\r]")


class _Cache(dict):
    """Pre-token -> value, encoding what it lacks.

    When full it becomes the old generation, whose entries come back when they are met again, so what is frequent stays.
    """

    def __init__(self, make, fixed=None, capacity: int = CACHE // 2):
        super().__init__(fixed or {})
        self.make, self.fixed, self.capacity, self.old = make, fixed or {}, capacity + len(fixed or {}), {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) > LONG:
            return value
        if len(self) >= self.capacity:
            self.old = dict(self)
            self.clear()
            self.update(self.fixed)
        self[key] = value
        return value


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write a byte as a letter: printable Latin-1 as itself, the rest from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Token ids and counts of whole texts, equal to the library's, for a ``.json`` or ``.model`` file."""

    def __init__(self, path: str, lengths: dict[str, int] | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.path, self.fast = path, False
        if path.endswith(".model"):
            import sentencepiece

            self.piece = sentencepiece.SentencePieceProcessor(model_file=path)
            self.whole, self.size = (lambda t: self.piece.encode(t, num_threads=1)), self.piece.vocab_size()
        else:
            from tokenizers import Tokenizer

            self.tok = Tokenizer.from_file(path)
            self.whole, self.size = (lambda t: self.tok.encode(t, add_special_tokens=False).ids), self.tok.get_vocab_size(with_added_tokens=True)
            spec = json.loads(self.tok.to_str())
            self.special = [x["content"] for x in spec["added_tokens"]]
            self.special_bytes = [x.encode() for x in self.special]
            norm = [(x["type"], x.get("pattern", {}).get("Regex")) for x in (spec["normalizer"] or {}).get("normalizers", [])]
            pre = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
            self.fast = norm == _NORMALIZER and pre[0].get("pattern", {}).get("Regex") == _PATTERN and spec["post_processor"] is None
        self.kind = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.letters = [letter for _, letter in sorted(_byte_letters().items())]
        self.count = _Cache(lambda w: len(self.of_pretoken(w)), lengths)
        self.bytes = _Cache(lambda w: self.packed(self.of_pretoken(w)))

    def of_pretoken(self, word: str) -> list[int]:
        """Ids of one pre-token: its bytes as letters, straight to the merges; of a word beyond Latin-1, the library's."""
        if not word.isascii() and max(word) > "\xff":
            return self.whole(word)
        # Printable ASCII is written as itself.
        if not (word.isascii() and word.isprintable()):
            word = "".join([self.letters[b] for b in word.encode()])
        return [t.id for t in self.tok.model.tokenize(word)]

    def packed(self, ids: list[int]) -> bytes:
        return array("H", ids).tobytes() if self.kind.itemsize == 2 and sys.byteorder == "little" else np.asarray(ids, self.kind).tobytes()

    def of_word(self, word: bytes) -> bytes:
        """Ids of a word between ASCII blanks, which no pre-token crosses."""
        text = word.decode("utf-8", "replace")
        if text.isascii() and text.isalpha():
            return self.packed([t.id for t in self.tok.model.tokenize(text.lower())])
        if text.isascii() or max(text) <= "\xff":
            return b"".join(map(self.bytes.__getitem__, _LATIN.findall(text.lower())))
        return self.packed(self.whole(text))

    def pretokens(self, text: str) -> list[str] | None:
        """The text's pre-tokens, and words beyond Latin-1 as they are; None where only the library will do: with special strings."""
        if not self.fast or any(s in text for s in self.special):
            return None
        if text.isascii() or max(text) <= "\xff":
            return _LATIN.findall(text.lower())
        out, at = [], 0
        while m := _BEYOND.search(text, at):
            begin = max(at, 1 + max(text.rfind(c, at, m.start()) for c in _BLANKS))
            end = blank.start() if (blank := _BLANK.search(text, m.end())) else len(text)
            out += _LATIN.findall(text[at:begin].lower())
            out.append(text[begin:end])
            at = end
        return out + _LATIN.findall(text[at:].lower())

    def n_tokens(self, text: str) -> int:
        words = self.pretokens(text)
        return len(self.whole(text)) if words is None else sum(map(self.count.__getitem__, words))

    def closes(self) -> list[bool]:
        """Whether each id ends a word."""
        if self.path.endswith(".model"):
            return [False] * self.size
        return [(self.tok.id_to_token(i) or "").endswith("</w>") for i in range(self.size)]

    def ids(self, text: str) -> bytes:
        """Ids as little-endian integers of ``self.kind``."""
        words = self.pretokens(text)
        return np.asarray(self.whole(text), self.kind).tobytes() if words is None else b"".join(map(self.bytes.__getitem__, words))


    def by_words(self, text: bytes) -> bool:
        """Whether a text in UTF-8 has the ids of its words between ASCII blanks, A-Z in lower case or not.

        Beyond Latin-1 a letter's case can decide what its marks compose to; special strings are the library's.
        """
        return self.fast and not text.translate(None, _LATIN_BYTES) and not any(s in text for s in self.special_bytes)


class WordIds(dict):
    """Word -> ids, kept for the words that ``frequent`` has and worked out each time for others: most of these are met once."""

    def __init__(self, encoder: Encoder, frequent):
        super().__init__()
        self.make, self.frequent = encoder.of_word, frequent

    def __missing__(self, word: bytes) -> bytes:
        ids = self.make(word)
        if word in self.frequent:
            self[word] = ids
        return ids


_ENCODERS: dict[tuple, Encoder] = {}
keeps("ids", _ENCODERS)


def encoder(path: str, lengths: dict[str, int] | None = None, tag: str = "") -> Encoder:
    """One encoder for each file and worker, kept while the worker needs it."""
    use("ids")
    if (path, tag) not in _ENCODERS:
        for old in [k for k in _ENCODERS if k[1] and tag and k[1] != tag]:
            del _ENCODERS[old]
        _ENCODERS[path, tag] = Encoder(path, lengths)
    return _ENCODERS[path, tag]


def frequent_lengths(texts: DataFrame, path: str) -> dict[str, int]:
    """The most frequent pre-tokens of all texts with their lengths: each task offers a sketch, the sums are ranked."""

    def sketch(batches):
        enc, seen = encoder(path), Counter()
        for b in small_batches(batches):
            for t in b.column("text").to_pylist():
                words = enc.pretokens(t.decode("utf-8", "replace"))
                if words:
                    seen.update(words)
            if len(seen) > 4 * CACHE:
                seen = Counter(dict(seen.most_common(CACHE)))
        top = [(w, c) for w, c in seen.most_common(SKETCH) if len(w) <= 64]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([c for _, c in top], pa.int64())], ["w", "c"])

    top = texts.select("text").mapInArrow(sketch, "w string, c long").groupBy("w").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "w").limit(FREQUENT)
    enc = encoder(path)
    return {r.w: len(enc.of_pretoken(r.w)) for r in top.collect()}


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens of every whole text, as the library for ``tokenizer`` gives them without added tokens."""
    texts = id_and_text(docs, id_col, text_col)
    fast = encoder(tokenizer).fast
    lengths = docs.sparkSession.sparkContext.broadcast(frequent_lengths(texts, tokenizer) if fast else {})
    tag = f"b{lengths._jbroadcast.id()}" if lengths._jbroadcast is not None else "b"

    def count(b: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoder(tokenizer, lengths.value, tag)
        texts = b.column("text").to_pylist()
        n = [enc.n_tokens(t.decode("utf-8", "replace")) for t in texts]
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return texts.mapInArrow(per_batch(count), "doc_id long, n_bytes long, n_tokens long")
