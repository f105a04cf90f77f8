"""Operator 10, MinHash near-dedup: an LSH forest.

A document's set is its distinct shingles of ``k`` words; equal sets form a class, and from there on only one row of each
class goes on.  Each class has a signature of ``VALUES`` min-hashes and a row in each of ``TREES`` sorted orders of it: an
order begins with values of its own and goes on with values of the next orders.  Rows that share the first ``SHALLOW``
values are a region of an order, and candidates are the pairs of a region whose signatures agree well enough.

The first ``FIRST`` orders connect most of what is alike at little cost: a region of at most ``REGION`` rows is compared as
it is; a larger one is compared with its most central rows and split by the next value, and so on to ``DEEP`` values, so
depth follows density.  A maximum spanning forest of the agreement names the candidates, with runners-up wherever an edge
is not beyond doubt.  Nothing has to be found there.

Then all orders are sorted again, with the components known, and every pair of every region that lies between two
components is looked at.  Small regions offer a forest with runners-up; whatever pair is not offered, in small regions and
large, holds its two rows back.  Regions that are too large for a task, or that the range partitioner may have cut, are
put together again and compared in blocks, every pair of blocks.  Rows held back are brought together by region with
their texts, and all their pairs are decided there on the full sets, so no pair is lost to a forest, a window or a cut.
Rows of a region's largest component are only compared with the others, so a large component costs what it has, not its square.

Offered pairs are confirmed on the full sets of 64-bit shingle hashes, best first: in each round every component offers its
best open pair, confirmed links merge components, pairs within a component are settled, and a last round takes all pairs that are
left.  Components are found by smallest labels with pointer jumping; nothing of the documents goes to the driver.

Defined results: a text without words, empty or null has the empty set and links with nothing; one of fewer than ``k``
words is one shingle; repeated rows have equal results; a null id never is a component's id unless no row has one;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.llm.common import ascii_words, by_shuffle, cut, forget, fresh, id_and_text, keeps, per_batch, small_batches, use, utf8

TREES, SHALLOW, DEEP, REGION = 24, 4, 8, 128
VALUES = TREES * SHALLOW
#: Equal nibbles of VALUES that a pair needs to be a candidate: at a similarity of 0.8 the mean is 78, the deviation 3.8.
AGREE, SURE = 60, 88
#: Rows of one region held at once; central rows that all of a large region are compared with; runners-up of a doubtful edge.
HELD, CENTRAL, RUNNERS = 4096, 16, 4
#: Rows and shingles of a block where a region is compared in blocks.
BLOCK, SHINGLES = 2048, 1 << 20
#: Orders whose candidates are confirmed before the others are sorted; bits of the map of hashed ids.
FIRST, BITMAP = 4, 1 << 25
#: Rounds in which each component offers its best pair, before all that is left is confirmed: after the first orders, and
#: after all orders, few of whose pairs are links.
ROUNDS = (2, 1)

_MIX = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(20_240_607)
_A = (_rng.integers(0, 1 << 31, VALUES, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, VALUES, dtype=np.uint32)
#: The values that each order sorts by: its own, then those of the next orders.
_ORDER = (np.arange(TREES)[:, None] * SHALLOW + np.arange(DEEP)[None, :]) % VALUES


class _Words(dict):
    """Word -> 64-bit hash, emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 18:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _Words()
keeps("sets", _WORDS)


def shingles(text: bytes, k: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    use("sets")
    words = ascii_words(text)
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    width = min(k, len(h))
    with np.errstate(over="ignore"):
        out = h[: len(h) - width + 1].copy()
        for j in range(1, width):
            out = (out ^ (out >> np.uint64(29))) * _MIX + h[j : len(h) - width + 1 + j]
        out = (out ^ (out >> np.uint64(32)) ^ np.uint64(width)) * _MIX
        out ^= out >> np.uint64(31)
    return np.unique(out)


def signature(s: np.ndarray) -> np.ndarray:
    """VALUES min-hashes of a set, as 16-bit fingerprints."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    low = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for i in range(0, len(x), 4096):
            low = np.minimum(low, (x[i : i + 4096, None] * _A + _B).min(axis=0))
        low = (low ^ (low >> np.uint32(15))) * np.uint32(0x9E3779B1)
    return (low >> np.uint32(16)).astype(np.uint16)


def set_key(s: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None


SETS = "doc_id long, n_shingles long, key binary, sig binary"


def set_table(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """A row for each document: its set's size, 128-bit key and signature (null for the empty set)."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t, k) for t in b.column("text").to_pylist()]
        sigs = [signature(s).astype("<u2").tobytes() if len(s) else None for s in sets]
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s) for s in sets], pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "n_shingles", "key", "sig"])

    return id_and_text(docs, id_col, text_col).mapInArrow(per_batch(run), SETS)


def _orders(classes: DataFrame, trees: range) -> DataFrame:
    """ord, key, n, nib, label: each class in each order; ``ord`` is the order, the values by depth, then a salt."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        keys, n = b.column("key").to_pylist(), b.column("n").to_numpy()
        sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), "<u2").reshape(-1, VALUES)
        nib = ((sig[:, ::2] & 15) | ((sig[:, 1::2] & 15) << 4)).astype(np.uint8)
        nibs = [x.tobytes() for x in nib]
        words = sig[:, _ORDER].astype(">u2")
        ords = [bytes((t,)) + words[i, t].tobytes() + xxhash.xxh3_64_digest(keys[i], seed=t) for t in trees for i in range(len(keys))]
        times = len(trees)
        return pa.RecordBatch.from_arrays([pa.array(ords, pa.binary()), pa.array(keys * times, pa.binary()), pa.array(np.tile(n, times), pa.int64()), pa.array(nibs * times, pa.binary()), pa.array(b.column("label").to_pylist() * times, pa.binary())], ["ord", "key", "n", "nib", "label"])

    # A class that is a component of its own has no label, which costs nothing in the shuffle.
    return classes.select("key", "n", "sig", "label").mapInArrow(per_batch(run), "ord binary, key binary, n long, nib binary, label binary")


class _Region:
    """Rows of one region in order, and the pairs that they offer."""

    def __init__(self, ords: list[bytes], keys: list[bytes], n: list[int], nibs: list[bytes], labels: list[bytes | None]):
        self.ords, self.keys, self.n, self.nibs, self.labels = ords, keys, np.array(n), nibs, labels
        packed = np.frombuffer(b"".join(nibs), np.uint8).reshape(len(keys), -1)
        self.nib = np.stack((packed & 15, packed >> 4), axis=2).reshape(len(keys), -1)
        self.columns = np.ascontiguousarray(self.nib.T)
        self.out: dict[tuple[bytes, bytes], int] = {}
        #: Rows with pairs that were not offered.
        self.back: set[int] = set()
        self.by_key = np.argsort(np.argsort(np.array(keys, dtype=object), kind="stable"), kind="stable")
        #: Rows that are known to be connected or, in the first orders, that a central row most likely holds together; -1 for the others.
        known = {x: i for i, x in enumerate(dict.fromkeys(x for x in labels if x is not None))}
        self.group, self.groups = np.array([-1 if x is None else known[x] for x in labels], int), len(known)

    def offer(self, i: int, j: int, agree: int) -> None:
        a, b = self.keys[i], self.keys[j]
        if a != b:
            self.out[(a, b) if a < b else (b, a)] = int(agree)

    def agreement(self, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        """Equal nibbles of rows and cols; -1 where the sets' sizes rule a link out or rows are known to be connected."""
        if len(rows) * len(cols) <= 512:
            agree = (self.nib[rows][:, None, :] == self.nib[cols][None, :, :]).sum(axis=2, dtype=np.int16)
        else:
            agree = np.empty((len(rows), len(cols)), np.int16)
            step = max(1, (1 << 18) // len(cols))
            x, y = self.columns[:, rows], self.columns[:, cols]
            for i in range(0, len(rows), step):
                part = np.zeros((len(rows[i : i + step]), len(cols)), np.uint8)
                same = np.empty(part.shape, bool)
                for v in range(VALUES):
                    np.equal(x[v, i : i + step, None], y[v], out=same)
                    part += same.view(np.uint8)
                agree[i : i + step] = part
        small, large = np.minimum.outer(self.n[rows], self.n[cols]), np.maximum.outer(self.n[rows], self.n[cols])
        one = (self.group[rows][:, None] == self.group[cols][None, :]) & (self.group[rows] >= 0)[:, None]
        agree[(100 * small < 80 * large) | (agree < AGREE) | one] = -1
        return agree

    def whole(self, rows: np.ndarray) -> None:
        """Every pair of a region between two components is offered or holds its rows back."""
        if len(rows) < 2 or self.group[rows[0]] >= 0 and (self.group[rows] == self.group[rows[0]]).all():
            return
        if len(rows) <= REGION:
            self.forest(rows)
        else:
            self.back.update(self.doubtful(rows).tolist())

    def doubtful(self, rows: np.ndarray) -> np.ndarray:
        """The rows with a pair that may be a link between two components."""
        group = self.group[rows]
        size = np.bincount(group[group >= 0], minlength=1)
        few = rows if size.max() < 2 else rows[group != size.argmax()]
        found = np.zeros(len(self.keys), bool)
        for i in range(0, len(few), 256):
            part = few[i : i + 256]
            agree = self.agreement(part, rows)
            agree[part[:, None] == rows[None, :]] = -1
            found[part] |= (agree >= AGREE).any(axis=1)
            found[rows] |= (agree >= AGREE).any(axis=0)
        return np.flatnonzero(found)

    def go(self, rows: np.ndarray, depth: int) -> None:
        if len(rows) < 2 or self.group[rows[0]] >= 0 and (self.group[rows] == self.group[rows[0]]).all():
            return
        if len(rows) <= REGION:
            self.forest(rows)
            return
        self.centre(rows)
        if depth == DEEP:
            for i in range(0, len(rows), REGION // 2):
                self.forest(rows[i : i + REGION])
            return
        at = slice(1 + 2 * depth, 3 + 2 * depth)
        first = 0
        for i in range(1, len(rows) + 1):
            if i == len(rows) or self.ords[rows[i]][at] != self.ords[rows[first]][at]:
                self.go(rows[first:i], depth + 1)
                first = i

    def centre(self, rows: np.ndarray) -> None:
        """Each row with the two of the region's most central rows that it agrees with best."""
        flat = np.bincount((self.nib[rows] + 16 * np.arange(VALUES)).ravel(), minlength=16 * VALUES).reshape(VALUES, 16)
        mode = flat.argmax(axis=1)
        near = (self.nib[rows] == mode).sum(axis=1)
        top = rows[np.lexsort((self.by_key[rows], -near))[:CENTRAL]]
        agree = self.agreement(rows, top)
        agree[rows[:, None] == top[None, :]] = -1
        seen = agree.copy()
        # Central rows that are beyond doubt alike are one; a row belongs to the one it agrees with best, if beyond doubt.
        lead = np.arange(len(top))
        among = self.agreement(top, top)
        for i, j in zip(*np.nonzero(np.triu(among, 1) >= SURE), strict=True):
            lead[lead == lead[j]] = lead[i]
        for i, j in zip(*np.nonzero(np.triu(self.group[top][:, None] == self.group[top][None, :], 1)), strict=True):
            if self.group[top[i]] >= 0:
                lead[lead == lead[j]] = lead[i]
        best = agree.argmax(axis=1)
        held = (agree[np.arange(len(rows)), best] >= SURE) & (self.group[rows] < 0)
        self.group[rows[held]] = self.groups + lead[best[held]]
        for k, i in enumerate(top):
            if self.group[i] < 0:
                self.group[i] = self.groups + lead[k]
        self.groups += len(top)
        for _ in range(2):
            best = seen.argmax(axis=1)
            value = seen[np.arange(len(rows)), best]
            for i in np.flatnonzero(value >= AGREE):
                self.offer(rows[i], top[best[i]], value[i])
            seen[np.arange(len(rows)), best] = -1

    def forest(self, rows: np.ndarray) -> None:
        """A maximum spanning forest of the agreement, with runners-up of doubtful edges and each row's best partner."""
        if len(rows) == 2:
            i, j = int(rows[0]), int(rows[1])
            if 0 <= self.group[i] == self.group[j]:
                return
            if 100 * min(self.n[i], self.n[j]) >= 80 * max(self.n[i], self.n[j]):
                value = int((self.nib[i] == self.nib[j]).sum())
                if value >= AGREE:
                    self.offer(i, j, value)
            return
        m, rows = len(rows), rows[np.argsort(self.by_key[rows])]
        agree = self.agreement(rows, rows)
        group = self.group[rows]
        np.fill_diagonal(agree, -1)
        upper = np.triu(agree, 1)
        a, b = np.nonzero(upper >= AGREE)
        if not len(a):
            return
        best = agree.argmax(axis=1)
        for i in range(m):
            if agree[i, best[i]] >= AGREE:
                self.offer(rows[i], rows[best[i]], agree[i, best[i]])
        offered = np.zeros((m, m), bool)
        offered[np.arange(m), best] = True
        label = np.arange(m)
        for k in np.unique(group[group >= 0]):
            label[group == k] = label[group == k][0]
        left = len(np.unique(label)) - 1
        for e in np.argsort(-upper[a, b], kind="stable"):
            i, j = a[e], b[e]
            x, y = label[i], label[j]
            if x == y:
                continue
            value = upper[i, j]
            self.offer(rows[i], rows[j], value)
            offered[i, j] = True
            if value < SURE:
                p, q = np.flatnonzero(label == x), np.flatnonzero(label == y)
                cross = agree[np.ix_(p, q)]
                for f in np.argsort(-cross, axis=None, kind="stable")[: RUNNERS + 1]:
                    u, v = divmod(int(f), len(q))
                    if cross[u, v] >= AGREE:
                        self.offer(rows[p[u]], rows[q[v]], cross[u, v])
                        offered[p[u], q[v]] = True
            label[label == y] = x
            left -= 1
            if not left:
                break
        for i in np.flatnonzero(((agree >= AGREE) & ~(offered | offered.T)).any(axis=1)):
            self.back.add(int(rows[i]))


_OFFERED = "a binary, b binary, agree int, region binary, nib binary, n long, label binary"


def _offered(pairs: dict, rows: list[tuple]) -> pa.RecordBatch:
    """Pairs, then rows without a partner: (key, region), or with nib, n and label too where no task has the whole region."""
    columns = [[a for a, _ in pairs], [b for _, b in pairs], list(pairs.values()), *([None] * len(pairs) for _ in range(4))]
    for key, region, *rest in rows:
        for c, x in zip(columns, (key, None, -1, region, *(rest or (None, None, None))), strict=True):
            c.append(x)
    kinds = [pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in _OFFERED.split(", ")])


def candidates(classes: DataFrame, trees: range = range(TREES), whole: bool = True) -> DataFrame:
    """``_OFFERED``: distinct candidate pairs of classes from some of the orders, a < b; none within a label.

    With ``whole`` nothing is left out: a row without b is a class with pairs in a region that are not offered, and
    where it carries its signature too the region may lie in several tasks, or is too large for one.
    """

    def run(batches):
        held: list[list] = [[], [], [], [], []]
        pairs: dict[tuple[bytes, bytes], int] = {}
        rows: list[tuple] = []
        size, regions, over = 1 + 2 * SHALLOW, 0, False

        def flush(edge: bool) -> None:
            region = held[0][0][:size]
            if whole and edge:
                rows.extend(zip(held[1], [region] * len(held[1]), held[3], held[2], held[4], strict=True))
            elif len(held[0]) > 1:
                r = _Region(*held)
                if whole:
                    r.whole(np.arange(len(held[0])))
                else:
                    r.go(np.arange(len(held[0])), SHALLOW)
                pairs.update(r.out)
                if whole:
                    rows.extend((r.keys[i], region) for i in r.back)
            for x in held:
                x.clear()

        for b in small_batches(batches, most_rows=8192):
            for row in zip(*(b.column(c).to_pylist() for c in ("ord", "key", "n", "nib", "label")), strict=True):
                if held[0] and held[0][-1][:size] != row[0][:size]:
                    # A task's first region may have begun in another.
                    flush(over or not regions)
                    regions, over = regions + 1, False
                elif len(held[0]) >= HELD:
                    flush(True)
                    over = True
                for x, v in zip(held, row, strict=True):
                    x.append(v)
            if len(pairs) + len(rows) > 20_000:
                yield _offered(pairs, rows)
                pairs, rows = {}, []
        if held[0]:
            flush(True)
        if pairs or rows:
            yield _offered(pairs, rows)

    rows = _orders(classes, trees)
    ordered = rows.repartitionByRange("ord").sortWithinPartitions("ord")
    return ordered.mapInArrow(run, _OFFERED).groupBy("a", "b", "region", "nib", "n", "label").agg(F.max("agree").alias("agree"))


def confirm(pairs: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar: 100 * intersection >= 80 * union."""

    def run(batches):
        last: tuple[bytes, np.ndarray] = (b"", np.zeros(0, np.uint64))
        for b in small_batches(batches):
            out_a, out_b = [], []
            for a, c, ta, tb in zip(*(b.column(x).to_pylist() for x in ("a", "b", "ta", "tb")), strict=True):
                if last[0] != c:
                    last = (c, shingles(tb, k))
                s, t = shingles(ta, k), last[1]
                both = len(np.intersect1d(s, t, assume_unique=True))
                if 100 * both >= 80 * (len(s) + len(t) - both):
                    out_a.append(a)
                    out_b.append(c)
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.binary()), pa.array(out_b, pa.binary())], ["a", "b"])

    with_a = pairs.select("a", "b").join(texts.select(F.col("key").alias("a"), F.col("text").alias("ta")), "a")
    return with_a.join(texts.select(F.col("key").alias("b"), F.col("text").alias("tb")), "b").mapInArrow(run, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node of each component of the edges (a, b)."""
    both = cut(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))), "edges")
    label = cut(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("label")), "labels")
    while True:
        near = both.join(label.select(F.col("node").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("near"))
        new = label.join(near.withColumnRenamed("u", "node"), "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = new.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = cut(new.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("next", "label")).alias("label")), "labels")
        moved = new.where("old <> label").limit(1).count()
        forget(label)
        label = new
        if not moved:
            forget(both)
            return label.select("node", "label")


def _texts(docs: DataFrame, reps: DataFrame, k: int) -> DataFrame:
    """key, text of the classes ``reps`` (key, rep).

    A bitmap of hashed ids, whose size is fixed, lets few other documents through to the join; the key decides.
    """
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(BITMAP)) + 1
    bits = reps.select(slot("rep").alias("s")).groupBy(F.bitmap_bucket_number("s").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bits"))
    # Buckets and slots count from 1, bits from 0; a bucket's bytes are the map's own.
    table = np.zeros(BITMAP >> 3, np.uint8)
    for r in bits.collect():
        part, at = np.frombuffer(bytes(r.bits), np.uint8), (r.bucket - 1) * 4096
        table[at : at + len(part)] = part[: max(0, len(table) - at)]
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        s = b.column("s").to_numpy()
        b = b.filter(pa.array((shared.value[s >> 3] >> (s & 7) & 1).astype(bool)))
        texts = b.column("text").to_pylist()
        return pa.RecordBatch.from_arrays([pa.array([set_key(shingles(t, k)) for t in texts], pa.binary()), b.column("text")], ["key", "text"])

    place = (F.bitmap_bucket_number("s") - 1) * 32_768 + F.bitmap_bit_position("s")
    rows = docs.withColumn("s", slot("doc_id")).select("text", place.alias("s")).mapInArrow(per_batch(run), "key binary, text binary")
    return cut(rows.join(reps.select("key"), "key", "left_semi"), "texts").dropDuplicates(["key"])


def _blocks(rows: DataFrame) -> DataFrame:
    """``rows`` (region, key, n, label, ...) dealt to cells, so that each pair of a region that is not within its largest label shares one.

    A cell has at most about two blocks of ``BLOCK`` rows and ``SHINGLES`` shingles.  Rows of the largest label meet only the
    others, so their copies are as many as the others' blocks.  A region of one label has no cell.
    """
    parts = rows.groupBy("region", "label").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    sums = parts.groupBy("region").agg(F.max(F.struct("c", "label", "s")).alias("top"), F.sum("c").alias("rows"), F.sum("s").alias("shingles"))
    need = lambda c, s: F.greatest(F.ceil(c / BLOCK), F.ceil(s / SHINGLES), F.lit(1)).cast("int")
    sums = sums.where("rows > top.c").select("region", F.col("top.label").alias("top"), need(F.col("rows"), F.col("shingles")).alias("all"), need(F.col("rows") - F.col("top.c"), F.col("shingles") - F.col("top.s")).alias("few"), need(F.col("top.c"), F.col("top.s")).alias("many"))
    placed = rows.join(sums, "region").withColumn("major", F.col("label") == F.col("top"))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("key"), F.when(F.col("major"), F.col("many")).otherwise(F.col("few"))).cast("int"))
    cell = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"))
    each = lambda n, f: F.transform(F.sequence(F.lit(0), F.col(n) - 1), f)
    own = F.col("own")
    # One cell where all fits in; else the largest label's rows with each block of the others, and these in pairs of blocks.
    cells = F.when(F.col("all") == 1, F.array(cell(0, F.lit(0), F.lit(0)))).when(F.col("major"), each("few", lambda x: cell(2, x, own)))
    cells = cells.otherwise(F.concat(each("few", lambda x: cell(1, F.least(x, own), F.greatest(x, own))), each("many", lambda x: cell(2, own, x))))
    return placed.withColumn("cell", F.explode(cells)).drop("top", "all", "few", "many", "major", "own")


def _by_cell(batches, columns: list[str]):
    """The rows of one cell at a time, as lists of columns; the rows lie in order of (region, cell)."""
    at, held = None, [[] for _ in columns]
    for b in small_batches(batches):
        data = [b.column(c).to_pylist() for c in columns]
        for i, where in enumerate(zip(b.column("region").to_pylist(), b.column("cell").to_pylist(), strict=True)):
            if where != at:
                if held[0]:
                    yield at, held
                    held = [[] for _ in columns]
                at = where
            for x, v in zip(held, data, strict=True):
                x.append(v[i])
    if held[0]:
        yield at, held


def _in_cells(rows: DataFrame) -> DataFrame:
    return rows.withColumn("cell", F.concat_ws("-", "cell.kind", "cell.i", "cell.j")).repartition("region", "cell").sortWithinPartitions("region", "cell")


def doubtful_rows(rows: DataFrame) -> DataFrame:
    """region, key: of rows (region, key, nib, n, label) those with a pair in a region that may be a link between two labels."""

    def run(batches):
        for (region, cell), (keys, nibs, n, labels) in _by_cell(batches, ["key", "nib", "n", "label"]):
            r = _Region(keys, keys, n, nibs, labels)
            found = r.doubtful(np.arange(len(keys))).tolist()
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([region + cell.encode()] * len(found), pa.binary()), pa.array([keys[i] for i in found], pa.binary())], ["region", "key"])

    return _in_cells(_blocks(rows)).mapInArrow(run, "region binary, key binary")


def links_among(sets: list[np.ndarray], labels: list) -> list[tuple[int, int]]:
    """Links (i, j) of sets with different labels, enough of them to connect all labels that links connect; by exact counts."""
    number = {x: i for i, x in enumerate(dict.fromkeys(labels))}
    lead, label = list(range(len(number))), np.array([number[x] for x in labels])

    def top(i: int) -> int:
        while lead[i] != i:
            lead[i] = lead[lead[i]]
            i = lead[i]
        return i

    n = np.array([len(x) for x in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.r_[True, flat[1:] != flat[:-1]]
    first = np.flatnonzero(new)
    df = np.diff(np.r_[first, len(flat)])
    few = np.bincount(label).max()
    rows = np.arange(len(sets)) if few < 2 else np.flatnonzero(label != np.bincount(label).argmax())
    # Shingles of many sets are columns of a 0-1 matrix, whose product counts them; of the others each pair is counted.
    often = np.flatnonzero(df > 32)
    place = np.full(len(sets), -1)
    place[rows] = np.arange(len(rows))
    both = np.zeros((len(rows), len(sets)), np.float32)
    for at in range(0, len(often), 1024):
        block = np.zeros((len(sets), min(1024, len(often) - at)), np.float32)
        for c, k in enumerate(often[at : at + 1024]):
            block[owner[first[k] : first[k] + df[k]], c] = 1
        both += block[rows] @ block.T
    for size in range(2, 33):
        at = first[df == size]
        if len(at):
            members = owner[at[:, None] + np.arange(size)]
            for u in range(size):
                x = place[members[:, u]]
                ok = x >= 0
                for v in range(size):
                    if u != v:
                        np.add.at(both, (x[ok], members[ok, v]), 1)
    out = []
    for i, row in zip(rows, both, strict=True):
        for j in np.flatnonzero(100 * row >= 80 * (n[i] + n - row)):
            x, y = top(label[i]), top(label[j])
            if x != y:
                lead[y] = x
                out.append((int(i), int(j)))
    return out


def _close(held: DataFrame, labels: DataFrame, docs: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """``labels`` after all pairs of rows held back are decided on their full sets, region by region."""
    now = lambda rows: rows.drop("label").join(labels.select("key", "label"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    edges = held.where("nib is not null").select("region", F.col("a").alias("key"), "nib", "n", "label")
    rows = held.where("nib is null").select("region", F.col("a").alias("key")).unionByName(doubtful_rows(now(edges)))
    rows = cut(now(rows.join(classes.select("key", "n"), "key")), "held")
    cells = cut(_blocks(rows), "cells")
    reps = classes.join(cells.select("key").distinct(), "key", "left_semi").select("key", "rep")
    texts = _texts(docs, reps, k)

    def run(batches):
        for _, (_, words, names) in _by_cell(batches, ["key", "text", "label"]):
            links = links_among([shingles(t, k) for t in words], names)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([names[i] for i, _ in links], pa.binary()), pa.array([names[j] for _, j in links], pa.binary())], ["a", "b"])

    merged = cut(_in_cells(cells.join(texts, "key")).select("region", "cell", "key", "text", "label").mapInArrow(run, "a binary, b binary").distinct(), "links")
    if not merged.limit(1).count():
        return labels
    new = components(merged).select(F.col("node").alias("label"), F.col("label").alias("to"))
    moved = labels.join(new, "label", "left").select("key", F.coalesce("to", "label").alias("label"))
    # Classes that had no pair before are a label of their own.
    alone = new.join(labels.select(F.col("key").alias("label")), "label", "left_anti").select(F.col("label").alias("key"), F.col("to").alias("label"))
    return cut(moved.unionByName(alone), "labels")


def class_components(docs: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents' sets, the classes (key, rep, n_rows, n), and (key, label) of the classes that were compared.

    The first orders connect most of what is alike; all orders, which know the components, then offer only pairs between
    them, and what they hold back is decided in blocks.

    The many joins in between have no broadcasts, whose tables stay on the driver until its heap is collected.
    """
    with by_shuffle(docs.sparkSession):
        return _class_components(docs, k, id_col, text_col)


def _class_components(docs: DataFrame, k: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    sets = cut(set_table(docs, k, id_col, text_col), "sets")
    classes = cut(sets.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_rows"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig")), "classes")
    texts_of = id_and_text(docs, id_col, text_col)
    labels = done = offered = None
    for turn in (0, 1):
        labelled = classes.withColumn("label", F.lit(None).cast("binary")) if labels is None else classes.join(labels.where("not alone").select("key", "label"), "key", "left")
        offered = cut(candidates(labelled, range(TREES if turn else FIRST), turn > 0), "pairs")
        pairs = offered.where("b is not null").select("a", "b", "agree")
        # What was offered before is settled: a link, refuted, or within a component.
        pairs = pairs if done is None else cut(pairs.join(done, ["a", "b"], "left_anti"), "pairs")
        nodes = cut(pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct(), "nodes")
        texts = _texts(texts_of, classes.join(nodes, "key", "left_semi").select("key", "rep"), k)
        own = nodes if labels is None else nodes.join(labels.select("key", "label"), "key", "left")
        own = cut(own.select("key", (F.col("key") if labels is None else F.coalesce("label", "key")).alias("label")), "labels")
        settled = _settle(pairs, own, texts, k, ROUNDS[turn])
        if labels is not None:
            # What was connected before goes along with its component.
            moves = settled.withColumnRenamed("label", "to").join(own, "key").where("label <> to").select("label", "to").distinct()
            old = labels.join(nodes, "key", "left_anti").join(moves, "label", "left").select("key", F.coalesce("to", "label").alias("label"))
            settled = settled.unionByName(old)
        size = settled.groupBy("label").agg((F.count("*") == 1).alias("alone"))
        labels = cut(settled.join(size, "label"), "labels")
        done = pairs.select("a", "b")
    held = offered.where("b is null")
    labels = labels.select("key", "label")
    if held.limit(1).count():
        labels = _close(held, labels, texts_of, classes, k)
    return sets, classes.drop("sig"), labels


def _settle(pairs: DataFrame, labels: DataFrame, texts: DataFrame, k: int, rounds: int) -> DataFrame:
    """key, label of the nodes after confirming the pairs in rounds."""
    open_pairs = pairs
    for turn in range(rounds + 1):
        placed = open_pairs.join(labels.select(F.col("key").alias("a"), F.col("label").alias("la")), "a").join(labels.select(F.col("key").alias("b"), F.col("label").alias("lb")), "b").where("la <> lb")
        open_pairs = cut(placed, "open")
        if not open_pairs.limit(1).count():
            break
        if turn < rounds:
            pair = F.struct("agree", "a", "b")
            best = open_pairs.select(F.explode(F.array("la", "lb")).alias("l"), pair.alias("p")).groupBy("l").agg(F.max("p").alias("p")).select("p.a", "p.b").distinct()
            chosen = cut(best, "chosen")
        else:
            chosen = open_pairs.select("a", "b")
        links = confirm(chosen, texts, k)
        merged = cut(links.join(open_pairs, ["a", "b"]).select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct(), "links")
        if merged.limit(1).count():
            new = components(merged).select(F.col("node").alias("label"), F.col("label").alias("to"))
            labels = cut(labels.join(new, "label", "left").select("key", F.coalesce("to", "label").alias("label")), "labels")
        open_pairs = open_pairs.join(chosen, ["a", "b"], "left_anti").select("a", "b", "agree")
    return labels


def _winners(classes: DataFrame, labels: DataFrame) -> DataFrame:
    """key, component (the smallest id), first (whether this class holds the row that stays), n_rows, rep."""
    labelled = classes.join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    # A null id comes last; among equal ids the smallest key.
    order = F.struct(F.col("rep").isNull().alias("x"), F.col("rep").alias("rep"), F.col("key").alias("key"))
    top = labelled.groupBy("label").agg(F.min(order).alias("top"))
    return labelled.join(top, "label").select("key", F.col("top.rep").alias("component"), (F.col("key") == F.col("top.key")).alias("first"), "n_rows", "rep")


def near_duplicates(docs: DataFrame, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row for each document."""
    sets, classes, labels = class_components(docs, k, id_col, text_col)
    found = _winners(classes, labels).where("n_rows > 1 or component <> rep or not first").select("key", "component")
    component = F.coalesce("component", "doc_id")
    return sets.drop("sig").join(found, "key", "left").select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def drop_near_copies(docs: DataFrame, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they were, of which one of each group of near copies stays.

    The smallest id stays (a null id only if no other is there; of repeated rows one); texts without words all stay.
    """
    _, classes, labels = class_components(docs, k, id_col, text_col)
    with by_shuffle(docs.sparkSession):
        stay = cut(_winners(classes, labels).where("first").select(F.col("key").alias("w_key"), F.col("rep").alias("w_rep"), "n_rows"), "winners")
    raw, key = fresh(docs, "__utf8"), fresh(docs, "__key")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        keys = [set_key(shingles(t, k)) for t in b.column(raw).to_pylist()]
        at = b.schema.get_field_index(raw)
        return pa.RecordBatch.from_arrays([c for i, c in enumerate(b.columns) if i != at] + [pa.array(keys, pa.binary())], [c for c in b.schema.names if c != raw] + [key])

    keyed = docs.withColumn(raw, utf8(text_col)).mapInArrow(per_batch(run), docs.withColumn(key, F.lit(None).cast("binary")).schema)
    n_rows, w_key, w_rep = (fresh(docs, x) for x in ("n_rows", "w_key", "w_rep"))
    stay = stay.select(F.col("w_key").alias(w_key), F.col("w_rep").alias(w_rep), F.col("n_rows").alias(n_rows))
    joined = keyed.join(stay, (keyed[key] == stay[w_key]) & keyed[id_col].cast("long").eqNullSafe(stay[w_rep]))
    once = joined.where(F.col(n_rows) == 1).select(*(joined[c] for c in docs.columns))
    # Only classes of several rows can repeat the row that stays: the smallest text, then the smallest hash of all columns.
    plain = [F.col(f"`{c}`") for c, t in docs.dtypes if "map<" not in t and "variant" not in t]
    row, order = fresh(joined, "row"), F.struct(utf8(text_col), F.xxhash64(*plain))
    again = joined.where(F.col(n_rows) > 1).groupBy(key).agg(F.min_by(F.struct(*(joined[c] for c in docs.columns)), order).alias(row)).select(f"{row}.*")
    empty = keyed.where(F.col(key).isNull()).select(*docs.columns)
    return once.unionByName(again).unionByName(empty)
