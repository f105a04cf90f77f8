"""Operator 2, benchmark decontamination: q-gram lemma filtering and banded alignment.

Benchmark items are normalised (lower case, single spaces) and cut into overlapping probes of ``PROBE`` characters, so any
shared passage of ``PROBE + STRIDE`` characters holds a whole probe; shorter items are a probe of their own.  A region of a
text within ``k`` edits of a probe of ``m`` characters shares at least ``m - q + 1 - q * k`` of its q-grams (q-gram lemma),
and they lie within a band of k diagonals.  Three filters follow from it, each necessary, so none loses a match:

1. all texts' q-grams are looked up in a table of all probes' q-grams; windows with too few hits are dropped;
2. in the windows left, hits are counted by probe and by overlapping diagonal bands; bands with too few are dropped;
3. the bands left are verified by a banded alignment of the whole probe, free at both ends of the text.

Equal probes are one, and a text that repeats itself is cheap: hits are counted in slices of the text, each with the overlap
that a band needs, and equal stretches of text are aligned with a probe once.

Probes go to the tasks in blocks of about ``BLOCK`` characters, each a pass over the texts; of several blocks each pass is
written before the next one's probes are broadcast, so tasks and driver hold one block whatever the benchmark's size.

Defined results: null and empty texts match nothing; null and empty items, and items shorter than ``SHORTEST`` characters, match
nothing; repeated items count once each; an empty benchmark or table gives no matches; very long texts are taken in
overlapping pieces; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.llm.common import cut, fresh, id_and_text, keeps, small_batches, use, utf8

Q, PROBE, STRIDE, SHORTEST = 10, 100, 50, 40
#: Edits as a share of a probe's length, diagonals of a band, characters of probes in a block, and of text at once.
EDITS, BAND, BLOCK, PIECE = 0.06, 16, 4_000_000, 1_000_000
#: Hits that are counted at once, about, and bands that are aligned at once.
HITS, ALIGNED = 1 << 20, 512
_BITS = 22
_SEP = 0x110000


def normalise(text: bytes) -> np.ndarray:
    """Lower case, single spaces, as code points."""
    return np.frombuffer(" ".join(text.decode("utf-8", "replace").lower().split()).encode("utf-32-le", "replace"), np.uint32)


def edits(m: int) -> int:
    return int(EDITS * m)


def least(m: int) -> int:
    """Shared q-grams that the lemma asks of a probe of ``m`` characters."""
    return m - Q + 1 - Q * edits(m)


def qgrams(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each q-gram, by doubling."""
    with np.errstate(over="ignore"):
        p, h, width = np.uint64(0x9E3779B97F4A7C15), x.astype(np.uint64), 1
        parts = {1: h}
        power = {1: p}
        while width * 2 <= Q:
            h = parts[width]
            parts[width * 2] = h[:-width] * power[width] + h[width:] if len(h) > width else h[:0]
            power[width * 2] = power[width] * power[width]
            width *= 2
        have, out = width, parts[width]
        while have < Q:
            w = max(k for k in parts if have + k <= Q)
            tail = parts[w][have : have + max(0, len(x) - have - w + 1)]
            out = out[: len(tail)] * power[w] + tail
            have += w
        return out


class Probes:
    """A block of probes with the table of their q-grams."""

    def __init__(self, items: list[tuple[int, bytes]]):
        #: Of each distinct probe: its text, and the items and places it comes from.
        self.text: list[np.ndarray] = []
        self.homes: list[list[tuple[int, int]]] = []
        number: dict[bytes, int] = {}
        for item, raw in items:
            x = normalise(raw)
            if len(x) < SHORTEST:
                continue
            starts = [0] if len(x) <= PROBE else [*range(0, len(x) - PROBE, STRIDE), len(x) - PROBE]
            for s in starts:
                t = x[s : s + PROBE]
                k = number.setdefault(t.tobytes(), len(number))
                if k == len(self.text):
                    self.text.append(t)
                    self.homes.append([])
                self.homes[k].append((item, s))
        grams = [qgrams(t) for t in self.text]
        flat = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams]) if grams else np.zeros(0, int)
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, int)
        order = np.argsort(flat, kind="stable")
        self.gram, self.owner, self.place = flat[order], owner[order], place[order]
        self.bits = np.zeros(1 << _BITS, np.uint8)
        self.bits[(self.gram >> np.uint64(64 - _BITS)).astype(np.int64)] = 1
        self.needs = np.array([least(len(t)) for t in self.text], np.int64)
        self.need = int(self.needs.min(initial=1 << 30))
        self.span = max((len(t) - Q + 1 + edits(len(t)) for t in self.text), default=1)

    def regions(self, x: np.ndarray) -> list[tuple[int, int]]:
        """Filter 1: stretches of q-gram positions, each window of which that matters has enough hits."""
        h = qgrams(x)
        if len(h) < self.need or not self.text:
            return []
        hit = self.bits[(h >> np.uint64(64 - _BITS)).astype(np.int64)]
        total = np.concatenate(([0], np.cumsum(hit, dtype=np.int32)))
        span = min(self.span, len(hit))
        full = np.flatnonzero(total[span:] - total[:-span] >= self.need)
        if not len(full):
            return []
        breaks = np.flatnonzero(np.diff(full) > span)
        return [(int(a), int(b) + span) for a, b in zip(full[np.r_[0, breaks + 1]], full[np.r_[breaks, len(full) - 1]], strict=True)]

    def bands(self, x: np.ndarray, a: int, b: int, wanted: np.ndarray) -> Iterator[list[tuple[int, int, int]]]:
        """Filter 2: (probe, lowest and highest diagonal) of the bands with enough hits among positions a to b, slice by slice.

        Probes that are no longer ``wanted`` when a slice is taken are left out.
        """
        h = qgrams(x[a : b + Q - 1])
        lo = np.searchsorted(self.gram, h, "left")
        n = np.searchsorted(self.gram, h, "right") - lo
        width = BAND + edits(PROBE)
        # The hits of a band of diagonals lie within its width and a probe's length, so slices that overlap by this have all.
        reach = width + PROBE
        before = np.concatenate(([0], np.cumsum(n)))
        last: set[tuple[int, int]] = set()
        i = 0
        while i < len(h):
            j = max(i + 2 * reach, int(np.searchsorted(before, before[i] + HITS, "right")) - 1)
            j = len(h) if j + reach >= len(h) else j
            now = self._slice(lo[i:j], n[i:j], a + i, wanted, width)
            yield [(p, g * BAND, g * BAND + width) for g, p in sorted(now - last)]
            last, i = now, j if j == len(h) else j - reach

    def _slice(self, lo: np.ndarray, n: np.ndarray, a: int, wanted: np.ndarray, width: int) -> set[tuple[int, int]]:
        """(band, probe) of the bands with enough hits at the positions from ``a`` on."""
        found: set[tuple[int, int]] = set()
        at = np.flatnonzero(n)
        k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n[at]) - n[at], n[at]) + np.repeat(lo[at], n[at])
        position = np.repeat(at + a, n[at])
        open_ones = wanted[self.owner[k]]
        if not open_ones.all():
            k, position = k[open_ones], position[open_ones]
        if not len(k):
            return found
        owner, place = self.owner[k].astype(np.int64), self.place[k].astype(np.int64)
        diagonal = position - place
        # A band of BAND + k diagonals for each multiple of BAND: any k diagonals lie in one of them.
        base = diagonal // BAND
        first = int(base.min()) - 1
        count = int(base.max()) - first + 1
        codes = []
        for shift in (0, 1):
            band = base - shift
            inside = np.flatnonzero(diagonal < band * BAND + width)
            codes.append((owner[inside] * count + band[inside] - first) * PROBE + place[inside])
        # A probe's q-gram counts once in a band, wherever else in it the text repeats it.
        once = np.unique(np.concatenate(codes)) // PROBE
        new = np.flatnonzero(np.r_[True, once[1:] != once[:-1]])
        keys, hits = once[new], np.diff(np.r_[new, len(once)])
        good = keys[hits >= self.needs[keys // count]]
        found.update(zip((good % count + first).tolist(), (good // count).tolist(), strict=True))
        return found

    def align(self, x: np.ndarray, probes: list[int], low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Filter 3: fewest edits between each whole probe (of one length) and any stretch of text in its band, and where it ends.

        Row i of a table has the cells of text ends low + i on, as many as the band is wide; leaving the band costs more
        than the budget.
        """
        p = np.stack([self.text[k] for k in probes])
        m, k = p.shape[1], edits(p.shape[1])
        width = BAND + edits(PROBE) + 2 * k + 1
        low, far = np.asarray(low)[:, None] - k, m + 1
        step = np.arange(width, dtype=np.int32)[None, :]
        ends = low + step
        row = np.where((ends >= 0) & (ends <= len(x)), 0, far).astype(np.int32)
        padded = np.concatenate((np.full(1, _SEP, np.uint32), x, np.full(1, _SEP, np.uint32)))
        edge = np.full((len(p), 1), far, np.int32)
        for i in range(1, m + 1):
            end = ends + i
            ok = (end >= 1) & (end <= len(x))
            best = np.where(ok, row + (padded[np.clip(end, 0, len(x) + 1)] != p[:, i - 1 : i]), far)
            best = np.minimum(best, np.concatenate((row[:, 1:], edge), axis=1) + 1)
            best = np.minimum(best, np.minimum.accumulate(best - step, axis=1) + step)
            best[(end < 0) | (end > len(x))] = far
            row = best.astype(np.int32)
        j = row.argmin(axis=1)
        return row[np.arange(len(p)), j], low[:, 0] + m + j

    def matches(self, x: np.ndarray, any_one: bool = False) -> dict[int, tuple[int, int, int, int]]:
        """Item -> (fewest edits, end in the normalised text, start of the probe, its length) of a text.

        A probe found without an edit is looked for no further, and with ``any_one`` none once an item is found.
        """
        out: dict[int, tuple[int, int, int, int]] = {}
        wanted = np.ones(len(self.text), bool)
        step = PIECE - 4 * (PROBE + BAND)
        for begin in range(0, max(1, len(x) - 4 * (PROBE + BAND)), step):
            piece = x[begin : begin + PIECE]
            seen: dict[tuple[int, bytes], tuple[int, int]] = {}
            for a, b in self.regions(piece):
                for bands in self.bands(piece, a, b, wanted):
                    for i in range(0, len(bands), ALIGNED):
                        some = [x for x in bands[i : i + ALIGNED] if wanted[x[0]]]
                        for (probe, _, _), (n, end) in zip(some, self._aligned(piece, some, seen), strict=True):
                            if n <= edits(len(self.text[probe])):
                                for item, start in self.homes[probe]:
                                    got = (n, begin + end, start, len(self.text[probe]))
                                    out[item] = min(out.get(item, got), got)
                                wanted[probe] = n > 0
                        if any_one and out:
                            return out
                    if len(seen) > 1 << 16:
                        seen.clear()
        return out

    def _aligned(self, piece: np.ndarray, bands: list[tuple[int, int, int]], seen: dict[tuple[int, bytes], tuple[int, int]]) -> list[tuple[int, int]]:
        """Edits and end for each band; ``seen`` has them, from the band's diagonal, by probe and stretch of text."""
        margin, keys, todo = 2 * edits(PROBE) + 1, [], {}
        for probe, low, high in bands:
            first, last = low - margin, high + len(self.text[probe]) + margin
            # At the ends of the text the place counts too.
            key = (probe, piece[first:last].tobytes() if first >= 0 and last <= len(piece) else str(low).encode())
            keys.append((key, low))
            if key not in seen:
                todo.setdefault(key, low)
        for m in {len(self.text[p]) for p, _ in todo}:
            some = [(key, low) for key, low in todo.items() if len(self.text[key[0]]) == m]
            n, end = self.align(piece, [p for (p, _), _ in some], np.array([low for _, low in some]))
            seen.update((key, (int(u), int(v) - low)) for (key, low), u, v in zip(some, n, end, strict=True))
        return [(seen[key][0], low + seen[key][1]) for key, low in keys]

    def candidates(self, texts: list[np.ndarray]) -> list[int]:
        """Texts of a batch with a region, found in one pass over all of them."""
        sizes = np.array([len(t) for t in texts])
        sep = np.full(1, _SEP, np.uint32)
        x = np.concatenate([y for t in texts for y in (t, sep)]) if texts else sep
        first = np.cumsum(sizes + 1) - sizes - 1
        found: set[int] = set()
        for a, b in self.regions(x):
            i, j = np.searchsorted(first, [a, b + Q], "right") - 1
            found.update(range(max(0, int(i)), int(j) + 1))
        return sorted(found)


_BLOCKS: dict[str, Probes] = {}
keeps("probes", _BLOCKS)


def _probes(shared, tag: str) -> Probes:
    use("probes")
    if tag not in _BLOCKS:
        _BLOCKS.clear()
        _BLOCKS[tag] = Probes(shared.value)
    return _BLOCKS[tag]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[tuple[list[tuple[int, bytes]], bool]]:
    """The items in blocks of about BLOCK characters (a longer item is a block), one at a time on the driver; whether there are several."""
    items = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("item_id"), utf8(text_col).alias("text")).where("item_id is not null and length(text) > 0")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // BLOCK))
    for k in range(n):
        mine = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [(r.item_id, bytes(r.text)) for r in mine.orderBy("item_id", "text").collect()], n > 1


MATCHES = "doc_id long, item_id long, edits int, probe_start int, probe_length int, text_end long"


def _share(docs: DataFrame, items: list) -> tuple:
    """The items as a broadcast, and a name that no other broadcast of any application has."""
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(items)
    return shared, f"{context.applicationId}-{shared._jbroadcast.id()}"


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row for each text and benchmark item that it holds a passage of, within the edit budget: ``MATCHES``."""
    texts, out = id_and_text(docs, id_col, text_col), None
    for items, more in _blocks(benchmark, item_col, item_text_col):
        shared, tag = _share(docs, items)

        def run(batches, shared=shared, tag=tag):
            probes = _probes(shared, tag)
            for b in small_batches(batches, 2 << 20):
                ids, norm = b.column("doc_id").to_pylist(), [normalise(t) for t in b.column("text").to_pylist()]
                rows = [(ids[i], item, n, start, length, end) for i in probes.candidates(norm) if i < len(ids) for item, (n, end, start, length) in sorted(probes.matches(norm[i]).items())]
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in MATCHES.split(", ")])

        found = texts.mapInArrow(run, MATCHES)
        if more:
            found = cut(found, "leaks")
            shared.destroy()
        out = found if out is None else out.unionByName(found)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text holds no passage of the benchmark, all columns as they were; no shuffle."""
    for items, more in _blocks(benchmark, item_col, item_text_col):
        shared, tag = _share(docs, items)
        name = fresh(docs, "__utf8")

        def run(batches, shared=shared, tag=tag, name=name):
            probes = _probes(shared, tag)
            for b in small_batches(batches, 2 << 20):
                norm = [normalise(t) for t in b.column(name).to_pylist()]
                bad = {i for i in probes.candidates(norm) if i < len(norm) and probes.matches(norm[i], any_one=True)}
                yield b.filter(pa.array([i not in bad for i in range(len(norm))])).select([c for c in b.schema.names if c != name])

        docs = docs.withColumn(name, utf8(text_col)).mapInArrow(run, docs.schema)
        if more:
            docs = cut(docs, "clean")
            shared.destroy()
    return docs
