"""Sums of products of two items' cells for all pairs of items, by blocks of matrices.

A long table of cells (item, along, value) is dealt by hash into blocks of about ``BLOCK`` items (more where they have few places) and
chunks of about ``CHUNK`` places, an item's cells as one row; a group is one pair of blocks and one chunk, its sums are matrix products, and groups of one pair of blocks are added up.
So N items over V places move N * V * N / BLOCK cells instead of one row for each pair and place, whatever key is frequent,
and a group holds 2 * BLOCK * CHUNK cells at most.

Where cells only say yes or no and places are few, ``counts`` does the same by words of bits in generated code: a pair costs a few
machine instructions and no call of Python, and N items move N * N / RANGE * 2 words for each feature.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandflow.lineage import cut

#: Items of a block, and places of a chunk, on average.
BLOCK, CHUNK = 256, 4096


#: A block has up to so many times ``BLOCK`` items where items have few places: with a row for each pair, and without.
WIDE, WIDEST = 4, 16

#: Words of 64 places that ``counts`` goes by at most, items of one of its ranges, and pairs of a task, on average.
WORDS, RANGE, TASK = 4, 2048, 1 << 24


def products(x: DataFrame, item: str, along: str, value: str, features: dict[str, Callable[[np.ndarray], np.ndarray]], wanted: dict[str, tuple[str, str]], by: tuple[str, ...] = (), diagonal: bool = False) -> DataFrame:
    """by, i, j (i < j, or i <= j) and the sums over ``along`` of a feature of i's cell times one of j's, for each of ``wanted``.

    A feature is a function of a matrix of cells, nan where a value is null or a row is not there; an (item, along) has one row.
    """
    rows, chunks = _blocks(x, item, along, value, by, WIDE)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        items, own, made, _ = _matrices(pdf, features)
        lo, hi = key[len(by)], key[len(by) + 1]
        a = np.flatnonzero(own == lo)
        b = a if lo == hi else np.flatnonzero(own == hi)
        forth = items[a][:, None] < items[b][None, :]
        if lo == hi:
            keep = np.triu(np.ones((len(a), len(a)), bool), 0 if diagonal else 1)
        else:
            keep = np.ones(forth.shape, bool)
        r, c = np.nonzero(keep)
        swap = ~forth[r, c] if lo != hi else np.zeros(len(r), bool)
        out = {name: v for name, v in zip(by, key, strict=False)}
        one, two = items[a][r], items[b][c]
        out |= {"i": np.where(swap, two, one), "j": np.where(swap, one, two)}
        for name, (left, right) in wanted.items():
            sums = (made[left][a] @ made[right][b].T)[r, c]
            if left != right and lo != hi:
                sums = np.where(swap, (made[right][a] @ made[left][b].T)[r, c], sums)
            out[name] = sums
        return pd.DataFrame(out, index=np.arange(len(r)))

    kind = dict(x.dtypes)
    schema = ", ".join([*(f"`{c}` {kind[c]}" for c in by), f"i {kind[item]}", f"j {kind[item]}", *(f"{n} double" for n in wanted)])
    parts = rows.groupBy(*by, "lo", "hi", "chunk").applyInPandas(run, schema)
    # Over one chunk a pair has one row already.
    return parts if chunks == 1 else parts.groupBy(*by, "i", "j").agg(*(F.sum(n).alias(n) for n in wanted))


def _blocks(x: DataFrame, item: str, along: str, value: str, by: tuple[str, ...] = (), wide: int = 1, carried: str | None = None) -> tuple[DataFrame, int]:
    """A row for each item, chunk and pair of blocks, with its places and values as arrays; and the number of chunks."""
    size = x.agg(F.approx_count_distinct(item).alias("items"), F.approx_count_distinct(along).alias("places")).first()
    chunks = max(1, math.ceil(size["places"] / CHUNK))
    blocks = max(1, math.ceil(size["items"] / (BLOCK * max(1, min(wide, CHUNK // max(1, size["places"]))))))
    rows = x.select(*by, F.col(item).alias("item"), F.col(along).alias("place"), F.col(value).cast("double").alias("value"), F.pmod(F.xxhash64(along), F.lit(chunks)).alias("chunk"), *([carried] if carried else []))
    cells = F.array_sort(F.collect_list(F.struct("place", F.coalesce("value", F.lit(float("nan"))).alias("value"))))
    rows = rows.where("item is not null and place is not null").groupBy(*by, "item", "chunk").agg(cells.alias("cells"), *([F.first(carried).alias(carried)] if carried else []))
    own, other = F.pmod(F.xxhash64("item"), F.lit(blocks)), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    rows = rows.select(*by, "item", "chunk", F.transform("cells", lambda c: c["place"]).alias("places"), F.transform("cells", lambda c: c["value"]).alias("values"), *([carried] if carried else []), own.alias("own")).withColumn("other", other)
    return rows.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")}).drop("other"), chunks


def _matrices(pdf: pd.DataFrame, features: dict) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray], pd.DataFrame]:
    """A group's items in order, their blocks, a matrix for each feature, and its rows in that order."""
    pdf = pdf.sort_values("item", kind="stable")
    places, to = np.unique(np.concatenate(pdf["places"].to_list()), return_inverse=True)
    cells = np.full((len(pdf), len(places)), np.nan)
    cells[np.repeat(np.arange(len(pdf)), pdf["places"].str.len()), to] = np.concatenate(pdf["values"].to_list())
    return pdf["item"].to_numpy(), pdf["own"].to_numpy(), {k: np.asarray(f(cells), float) for k, f in features.items()}, pdf


def reduced(x: DataFrame, item: str, along: str, value: str, features: dict, wanted: dict[str, tuple[str, str]], finish: Callable, schema: str, carried: str | None = None) -> DataFrame | None:
    """What ``finish`` makes of each slice of pairs of a group, so that pairs have no rows; None if places need several chunks.

    ``finish(items, a, b, once, sums, own)`` has all items of the group, the places of a's and b's among them, a matrix of what pairs count
    (each pair once in all), the sums as matrices, and the items' carried values.  The sums must be the same for (i, j) and (j, i).
    """
    rows, chunks = _blocks(x, item, along, value, (), WIDEST, carried)
    if chunks > 1:
        return None

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        items, own, made, pdf = _matrices(pdf, features)
        lo, hi = key
        all_a = np.flatnonzero(own == lo)
        b = all_a if lo == hi else np.flatnonzero(own == hi)
        out = []
        for k in range(0, len(all_a) if len(b) else 0, BLOCK):
            a = all_a[k : k + BLOCK]
            once = a[:, None] < b[None, :] if lo == hi else np.ones((len(a), len(b)), bool)
            out.append(finish(items, a, b, once, {n: made[l][a] @ made[r][b].T for n, (l, r) in wanted.items()}, pdf[carried].to_list() if carried else None))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})

    return rows.groupBy("lo", "hi").applyInPandas(run, schema)


def counts(x: DataFrame, item: str, along: str, features: dict[str, Column], wanted: dict[str, tuple[str, str]]) -> tuple[DataFrame, int] | None:
    """i, j (i < j) and how often a feature of i and one of j hold at the same place, for each of ``wanted``; and the number of places at most.

    A feature is a condition on a row; an (item, along) has one row.  None if there are no places, or more than ``WORDS`` words of them.
    """
    spark, kind = x.sparkSession, dict(x.dtypes)
    x = x.where(F.col(item).isNotNull() & F.col(along).isNotNull())
    places = [r[0] for r in x.select(along).distinct().limit(64 * WORDS + 1).collect()]
    if not 0 < len(places) <= 64 * WORDS:
        return None
    items = x.agg(F.approx_count_distinct(item)).first()[0]
    signed = lambda k: (1 << k) - (1 << 64 if k == 63 else 0)
    bits = spark.createDataFrame([(p, k // 64, signed(k % 64)) for k, p in enumerate(places)], f"`{along}` {kind[along]}, word int, bit long")
    words = range(-(-len(places) // 64))
    held = lambda f, w: F.coalesce(F.bit_or(F.when(f & (F.col("word") == w), F.col("bit"))), F.lit(0).cast("long"))
    packed = x.join(F.broadcast(bits), along).groupBy(F.col(item).alias("item")).agg(*(held(f, w).alias(f"{n}_{w}") for n, f in features.items() for w in words))
    names = [c for c in packed.columns if c != "item"]
    # Blocks are ranges of items, so the first block's are the smaller of a pair; numbered by sampled bounds, so written before they are read twice.
    blocks = max(1, math.ceil(items / RANGE), min(32, math.ceil(items / 64)))
    ranges = packed.repartitionByRange(blocks, "item").withColumn("block", F.spark_partition_id())
    ranges = cut(ranges.repartition(min(32, blocks), "block").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("item", *names))).alias("cells")), "ranges")
    last = ranges.agg(F.max("block")).first()[0] or 0
    group = lambda lo, hi: (lo.cast("long") * (last + 1) + hi).alias("group")
    tasks = min((last + 1) * (last + 2) // 2, max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(items * items / 2 / TASK)))
    # Items of the first block are rows, those of the second an array: what a row's pairs take in memory stays small.
    one = ranges.select("block", F.explode("cells").alias("c")).select("block", "c.*").select("item", *names, F.explode(F.sequence("block", F.lit(last))).alias("hi"), "block")
    one = one.select(group(F.col("block"), F.col("hi")), F.col("item").alias("i"), *(F.col(c).alias(f"i_{c}") for c in names))
    two = ranges.select("block", *(F.col("cells")[c].alias(c) for c in ["item", *names])).select("*", F.explode(F.sequence(F.lit(0), "block")).alias("lo"))
    two = two.select(group(F.col("lo"), F.col("block")), *(F.col(c).alias(f"j_{c}") for c in ["item", *names]))
    pairs = one.repartition(tasks, "group").hint("merge").join(two.repartition(tasks, "group"), "group")
    pairs = pairs.select("i", *(f"i_{c}" for c in names), *(f"j_{c}" for c in names), F.posexplode("j_item").alias("at", "j")).where(F.col("i") < F.col("j"))
    both = lambda l, r, w: F.bit_count(F.col(f"i_{l}_{w}").bitwiseAND(F.get(F.col(f"j_{r}_{w}"), F.col("at"))))
    return pairs.select("i", "j", *(sum((both(l, r, w) for w in words[1:]), both(l, r, 0)).alias(n) for n, (l, r) in wanted.items())), 64 * len(words)


def called(cells: np.ndarray) -> np.ndarray:
    return ~np.isnan(cells)


def moments(x: DataFrame, item: str, along: str, value: str, by: tuple[str, ...] = (), diagonal: bool = False) -> DataFrame:
    """by, i, j, n and the sums of both values, their squares and their product, over places where both have one."""
    features = {"m": called, "x": lambda c: np.nan_to_num(c), "xx": lambda c: np.nan_to_num(c * c)}
    wanted = {"n": ("m", "m"), "sa": ("x", "m"), "sb": ("m", "x"), "saa": ("xx", "m"), "sbb": ("m", "xx"), "sab": ("x", "x")}
    return products(x.where(F.col(value).isNotNull()), item, along, value, features, wanted, by, diagonal).where("n > 0")


def genotype_pairs(g: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, v1, v2 and n00 to n22: samples by both variants' dosages."""
    features = {str(d): (lambda c, d=d: c == d) for d in range(3)}
    wanted = {f"n{p}{q}": (str(p), str(q)) for p in range(3) for q in range(3)}
    x = products(g.where("dosage is not null"), "vid", "sample_id", "dosage", features, wanted, by)
    return x.withColumnsRenamed({"i": "v1", "j": "v2"}).where(" + ".join(wanted) + " > 0")


def cells_of(x: DataFrame, first: str, second: str, n: str) -> DataFrame:
    """A row for each of n00 to n22 that isn't 0."""
    keys = [c for c in x.columns if not (len(c) == 3 and c[0] == "n" and c[1:].isdigit())]
    each = F.array(*(F.struct(F.lit(p).alias(first), F.lit(q).alias(second), F.col(f"n{p}{q}").alias(n)) for p in range(3) for q in range(3)))
    return x.select(*keys, F.explode(each).alias("c")).select(*keys, "c.*").where(F.col(n) > 0)


def label_sums(g: DataFrame, labels: DataFrame) -> DataFrame:
    """rep, vid, x, n, all_x, all_n: dosages and calls summed over the samples that a replicate labels true, and over all.

    ``labels`` is (rep, sample_id, label) with a row for every replicate and sample; a null label is false.  Samples meet a block of
    variants with all their labels as one row, so no row is made for a call and a replicate.
    """
    g = g.where("dosage is not null").select("vid", "sample_id", F.col("dosage").cast("double").alias("dosage"))
    size = g.agg(F.approx_count_distinct("vid").alias("items"), F.approx_count_distinct("sample_id").alias("places")).first()
    blocks, chunks = max(1, math.ceil(size["items"] / BLOCK)), max(1, math.ceil(size["places"] / CHUNK))
    chunk = F.pmod(F.xxhash64(F.col("sample_id").cast("long")), F.lit(chunks)).alias("chunk")
    cells = g.select("vid", "sample_id", "dosage", F.pmod(F.xxhash64("vid"), F.lit(blocks)).alias("block"), chunk)
    drawn = F.array_sort(F.collect_list(F.struct("rep", F.coalesce(F.col("label").cast("double"), F.lit(0.0)).alias("label"))))
    packed = labels.groupBy("sample_id").agg(drawn.alias("drawn")).select("sample_id", F.transform("drawn", lambda d: d["rep"]).alias("reps"), F.transform("drawn", lambda d: d["label"]).alias("labels"), chunk, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left[left["sample_id"].isin(right["sample_id"])]
        if not len(left):
            return pd.DataFrame({c: [] for c in ("rep", "vid", "x", "n", "all_x", "all_n")})
        who = pd.Index(right["sample_id"])
        vids, at = np.unique(left["vid"].to_numpy(), return_inverse=True)
        to = who.get_indexer(left["sample_id"])
        dose, call = np.zeros((len(vids), len(who))), np.zeros((len(vids), len(who)))
        dose[at, to], call[at, to] = left["dosage"].to_numpy(float), 1
        reps, drawn = np.asarray(right["reps"].iloc[0]), np.stack(right["labels"].to_list()).astype(float)
        k, each = len(reps), lambda m: np.repeat(m.sum(axis=1), len(reps))
        return pd.DataFrame({"rep": np.tile(reps, len(vids)), "vid": np.repeat(vids, k), "x": (dose @ drawn).ravel(), "n": (call @ drawn).ravel(), "all_x": each(dose), "all_n": each(call)})

    kind = dict(g.dtypes)
    parts = cells.groupBy("block", "chunk").cogroup(packed.groupBy("block", "chunk")).applyInPandas(run, f"rep int, vid {kind['vid']}, x double, n double, all_x double, all_n double")
    return parts.groupBy("rep", "vid").agg(*(F.sum(c).alias(c) for c in ("x", "n", "all_x", "all_n")))
