"""Range joins in bins, merges with a conflict policy, matching, and pedigree joins.

A range join on positions becomes an equi-join on (chromosome, bin): a position has one bin, a range those that it
meets, and each pair is confirmed once.  No nested loop over all pairs, whatever the sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandflow.functions.stats import div, n_if


def range_join(points: DataFrame, ranges: DataFrame, width: int = 100_000, border: int = 0) -> DataFrame:
    """Each (chr, bp) row with each closed range (chr, start, stop), widened by a border, that holds it."""
    r = ranges.withColumns({"lo": F.col("start") - border, "hi": F.col("stop") + border})
    r = r.withColumn("bin", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width)))).withColumnRenamed("chr", "r_chr")
    p = points.withColumn("p_bin", F.floor(F.col("bp") / width))
    return p.join(r, (F.col("chr") == F.col("r_chr")) & (F.col("p_bin") == F.col("bin")) & F.col("bp").between(F.col("lo"), F.col("hi"))).drop("r_chr", "p_bin", "bin", "lo", "hi")


def overlap_join(a: DataFrame, b: DataFrame, width: int = 100_000) -> DataFrame:
    """Pairs of segments (chr, bp1, bp2) that meet, b's columns with ``b_`` before, with the length of the meeting.

    A pair may share many bins and is kept only in the bin in which the meeting begins.
    """
    bins = lambda x, lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width)))
    y = b.select(*(F.col(c).alias(f"b_{c}") for c in b.columns))
    y = y.withColumn("b_bin", bins(y, "b_bp1", "b_bp2"))
    x = a.withColumn("bin", bins(a, "bp1", "bp2"))
    meet = x.join(y, (F.col("chr") == F.col("b_chr")) & (F.col("bin") == F.col("b_bin")) & (F.col("bp1") <= F.col("b_bp2")) & (F.col("b_bp1") <= F.col("bp2")))
    first = F.floor(F.greatest("bp1", "b_bp1") / width)
    return meet.where(F.col("bin") == first).drop("bin", "b_bin").withColumn("meet", F.least("bp2", "b_bp2") - F.greatest("bp1", "b_bp1") + 1)


def overlap_totals(a: DataFrame, b: DataFrame, key: str = "seg_id", width: int = 100_000) -> DataFrame:
    """key, n, meet: how many segments of b each of a's meets, and the meetings' summed length, without a row for each pair.

    A segment [p, q] meets what begins by q less what has ended before p, and as much as b covers up to q less up to p - 1.
    Counts and sums of begins and ends run along each bin of a chromosome, on top of the totals of the bins before.
    """
    parts = ("n1", "s1", "n2", "s2")
    event = lambda c, first: b.select("chr", F.col(c).cast("long").alias("x"), *(F.lit(v).cast("long").alias(k) if v is not None else F.col(c).cast("long").alias(k) for k, v in zip(parts, (1, None, 0, 0) if first else (0, 0, 1, None), strict=True)))
    events = event("bp1", True).unionByName(event("bp2", False)).groupBy("chr", "x").agg(*(F.sum(k).alias(k) for k in parts))
    nothing = [F.lit(0).cast("long").alias(k) for k in parts]
    asks = a.select("chr", F.col("bp2").cast("long").alias("x"), *nothing, F.col(key), F.lit(1).alias("sign")).unionByName(a.select("chr", (F.col("bp1") - 1).cast("long").alias("x"), *nothing, F.col(key), F.lit(-1).alias("sign")))
    rows = events.unionByName(asks, allowMissingColumns=True).withColumn("bin", F.floor(F.col("x") / width))
    # One row for each bin of the genome: bounded by its length.
    before = Window.partitionBy("chr").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy("chr", "bin").agg(*(F.sum(k).alias(k) for k in parts)).select("chr", "bin", *(F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"c_{k}") for k in parts))
    so_far = Window.partitionBy("chr", "bin").orderBy("x").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    at = rows.select("chr", "bin", "x", key, "sign", *(F.sum(k).over(so_far).alias(k) for k in parts)).where("sign is not null").join(carried, ["chr", "bin"])
    n1, s1, n2, s2 = (F.col(k) + F.col(f"c_{k}") for k in parts)
    covered = n1 * (F.col("x") + 1) - s1 - (n2 * F.col("x") - s2)
    return at.groupBy(key).agg(F.sum(F.when(F.col("sign") > 0, n1).otherwise(-n2)).alias("n"), F.sum(F.col("sign") * covered).alias("meet")).where("n > 0")


def overlap_counts(a: DataFrame, b: DataFrame, key: list[str], counts: dict[str, Column], width: int = 100_000) -> DataFrame:
    """key and sums of b's columns ``counts`` over the rows of b that meet each range of a (chr, bp1, bp2), without a row for each pair.

    What meets [p, q] has begun by q, less what has ended before p; sums run along each bin on top of the totals of the bins before.
    A range that meets no row is out; one whose end comes before its begin meets nothing, on either side.
    """
    names = ["_rows", *counts]
    values = [F.lit(1).cast("long"), *(c.cast("long") for c in counts.values())]
    b = b.where("bp1 <= bp2").select("chr", "bp1", "bp2", *(v.alias(n) for n, v in zip(names, values, strict=True)))
    event = lambda x, sign: b.select("chr", x.cast("long").alias("x"), *((sign * F.col(n)).alias(n) for n in names))
    # An end counts from the next position on.
    events = event(F.col("bp1"), 1).unionByName(event(F.col("bp2") + 1, -1))
    begun = events.where("_rows > 0").groupBy("chr", "x").agg(*(F.sum(n).alias(n) for n in names)).withColumn("begin", F.lit(True))
    ended = events.where("_rows < 0").groupBy("chr", "x").agg(*(F.sum(n).alias(n) for n in names)).withColumn("begin", F.lit(False))
    nothing = [F.lit(0).cast("long").alias(n) for n in names]
    a = a.where("bp1 <= bp2")
    ask = lambda x, begin: a.select("chr", F.col(x).cast("long").alias("x"), *nothing, F.lit(begin).alias("begin"), *key, F.lit(True).alias("_ask"))
    rows = begun.unionByName(ended).unionByName(ask("bp2", True).unionByName(ask("bp1", False)), allowMissingColumns=True).withColumn("bin", F.floor(F.col("x") / width))
    # One row for each bin of the genome: bounded by its length.
    before = Window.partitionBy("chr", "begin").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy("chr", "begin", "bin").agg(*(F.sum(n).alias(n) for n in names)).select("chr", "begin", "bin", *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"c_{n}") for n in names))
    so_far = Window.partitionBy("chr", "begin", "bin").orderBy("x").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    at = rows.select("chr", "begin", "bin", *key, "_ask", *(F.sum(n).over(so_far).alias(n) for n in names)).where("_ask").join(carried, ["chr", "begin", "bin"])
    return at.groupBy(*key).agg(*(F.sum(F.col(n) + F.col(f"c_{n}")).alias(n) for n in names)).where("_rows > 0").drop("_rows")


def overlap_share(kind: str = "default") -> Column:
    """Share of a meeting: of the segment (default), of both together (union), or of the region."""
    own, other = F.col("bp2") - F.col("bp1") + 1, F.col("b_bp2") - F.col("b_bp1") + 1
    return div(F.col("meet"), {"default": own, "region": other, "union": own + other - F.col("meet")}[kind])


def radius_join(points: DataFrame, centres: DataFrame, radius: int) -> DataFrame:
    """Points within a radius of a range (chr, start, stop, name): the cis window."""
    return range_join(points, centres, width=max(1, radius), border=radius)


def first_match(joined: DataFrame, key: str, order: str) -> DataFrame:
    """The first match of each key by an order."""
    rest = [c for c in joined.columns if c not in (key, order)]
    return joined.groupBy(key).agg(F.min(F.struct(order, *rest)).alias("x")).select(key, "x.*")


def gene_report(results: DataFrame, ranges: DataFrame, border: int = 0, most_p: float | None = None) -> DataFrame:
    """Result rows (chr, bp, p) by the ranges that hold them."""
    x = results if most_p is None else results.where(F.col("p") <= most_p)
    return range_join(x, ranges, border=border)


def annotate(results: DataFrame, ranges: DataFrame, border: int = 0) -> DataFrame:
    """Each result row with the names of its ranges, sorted and joined by a bar, or a dot."""
    names = range_join(results.select("vid", "chr", "bp"), ranges, border=border).groupBy("vid").agg(F.array_join(F.array_sort(F.collect_set("name")), "|").alias("annot"))
    return results.join(names, "vid", "left").withColumn("annot", F.coalesce("annot", F.lit(".")))


def merge(old: DataFrame, new: DataFrame, mode: int) -> DataFrame:
    """Both tables' calls under a merge mode.

    1 consensus: keep what one lacks, missing where both differ; 2 fill what the old lacks; 3 take the new unless it lacks;
    4 keep the old; 5 take the new.  Calls that only one table has are taken as they are.
    """
    x = old.select("sample_id", "vid", F.col("dosage").alias("a"), F.lit(True).alias("in_a")).join(new.select("sample_id", "vid", F.col("dosage").alias("b"), F.lit(True).alias("in_b")), ["sample_id", "vid"], "full")
    a, b = F.col("a"), F.col("b")
    both = {1: F.when(b.isNull(), a).when(a.isNull(), b).when(a == b, a), 2: F.coalesce(a, b), 3: F.coalesce(b, a), 4: a, 5: b}[mode]
    return x.select("sample_id", "vid", F.when(F.col("in_b").isNull(), a).when(F.col("in_a").isNull(), b).otherwise(both).alias("dosage"))


def merge_diff(old: DataFrame, new: DataFrame, both_called: bool) -> DataFrame:
    """Merge modes 6 and 7: calls that differ, any (6) or where both are called (7)."""
    x = old.select("sample_id", "vid", F.col("dosage").alias("a")).join(new.select("sample_id", "vid", F.col("dosage").alias("b")), ["sample_id", "vid"])
    return x.where("a <> b" if both_called else "not (a <=> b)")


def merge_report(old: DataFrame, new: DataFrame, mode: int) -> DataFrame:
    """mode, n_calls, n_missing of a merge, or of a difference report."""
    x = merge(old, new, mode) if mode <= 5 else merge_diff(old, new, mode == 7).withColumn("dosage", F.col("a"))
    return x.agg(F.lit(mode).alias("mode"), F.count("*").alias("n_calls"), n_if(F.col("dosage").isNull()).alias("n_missing"))


def match_pairs(s: DataFrame, equal: list[str], unequal: list[str] = (), close: dict[str, float] | None = None) -> DataFrame:
    """i, j: unordered pairs of samples that agree in some columns, differ in others, and are close in numbers.

    ``equal`` makes it an equi-join; it must not be empty.
    """
    a, b = s.alias("a"), s.alias("b")
    cond = F.col("a.sample_id") < F.col("b.sample_id")
    for c in equal:
        cond = cond & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    for c in unequal:
        cond = cond & (F.col(f"a.{c}") != F.col(f"b.{c}"))
    for c, t in (close or {}).items():
        cond = cond & (F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) <= t)
    return a.join(b, cond).select(F.col("a.sample_id").alias("i"), F.col("b.sample_id").alias("j"))


def trios(s: DataFrame) -> DataFrame:
    """kid, father, mother: by two self-joins on family and parent; a parent who is not there is null."""
    ids = s.select(F.col("fid").alias("f"), F.col("iid").alias("p"), F.col("sample_id").alias("who"))
    x = s.select("fid", "pat", "mat", F.col("sample_id").alias("kid"))
    x = x.join(ids.select("f", "p", F.col("who").alias("father")), (F.col("fid") == F.col("f")) & (F.col("pat") == F.col("p")), "left").drop("f", "p")
    return x.join(ids.select("f", "p", F.col("who").alias("mother")), (F.col("fid") == F.col("f")) & (F.col("mat") == F.col("p")), "left").select("kid", "father", "mother")


def make_sets(v: DataFrame, ranges: DataFrame, border: int = 0) -> DataFrame:
    """set_name, vid from ranges."""
    return range_join(v, ranges.withColumnRenamed("name", "set_name"), border=border).select("set_name", "vid").distinct()


def set_complement(v: DataFrame, sets: DataFrame) -> DataFrame:
    """Variants that are in no set, as one set."""
    return v.join(sets, "vid", "left_anti").select(F.lit("COMPLEMENT").alias("set_name"), "vid")


def set_table(sets: DataFrame, names: list[str]) -> DataFrame:
    """vid and a 0/1 column for each set."""
    return sets.groupBy("vid").agg(*(F.max(F.when(F.col("set_name") == n, 1).otherwise(0)).alias(n) for n in names))
