"""Registered queries over whole tables, each with the DuckDB SQL that it is checked against where SQL can express it.

Doubles are rounded to six digits on both sides, as the engines sum in different orders; p-values to six significant ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.functions.stats import div, quick_round, six_digits
from strandflow.operators import assoc, family, filters, haplotypes, joins, models, network, pairs, permutation, ranking, recodes, relatives, segments, sets, summaries
from strandflow.plans import fixtures as fx

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


#: Columns of probabilities, which are rounded to six significant digits, however small they are.
_SMALL = {"p", "unadj", "gc", "bonf", "holm", "fdr_bh", "fdr_by"}


def rounded(df: DataFrame, digits: int = 6, many: bool = False) -> DataFrame:
    to_digits = quick_round if many else F.round
    short = lambda c: F.when(F.isnan(c), F.col(c)).otherwise(six_digits(F.col(c))) if c in _SMALL else to_digits(F.col(c), digits) + F.lit(0.0)
    return df.select(*(short(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def query(sql: str | None = None, doubles: str = "", digits: int = 6, many: bool = False):
    """Register a query; ``sql`` follows the fixtures' CTEs and may go on with its own; ``doubles`` are rounded, quickly where rows are many."""

    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf: rounded(f(spark, sf), digits, many)
        if sql:
            head, _, body = sql.rpartition(";;")
            short = lambda c: f"printf('%.5e', {c})::DOUBLE" if c in _SMALL else f"round({c}, {digits}) + 0.0::DOUBLE"
            replace = ", ".join(f"{short(c)} AS {c}" for c in doubles.split())
            SQL[f.__name__] = f"WITH {fx.CTE}{', ' + head if head else ''} SELECT *{f' REPLACE ({replace})' if replace else ''} FROM ({body}) x"
        return f

    return register


def _tail(x: str) -> str:
    """P(Z > |x|) by another way than the engine's: the tail's continued fraction from 1 on, the centre's series below."""
    z, density = f"abs({x})", f"(exp(-({x}) * ({x}) / 2.0) / sqrt(2 * pi()))"
    fraction = f"list_reduce(range(160, 0, -1)::DOUBLE[], lambda a, k: {z} + k / a)"
    series = f"list_reduce(range(61, 1, -2)::DOUBLE[], lambda a, k: 1 + ({x}) * ({x}) / k * a)"
    return f"(CASE WHEN {z} >= 1 THEN {density} / {fraction} ELSE 0.5 - {density} * {z} * {series} END)"


def _x2(a: str, b: str, c: str, d: str) -> str:
    return f"(({a})+({b})+({c})+({d}))::DOUBLE * pow(({a})::DOUBLE*({d}) - ({b})::DOUBLE*({c}), 2) / nullif((({a})+({b}))::DOUBLE * (({c})+({d})) * (({a})+({c})) * (({b})+({d})), 0)"


def _exact(a: str, b: str, c: str, d: str) -> str:
    """The two-sided exact p of a 2x2 table: the hypergeometric weights of all tables with its margins."""
    weight = f"-(lgamma(x + 1) + lgamma({a} + {b} - x + 1) + lgamma({a} + {c} - x + 1) + lgamma({d} - {a} + x + 1))"
    margins = "(" + " + ".join(f"lgamma({m} + 1)" for m in (f"{a} + {b}", f"{c} + {d}", f"{a} + {c}", f"{b} + {d}")) + f" - lgamma({a} + {b} + {c} + {d} + 1))"
    seen = "(" + weight.replace("x +", f"{a} +").replace("- x", f"- {a}") + ")"
    every = f"list_transform(range(greatest(0, {a} - {d}), least({a} + {b}, {a} + {c}) + 1), lambda x: {weight})"
    return f"least(1.0::DOUBLE, list_sum(list_transform(list_filter({every}, lambda w: w <= {seen} + 1e-9::DOUBLE), lambda w: exp(w + {margins}))))"


_N = lambda c: f"count(*) FILTER (WHERE {c})"
_ALLELES = "SELECT vid, CAST(sum(CASE WHEN aff THEN dosage ELSE 0 END) AS BIGINT) AS a1_aff, CAST(sum(CASE WHEN aff THEN 2 - dosage ELSE 0 END) AS BIGINT) AS a2_aff, CAST(sum(CASE WHEN aff THEN 0 ELSE dosage END) AS BIGINT) AS a1_unaff, CAST(sum(CASE WHEN aff THEN 0 ELSE 2 - dosage END) AS BIGINT) AS a2_unaff FROM g JOIN s USING (sample_id) WHERE dosage IS NOT NULL GROUP BY vid"
_CLUSTERS = _ALLELES.replace("SELECT vid", "SELECT vid, cluster").replace("GROUP BY vid", "GROUP BY vid, cluster")
_X2 = _x2("a1_aff", "a2_aff", "a1_unaff", "a2_unaff")
_ASSOC = f"al AS ({_ALLELES}), res AS (SELECT vid, {_X2} AS chisq FROM al)"


# Summaries


@query(f"al AS ({_ALLELES});;SELECT *, a1_aff / nullif(a1_aff + a2_aff, 0)::DOUBLE AS f_a, a1_unaff / nullif(a1_unaff + a2_unaff, 0)::DOUBLE AS f_u, chisq AS chisq, odds_ratio AS odds_ratio, 2 * {_tail('sqrt(chisq)')} AS p FROM (SELECT *, {_X2} AS chisq, a1_aff::DOUBLE * a2_unaff / nullif(a2_aff::DOUBLE * a1_unaff, 0) AS odds_ratio FROM al) y".replace(", chisq AS chisq, odds_ratio AS odds_ratio", ""), "f_a f_u chisq odds_ratio p")
def assoc_allelic(spark, sf):
    return assoc.allelic(fx.genotypes(spark, sf), fx.samples(spark, sf)).drop("se", "l95", "u95")


@query("SELECT vid, sum(dosage) / nullif(2 * count(dosage), 0)::DOUBLE AS freq, 2 * count(dosage) AS nchrobs FROM g GROUP BY vid", "freq")
def allele_freq(spark, sf):
    return summaries.allele_freq(fx.genotypes(spark, sf))


@query("SELECT vid, CAST(sum(dosage) AS BIGINT) AS c1, CAST(sum(2 - dosage) AS BIGINT) AS c2, count(*) FILTER (WHERE dosage IS NULL) AS g0 FROM g GROUP BY vid")
def allele_counts(spark, sf):
    return summaries.allele_counts(fx.genotypes(spark, sf))


@query("SELECT vid, cluster, coalesce(sum(dosage), 0) / nullif(2 * count(dosage), 0)::DOUBLE AS maf, CAST(coalesce(sum(dosage), 0) AS BIGINT) AS mac, 2 * count(dosage) AS nchrobs FROM g JOIN s USING (sample_id) GROUP BY vid, cluster", "maf")
def freq_by_cluster(spark, sf):
    return summaries.freq_by_cluster(fx.genotypes(spark, sf), fx.samples(spark, sf))


_HWE = f"""h AS (SELECT vid, CASE WHEN grouping(aff) = 1 THEN 'ALL' WHEN aff THEN 'AFF' ELSE 'UNAFF' END AS grp, {_N('dosage = 2')} AS hom1, {_N('dosage = 1')} AS het, {_N('dosage = 0')} AS hom2
 FROM g JOIN s USING (sample_id) GROUP BY GROUPING SETS ((vid), (vid, aff))),
hp AS (SELECT *, (hom1 + het + hom2)::DOUBLE AS n, (2 * hom1 + het) / nullif(2 * (hom1 + het + hom2), 0)::DOUBLE AS p FROM h),
hw AS (SELECT vid, grp, hom1, het, hom2, het / nullif(n, 0) AS o_het, 2 * p * (1 - p) AS e_het, pow(hom1 - n*p*p, 2) / nullif(n*p*p, 0) + pow(het - 2*n*p*(1-p), 2) / nullif(2*n*p*(1-p), 0) + pow(hom2 - n*(1-p)*(1-p), 2) / nullif(n*(1-p)*(1-p), 0) AS chisq FROM hp)"""


@query(f"{_HWE};;SELECT * FROM hw", "o_het e_het chisq")
def hwe_grouping_sets(spark, sf):
    return summaries.hwe(fx.genotypes(spark, sf), fx.samples(spark, sf))


_HWP = """hr AS (SELECT vid, grp, hom1, het, hom2, hom1 + het + hom2 AS n, 2 * least(hom1, hom2) + het AS r FROM hw),
hx AS (SELECT *, list_transform(range(r % 2, r + 1, 2), lambda h: h * ln(2::DOUBLE) - lgamma(h + 1) - lgamma((r - h) // 2 + 1) - lgamma(n - h - (r - h) // 2 + 1)) AS ws, het * ln(2::DOUBLE) - lgamma(het + 1) - lgamma((r - het) // 2 + 1) - lgamma(n - het - (r - het) // 2 + 1) AS seen FROM hr),
hm AS (SELECT *, list_max(ws) AS top FROM hx)"""


@query(f"{_HWE}, {_HWP};;SELECT vid, grp, hom1, het, hom2, least(1.0::DOUBLE, list_sum(list_transform(list_filter(ws, lambda w: w <= seen + 1e-11::DOUBLE), lambda w: exp(w - top))) / list_sum(list_transform(ws, lambda w: exp(w - top)))) AS p FROM hm", "p")
def hwe_exact(spark, sf):
    from strandflow.functions.stats import hwe_p

    h = summaries.hwe(fx.genotypes(spark, sf), fx.samples(spark, sf))
    return h.select("vid", "grp", "hom1", "het", "hom2", hwe_p(*(F.col(c).cast("double") for c in ("het", "hom1", "hom2"))).alias("p"))


for _key in ("sample_id", "vid"):

    def _missing(spark, sf, key=_key):
        return summaries.missing_by(fx.genotypes(spark, sf), key)

    _missing.__name__ = f"missing_by_{'sample' if _key == 'sample_id' else 'variant'}"
    query(f"SELECT {_key}, {_N('dosage IS NULL')} AS n_miss, count(*) AS n_geno, {_N('dosage IS NULL')} / count(*)::DOUBLE AS f_miss FROM g GROUP BY {_key}", "f_miss")(_missing)


_MISS = f"m AS (SELECT vid, {_N('dosage IS NULL AND aff')} AS miss_a, {_N('dosage IS NOT NULL AND aff')} AS call_a, {_N('dosage IS NULL AND NOT aff')} AS miss_u, {_N('dosage IS NOT NULL AND NOT aff')} AS call_u FROM g JOIN s USING (sample_id) GROUP BY vid)"


@query(f"{_MISS};;SELECT *, miss_a / nullif(miss_a + call_a, 0)::DOUBLE AS f_miss_a, miss_u / nullif(miss_u + call_u, 0)::DOUBLE AS f_miss_u FROM m", "f_miss_a f_miss_u")
def missing_case_control(spark, sf):
    return summaries.missing_case_control(fx.genotypes(spark, sf), fx.samples(spark, sf))


@query(f"{_MISS};;SELECT *, miss_a / nullif(miss_a + call_a, 0)::DOUBLE AS f_miss_a, miss_u / nullif(miss_u + call_u, 0)::DOUBLE AS f_miss_u, {_exact('miss_a', 'call_a', 'miss_u', 'call_u')} AS p FROM m", "f_miss_a f_miss_u p")
def missing_fisher(spark, sf):
    return summaries.missing_fisher(fx.genotypes(spark, sf), fx.samples(spark, sf))


_FREQ = "f AS (SELECT vid, sum(dosage) / nullif(2 * count(dosage), 0)::DOUBLE AS freq, 2 * count(dosage) AS nm FROM g GROUP BY vid)"
_HET = f"{_FREQ}, hz AS (SELECT sample_id, {_N('dosage <> 1')} AS o_hom, sum(1 - 2 * freq * (1 - freq) * nm / (nm - 1)::DOUBLE) AS e_hom, count(*) AS n FROM g JOIN f USING (vid) {{}} WHERE dosage IS NOT NULL AND nm > 1 AND freq > 1e-8 AND freq < 1 - 1e-8 {{}} GROUP BY sample_id)"


@query(_HET.format("", "") + ";;SELECT *, (o_hom - e_hom) / nullif(n - e_hom, 0) AS f FROM hz", "e_hom f")
def heterozygosity_f(spark, sf):
    return summaries.heterozygosity(fx.genotypes(spark, sf))


@query(_HET.format("JOIN v USING (vid)", "AND chr = 4") + ";;SELECT sample_id, pedsex, snpsex, CASE WHEN snpsex <> 0 AND snpsex = pedsex THEN 'OK' ELSE 'PROBLEM' END AS status, f FROM (SELECT s.sample_id, sex AS pedsex, CASE WHEN (o_hom - e_hom) / nullif(n - e_hom, 0) > 0.8 THEN 1 WHEN (o_hom - e_hom) / nullif(n - e_hom, 0) < 0.2 THEN 2 ELSE 0 END AS snpsex, (o_hom - e_hom) / nullif(n - e_hom, 0) AS f FROM s LEFT JOIN hz USING (sample_id)) y", "f")
def sex_check(spark, sf):
    return summaries.sex_check(fx.genotypes(spark, sf), fx.variants(spark, sf), fx.samples(spark, sf), 4)


@query("c AS (SELECT vid, cluster, sum(dosage)::DOUBLE AS a, 2.0::DOUBLE * count(dosage) AS n FROM g JOIN s USING (sample_id) GROUP BY vid, cluster HAVING count(dosage) > 0), t AS (SELECT vid, sum(a) / sum(n) AS p, sum(2 * (a/n) * (1 - a/n) * n) / sum(n) AS hs FROM c GROUP BY vid);;SELECT vid, (2*p*(1-p) - hs) / nullif(2*p*(1-p), 0) AS fst FROM t", "fst")
def fst(spark, sf):
    return summaries.fst(fx.genotypes(spark, sf), fx.samples(spark, sf))


@query("SELECT attr_id, avg(value) AS mean, var_samp(value) AS var, stddev_samp(value) AS sd, stddev_samp(value) / nullif(avg(value), 0) AS cv FROM num GROUP BY attr_id", "mean var sd cv", 4)
def numeric_summary(spark, sf):
    return summaries.numeric_summary(fx.numerics(spark, sf))


@query("r AS (SELECT sample_id, vid, dosage, row_number() OVER (PARTITION BY sample_id ORDER BY vid) AS i FROM g), m AS (SELECT sample_id, vid, i - row_number() OVER (PARTITION BY sample_id ORDER BY i) AS k FROM r WHERE dosage IS NULL);;SELECT sample_id, min(vid) AS start, max(vid) AS stop, count(*) AS n FROM m GROUP BY sample_id, k")
def missing_runs(spark, sf):
    return summaries.missing_runs(fx.genotypes(spark, sf), least=1)


@query("SELECT vid, dosage, count(*) AS n FROM g GROUP BY vid, dosage")
def level_counts(spark, sf):
    return summaries.level_counts(fx.genotypes(spark, sf))


# Filters and recodes


@query(f"""g1 AS (SELECT * FROM g WHERE sample_id IN (SELECT sample_id FROM g GROUP BY 1 HAVING {_N('dosage IS NULL')} <= 0.05 * count(*))),
g2 AS (SELECT * FROM g1 WHERE vid IN (SELECT vid FROM g1 GROUP BY 1 HAVING {_N('dosage IS NULL')} <= 0.04 * count(*))),
g3 AS (SELECT * FROM g2 WHERE vid IN (SELECT vid FROM g2 GROUP BY 1 HAVING least(sum(dosage) / (2.0 * count(dosage)), 1 - sum(dosage) / (2.0 * count(dosage))) >= 0.4)),
h AS (SELECT vid, {_N('dosage = 2')} AS a, {_N('dosage = 1')} AS b, {_N('dosage = 0')} AS c FROM g3 JOIN s USING (sample_id) WHERE NOT aff GROUP BY vid),
hp AS (SELECT *, (a + b + c)::DOUBLE AS n, (2*a + b) / (2.0 * (a + b + c)) AS p FROM h),
bad AS (SELECT vid FROM hp WHERE pow(a - n*p*p, 2) / (n*p*p) + pow(b - 2*n*p*(1-p), 2) / (2*n*p*(1-p)) + pow(c - n*(1-p)*(1-p), 2) / (n*(1-p)*(1-p)) > 8);;
SELECT vid, count(*) AS n FROM g3 WHERE dosage IS NOT NULL AND vid NOT IN (SELECT vid FROM bad) GROUP BY vid""")
def qc_filter_pipeline(spark, sf):
    return filters.qc(fx.genotypes(spark, sf), fx.samples(spark, sf), 0.05, 0.04, 0.4, 8)


@query("SELECT * FROM v WHERE chr = 2 AND bp BETWEEN 18000 AND 30000")
def region_filter(spark, sf):
    return filters.region(fx.variants(spark, sf), 2, 18_000, 30_000)


@query("SELECT * FROM v WHERE vid = 3 OR vid BETWEEN 10 AND 20 OR vid = 64")
def named_variants(spark, sf):
    return filters.named(fx.variants(spark, sf), "v3,v10-v20,v64")


@query("SELECT v.* FROM v JOIN v AS c ON v.chr = c.chr AND abs(v.bp - c.bp) <= 5000 WHERE c.name = 'v20'")
def window_around(spark, sf):
    return filters.window_around(fx.variants(spark, sf), "v20", 5)


@query("SELECT vid, count(*) AS n FROM g WHERE sample_id IN (SELECT sample_id FROM s WHERE aff AND sex = 1 AND founder) AND vid NOT IN (SELECT vid FROM v WHERE chr = 3) GROUP BY vid")
def keep_and_exclude(spark, sf):
    s = filters.subset(filters.subset(filters.subset(fx.samples(spark, sf), "cases"), "males"), "founders")
    g = filters.keep(fx.genotypes(spark, sf), s.select("sample_id"), "sample_id")
    return filters.remove(g, filters.region(fx.variants(spark, sf), 3).select("vid"), "vid").groupBy("vid").agg(F.count("*").alias("n"))


@query("qs AS (SELECT sample_id, vid, CASE WHEN (sample_id * 3 + vid * 5) % 17 BETWEEN 2 AND 13 THEN dosage END AS dosage FROM g);;SELECT vid, count(dosage) AS n, CAST(sum(dosage) AS BIGINT) AS a1 FROM qs GROUP BY vid")
def quality_window(spark, sf):
    g = fx.genotypes(spark, sf)
    quality = g.select("sample_id", "vid", ((F.col("sample_id") * 3 + F.col("vid") * 5) % 17).alias("score"))
    return filters.mask_low_quality(g, quality, 2, 13).groupBy("vid").agg(F.count("dosage").alias("n"), F.sum("dosage").alias("a1"))


@query("o AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM num), c AS (SELECT min(value) AS cut FROM o WHERE i >= least(floor(0.995 * n), n - 1));;SELECT attr_id, count(*) AS n FROM num WHERE attr_id IN (SELECT attr_id FROM num GROUP BY 1 HAVING max(value) >= (SELECT cut FROM c)) GROUP BY attr_id")
def low_value_filter(spark, sf):
    return filters.low_values(fx.numerics(spark, sf), 0.995).groupBy("attr_id").agg(F.count("*").alias("n"))


@query("vs AS (SELECT attr_id, var_samp(value) AS var FROM num GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY var) - 1 AS i, count(*) OVER () AS n FROM vs);;SELECT attr_id, var FROM o WHERE i >= floor(0.3 * n)", "var")
def low_variance_filter(spark, sf):
    return filters.low_variance(fx.numerics(spark, sf), 0.3)


@query("m AS (SELECT attr_id, avg(value) AS m, stddev_samp(value) AS sd FROM num GROUP BY 1);;SELECT sample_id, attr_id, (value - m) / sd AS value FROM num JOIN m USING (attr_id)", "value", 5)
def numeric_standardize(spark, sf):
    return recodes.standardise(fx.numerics(spark, sf))


@query("m AS (SELECT attr_id, avg(value) AS m FROM num GROUP BY 1);;SELECT sample_id, attr_id, value - m AS value FROM num JOIN m USING (attr_id)", "value")
def numeric_centre(spark, sf):
    return recodes.centre(fx.numerics(spark, sf))


@query(f"{_FREQ};;SELECT sample_id, vid, CASE WHEN freq > 0.5 THEN 2 - dosage ELSE dosage END AS dosage FROM g JOIN f USING (vid)")
def minor_allele_first(spark, sf):
    return recodes.minor_first(fx.genotypes(spark, sf))


def _zero(spark, sf):
    v = fx.variants(spark, sf)
    return v.where("vid % 7 = 0").select("vid", (F.col("vid") % 10).alias("cluster"))


@query("SELECT vid, count(dosage) AS n FROM (SELECT vid, CASE WHEN NOT (vid % 7 = 0 AND cluster = vid % 10) THEN dosage END AS dosage FROM g JOIN s USING (sample_id)) y GROUP BY vid")
def zero_cluster(spark, sf):
    return recodes.zero_cluster(fx.genotypes(spark, sf), fx.samples(spark, sf), _zero(spark, sf)).groupBy("vid").agg(F.count("dosage").alias("n"))


@query("SELECT vid, count(dosage) AS n, CAST(sum(dosage) AS BIGINT) AS a1 FROM (SELECT vid, CASE WHEN (chr = 4 AND sex = 1 AND dosage = 1) OR (chr = 3 AND sex <> 1) THEN NULL ELSE dosage END AS dosage FROM g JOIN v USING (vid) JOIN s USING (sample_id)) y GROUP BY vid")
def clean_haploid(spark, sf):
    v = fx.variants(spark, sf).withColumns({"is_x": F.col("chr") == 4, "is_y": F.col("chr") == 3, "is_haploid": F.lit(False)})
    return recodes.clean_haploid(fx.genotypes(spark, sf), v, fx.samples(spark, sf)).groupBy("vid").agg(F.count("dosage").alias("n"), F.sum("dosage").alias("a1"))


@query("u AS (SELECT vid, 'w' || vid AS name, bp + 7 AS bp FROM v WHERE vid % 3 = 0);;SELECT v.vid, chr, coalesce(u.bp, v.bp) AS bp, coalesce(u.name, v.name) AS name FROM v LEFT JOIN u USING (vid)")
def update_map(spark, sf):
    v = fx.variants(spark, sf)
    new = v.where("vid % 3 = 0").select("vid", F.concat(F.lit("w"), F.col("vid").cast("string")).alias("name"), (F.col("bp") + 7).alias("bp"))
    return recodes.update(v, new, "vid", ["bp", "name"])


@query("SELECT sample_id, " + ", ".join(f"max(CASE WHEN vid = {k} THEN dosage END) AS v{k}" for k in range(1, 65)) + " FROM g GROUP BY sample_id")
def recode_additive(spark, sf):
    return recodes.recode_additive(fx.genotypes(spark, sf), list(range(1, 65)))


@query("r AS (SELECT sample_id, row_number() OVER (PARTITION BY cls ORDER BY sample_id) AS k FROM s);;SELECT sample_id, " + ", ".join(f"CASE WHEN cls = {k} THEN 1 ELSE 0 END AS cls_{k}" for k in range(1, 10)) + " FROM s")
def dummy_coding(spark, sf):
    x = recodes.dummy_coding(fx.samples(spark, sf).select("sample_id", "cls"), "cls", list(range(10)))
    return x.drop("cls")


# Joins


@query("SELECT v.vid, v.chr, v.bp, r.name AS gene FROM v JOIN ranges r ON v.chr = r.chr AND v.bp BETWEEN r.start - 500 AND r.stop + 500")
def gene_report(spark, sf):
    v = fx.variants(spark, sf)
    return joins.gene_report(v.select("vid", "chr", "bp"), fx.ranges(spark, sf), border=500).select("vid", "chr", "bp", F.col("name").alias("gene"))


@query("a AS (SELECT vid, string_agg(DISTINCT r.grp, '|' ORDER BY r.grp) AS annot FROM v JOIN ranges r ON v.chr = r.chr AND v.bp BETWEEN r.start AND r.stop GROUP BY vid);;SELECT vid, chr, bp, coalesce(annot, '.') AS annot FROM v LEFT JOIN a USING (vid)")
def annotate(spark, sf):
    r = fx.ranges(spark, sf).withColumn("name", F.col("grp"))
    return joins.annotate(fx.variants(spark, sf).select("vid", "chr", "bp"), r)


@query("SELECT r.name, count(*) AS n, min(v.vid) AS first FROM v JOIN ranges r ON v.chr = r.chr AND v.bp BETWEEN r.start - 3000 AND r.stop + 3000 GROUP BY r.name")
def cis_window_join(spark, sf):
    x = joins.radius_join(fx.variants(spark, sf).withColumnRenamed("name", "v_name"), fx.ranges(spark, sf), 3000)
    return x.groupBy("name").agg(F.count("*").alias("n"), F.min("vid").alias("first"))


@query("SELECT DISTINCT grp AS set_name, vid FROM v JOIN ranges r ON v.chr = r.chr AND v.bp BETWEEN r.start AND r.stop")
def make_sets(spark, sf):
    r = fx.ranges(spark, sf).withColumn("name", F.col("grp")).drop("grp")
    return joins.make_sets(fx.variants(spark, sf).drop("name"), r)


@query("SELECT a.seg_id, count(*) AS n, CAST(sum(least(a.bp2, b.bp2) - greatest(a.bp1, b.bp1) + 1) AS BIGINT) AS meet FROM seg a JOIN seg b ON a.chr = b.chr AND a.bp1 <= b.bp2 AND b.bp1 <= a.bp2 GROUP BY a.seg_id")
def segment_overlap(spark, sf):
    seg = fx.segments(spark, sf)
    return joins.overlap_totals(seg, seg)


@query("SELECT a.sample_id AS i, b.sample_id AS j FROM s a JOIN s b ON a.cluster = b.cluster AND a.sex <> b.sex AND abs(a.pheno - b.pheno) <= 0.05 AND a.sample_id < b.sample_id")
def match_pairs(spark, sf):
    return joins.match_pairs(fx.samples(spark, sf), ["cluster"], ["sex"], {"pheno": 0.05})


def _two(spark, sf):
    """Two studies of the same variants: all calls, and a second calling of all samples whose ids go fifty further."""
    n = fx.numerics(spark, sf)
    i, vid = F.col("sample_id") + 50, F.col("attr_id") + 1
    new = n.select(i.alias("sample_id"), vid.alias("vid"), F.when((i * 11 + vid) % 9 != 0, F.when(F.col("value") < -0.1, 0).when(F.col("value") > 0.1, 2).otherwise(1)).alias("dosage"))
    return fx.genotypes(spark, sf), new


_MERGE = "w AS (SELECT sample_id + 50 AS sample_id, attr_id + 1 AS vid, CASE WHEN ((sample_id + 50) * 11 + attr_id + 1) % 9 <> 0 THEN CASE WHEN value < -0.1::DOUBLE THEN 0 WHEN value > 0.1::DOUBLE THEN 2 ELSE 1 END END AS dosage FROM num), m AS (SELECT o.dosage AS a, w.dosage AS b, o.vid AS in_a, w.vid AS in_b FROM g o FULL JOIN w ON o.sample_id = w.sample_id AND o.vid = w.vid)"
_MODES = {1: "CASE WHEN b IS NULL THEN a WHEN a IS NULL THEN b WHEN a = b THEN a END", 2: "coalesce(a, b)", 3: "coalesce(b, a)", 4: "a", 5: "b"}
for _mode in range(1, 8):

    def _merge(spark, sf, mode=_mode):
        return joins.merge_report(*_two(spark, sf), mode)

    _merge.__name__ = f"merge_mode_{_mode}"
    if _mode <= 5:
        _body = f"SELECT {_mode} AS mode, count(*) AS n_calls, {_N('d IS NULL')} AS n_missing FROM (SELECT CASE WHEN in_b IS NULL THEN a WHEN in_a IS NULL THEN b ELSE {_MODES[_mode]} END AS d FROM m) y"
    else:
        _body = f"SELECT {_mode} AS mode, count(*) AS n_calls, {_N('a IS NULL')} AS n_missing FROM m WHERE in_a IS NOT NULL AND in_b IS NOT NULL AND {'a IS DISTINCT FROM b' if _mode == 6 else 'a <> b'}"
    query(f"{_MERGE};;{_body}")(_merge)


# Association

_MODEL_SQL = f"""c AS (SELECT vid, {_N('aff AND dosage = 2')}::DOUBLE AS a2, {_N('aff AND dosage = 1')}::DOUBLE AS a1, {_N('aff AND dosage = 0')}::DOUBLE AS a0, {_N('NOT aff AND dosage = 2')}::DOUBLE AS u2, {_N('NOT aff AND dosage = 1')}::DOUBLE AS u1, {_N('NOT aff AND dosage = 0')}::DOUBLE AS u0 FROM g JOIN s USING (sample_id) WHERE dosage IS NOT NULL GROUP BY vid),
k AS (SELECT *, a2+a1+a0 AS ca, u2+u1+u0 AS cu, a2+a1+a0+u2+u1+u0 AS t FROM c),
m AS (SELECT vid, 'GENO' AS test, CASE WHEN least(a2,a1,a0,u2,u1,u0) >= 5 THEN {' + '.join(f'pow({o} - {r}*(a{d}+u{d})/t, 2) / nullif({r}*(a{d}+u{d})/t, 0)' for d in (2, 1, 0) for o, r in ((f'a{d}', 'ca'), (f'u{d}', 'cu')))} END AS chisq, 2 AS df FROM k
UNION ALL SELECT vid, 'TREND', pow((cu/t*a1 - ca/t*u1) + 2*(cu/t*a2 - ca/t*u2), 2) / nullif(ca*cu*(t*((a1+u1) + 4*(a2+u2)) - pow((a1+u1) + 2*(a2+u2), 2)) / (t*t*t), 0), 1 FROM k
UNION ALL SELECT vid, 'ALLELIC', {_x2('2*a2+a1', '2*a0+a1', '2*u2+u1', '2*u0+u1')}, 1 FROM k
UNION ALL SELECT vid, 'DOM', CASE WHEN least(a2+a1, a0, u2+u1, u0) >= 5 THEN {_x2('a2+a1', 'a0', 'u2+u1', 'u0')} END, 1 FROM k
UNION ALL SELECT vid, 'REC', CASE WHEN least(a2, a1+a0, u2, u1+u0) >= 5 THEN {_x2('a2', 'a1+a0', 'u2', 'u1+u0')} END, 1 FROM k)"""


@query(f"{_MODEL_SQL};;SELECT * FROM m", "chisq")
def model_tests(spark, sf):
    return assoc.model_tests(fx.genotypes(spark, sf), fx.samples(spark, sf))


@query(f"al AS ({_ALLELES});;SELECT *, {_exact('a1_aff', 'a2_aff', 'a1_unaff', 'a2_unaff')} AS p FROM al", "p")
def fisher_test(spark, sf):
    return assoc.fisher(fx.genotypes(spark, sf), fx.samples(spark, sf))


_QT = "q AS (SELECT vid, {} count(*)::DOUBLE AS n, var_samp(dosage::DOUBLE) AS vg, var_samp(pheno) AS vy, covar_samp(dosage::DOUBLE, pheno) AS cv FROM g JOIN s USING (sample_id) WHERE dosage IS NOT NULL GROUP BY vid {})"
_VAR = "(vy/vg - cv*cv/(vg*vg)) / (n - 2)"


@query(_QT.format("", "") + f";;SELECT vid, CAST(n AS BIGINT) AS nanal, cv/vg AS beta, sqrt({_VAR}) AS se, cv*cv/(vg*vy) AS r2, cv/vg / sqrt({_VAR}) AS t FROM q", "beta se r2 t")
def assoc_qt(spark, sf):
    return assoc.quantitative(fx.genotypes(spark, sf), fx.samples(spark, sf))


@query("m AS (SELECT vid, dosage, count(*) AS n, avg(pheno) AS mean, stddev_samp(pheno) AS sd FROM g JOIN s USING (sample_id) WHERE dosage IS NOT NULL GROUP BY vid, dosage);;SELECT vid, dosage, n, mean, sd, n / (sum(n) OVER (PARTITION BY vid))::DOUBLE AS freq FROM m", "mean sd freq")
def qt_means(spark, sf):
    return assoc.qt_means(fx.genotypes(spark, sf), fx.samples(spark, sf))


_CMH = f"""cl AS ({_CLUSTERS}), ct AS (SELECT vid, a1_aff::DOUBLE AS a, a2_aff::DOUBLE AS b, a1_unaff::DOUBLE AS c, a2_unaff::DOUBLE AS d, (a1_aff+a2_aff+a1_unaff+a2_unaff)::DOUBLE AS n FROM cl),
cs AS (SELECT vid, sum(a - (a+b)*(a+c)/n) AS df, sum((a+b)*(c+d)*(a+c)*(b+d)/(n*n*(n-1))) AS vr, sum(a*d/n) AS r, sum(b*c/n) AS ss, sum((a+d)*a*d/(n*n)) AS v1, sum((b+c)*b*c/(n*n)) AS v2, sum(((a+d)*b*c + (b+c)*a*d)/(n*n)) AS v3 FROM ct WHERE n >= 2 GROUP BY vid),
cmh AS (SELECT vid, df*df/nullif(vr, 0) AS chisq, r/nullif(ss, 0) AS or_mh, sqrt(v1/nullif(2*r*r, 0) + v2/nullif(2*ss*ss, 0) + v3/nullif(2*r*ss, 0)) AS se FROM cs)"""


@query(f"{_CMH};;SELECT * FROM cmh", "chisq or_mh se")
def cmh_2x2xk(spark, sf):
    return assoc.cmh(fx.genotypes(spark, sf), _strata(spark, sf))


def _strata(spark, sf):
    """Samples whose clusters hold cases and controls: five strata by id."""
    return fx.samples(spark, sf).withColumn("cluster", (F.col("sample_id") % 5).cast("int"))


SQL["cmh_2x2xk"] = SQL["cmh_2x2xk"].replace("label AS cluster", "CAST(vec_id % 5 AS INTEGER) AS cluster")


@query(f"""{_CMH}, e0 AS (SELECT ct.*, or_mh AS o, 1 - or_mh AS p, n - (a+b) - (a+c) + or_mh*((a+b)+(a+c)) AS q, -or_mh*(a+b)*(a+c) AS k FROM ct JOIN cmh USING (vid) WHERE or_mh IS NOT NULL AND a+b > 0 AND a+c > 0 AND n > a+b AND n > a+c),
e1 AS (SELECT *, CASE WHEN abs(p) < 1e-12 THEN -k/nullif(q, 0) ELSE (-q + sqrt(greatest(q*q - 4*p*k, 0)))/nullif(2*p, 0) END AS e FROM e0);;
SELECT vid, sum(pow(a - e, 2) * (1/e + 1/nullif(a+b-e, 0) + 1/nullif(a+c-e, 0) + 1/nullif(n-(a+b)-(a+c)+e, 0))) AS bd, count(pow(a - e, 2) * (1/e + 1/nullif(a+b-e, 0) + 1/nullif(a+c-e, 0) + 1/nullif(n-(a+b)-(a+c)+e, 0))) - 1 AS df FROM e1 WHERE e > 0 GROUP BY vid""", "bd")
def breslow_day(spark, sf):
    return assoc.breslow_day(fx.genotypes(spark, sf), _strata(spark, sf))


SQL["breslow_day"] = SQL["breslow_day"].replace("label AS cluster", "CAST(vec_id % 5 AS INTEGER) AS cluster")


@query(f"cl AS ({_CLUSTERS}), l AS (SELECT vid, ln(a1_aff::DOUBLE*a2_unaff/(a2_aff::DOUBLE*a1_unaff)) AS l, 1/(1.0::DOUBLE/a1_aff + 1.0::DOUBLE/a2_aff + 1.0::DOUBLE/a1_unaff + 1.0::DOUBLE/a2_unaff) AS w FROM cl WHERE a1_aff > 0 AND a2_aff > 0 AND a1_unaff > 0 AND a2_unaff > 0), t AS (SELECT vid, sum(w*l*l) AS total, pow(sum(w*l), 2)/sum(w) AS assoc, count(*) AS k FROM l GROUP BY vid);;SELECT vid, total, assoc, total - assoc AS homog, k - 1 AS df FROM t", "total assoc homog")
def homogeneity_of_or(spark, sf):
    return assoc.homogeneity(fx.genotypes(spark, sf), _strata(spark, sf))


SQL["homogeneity_of_or"] = SQL["homogeneity_of_or"].replace("label AS cluster", "CAST(vec_id % 5 AS INTEGER) AS cluster")


@query(_QT.format("sex,", ", sex") + f", b AS (SELECT vid, sex, cv/vg AS beta, {_VAR} AS vv FROM q);;SELECT vid, max(CASE WHEN sex = 1 THEN beta END) AS beta1, max(CASE WHEN sex = 2 THEN beta END) AS beta2, (max(CASE WHEN sex = 1 THEN beta END) - max(CASE WHEN sex = 2 THEN beta END)) / sqrt(max(CASE WHEN sex = 1 THEN vv END) + max(CASE WHEN sex = 2 THEN vv END)) AS z FROM b GROUP BY vid", "beta1 beta2 z")
def gxe(spark, sf):
    return assoc.gxe(fx.genotypes(spark, sf), fx.samples(spark, sf))


@query(f"c AS (SELECT vid, cluster, sum(dosage)::DOUBLE AS x1, sum(2 - dosage)::DOUBLE AS x2 FROM g JOIN s USING (sample_id) WHERE dosage IS NOT NULL GROUP BY vid, cluster), o AS (SELECT *, sum(x1) OVER (PARTITION BY vid) - x1 AS y1, sum(x2) OVER (PARTITION BY vid) - x2 AS y2 FROM c);;SELECT vid, cluster, {_x2('x1', 'x2', 'y1', 'y2')} AS chisq FROM o", "chisq")
def loop_assoc(spark, sf):
    return assoc.loop_assoc(fx.genotypes(spark, sf), fx.samples(spark, sf))


@query("m AS (SELECT vid, avg(dosage::DOUBLE) AS m FROM g GROUP BY vid), x AS (SELECT sample_id, count(*) AS n, CAST(coalesce(sum(dosage), 0) AS BIGINT) AS cnt2, sum(coalesce(dosage::DOUBLE, m) * weight) AS sm FROM g JOIN wt USING (vid) JOIN m USING (vid) GROUP BY sample_id);;SELECT sample_id, 2 * n AS cnt, cnt2, sm / (2 * n)::DOUBLE AS score FROM x", "score", 11)
def profile_score(spark, sf):
    return assoc.profile_score(fx.genotypes(spark, sf), fx.weights(spark, sf))


_QR = [("low", 0.0, 24.0), ("mid", 24.0, 26.0), ("all", 0.0, 100.0)]


@query("r AS (SELECT * FROM (VALUES ('low', 0.0, 24.0), ('mid', 24.0, 26.0), ('all', 0.0, 100.0)) t(label, lo, hi)), x AS (SELECT label, sample_id, count(*) AS n, sum(dosage * weight) AS sm FROM g JOIN wt USING (vid) JOIN r ON q >= lo AND q <= hi WHERE dosage IS NOT NULL GROUP BY label, sample_id);;SELECT label, sample_id, 2 * n AS cnt, sm / (2 * n)::DOUBLE AS score FROM x", "score", 11)
def profile_score_qrange(spark, sf):
    return assoc.profile_ranges(fx.genotypes(spark, sf), fx.weights(spark, sf), spark.createDataFrame(_QR, "label string, lower double, upper double"))


def _studies(spark, sf):
    x = assoc.moments(fx.genotypes(spark, sf), fx.samples(spark, sf).withColumn("study", (F.col("sample_id") % 3).cast("int")), ("vid", "study"))
    n, vg, vy, cov = (F.col(c).cast("double") for c in ("nanal", "vg", "vy", "cov"))
    beta, var = div(cov, vg), div(div(vy, vg) - div(cov * cov, vg * vg), n - 2)
    return x.select("vid", "study", beta.alias("effect"), F.sqrt(var).alias("se"))


_META = _QT.replace("FROM g JOIN s USING (sample_id)", "FROM g JOIN (SELECT *, CAST(sample_id % 3 AS INTEGER) AS study FROM s) z USING (sample_id)").format("study,", ", study")


@query(_META + f""", st AS (SELECT vid, cv/vg AS d, 1/({_VAR}) AS w FROM q), f AS (SELECT vid, count(*) AS n, sum(w) AS sw, sum(w*w) AS sww, sum(w*d)/sum(w) AS fixed FROM st GROUP BY vid),
q2 AS (SELECT f.vid, any_value(n) AS n, any_value(sw) AS sw, any_value(sww) AS sww, any_value(fixed) AS fixed, sum(w * pow(d - fixed, 2)) AS q FROM f JOIN st USING (vid) GROUP BY f.vid),
ta AS (SELECT *, greatest((q - (n - 1)) / (sw - sww/sw), 0) AS tau FROM q2), rn AS (SELECT vid, sum(d / (1/w + tau)) AS rd, sum(1 / (1/w + tau)) AS rw FROM ta JOIN st USING (vid) GROUP BY vid);;
SELECT vid, n, fixed, fixed * sqrt(sw) AS z_fixed, rd/rw AS random, rd/sqrt(rw) AS z_random, q, least(greatest(100 * (q - (n - 1)) / nullif(q, 0), 0), 100) AS i2, 2 * {_tail('fixed * sqrt(sw)')} AS p_fixed, 2 * {_tail('rd/sqrt(rw)')} AS p_random FROM ta JOIN rn USING (vid)""", "fixed z_fixed random z_random q i2 p_fixed p_random", 5)
def meta_fixed_random(spark, sf):
    return assoc.meta_analysis(_studies(spark, sf))


@query(f"{_ASSOC}, sets AS (SELECT DISTINCT grp AS set_name, vid FROM v JOIN ranges r ON v.chr = r.chr AND v.bp BETWEEN r.start AND r.stop);;SELECT set_name, count(*) AS n, avg(chisq) AS mean_chisq FROM sets JOIN res USING (vid) WHERE chisq IS NOT NULL GROUP BY set_name", "mean_chisq")
def set_score(spark, sf):
    return assoc.set_score(assoc.allelic(fx.genotypes(spark, sf), fx.samples(spark, sf)), make_sets(spark, sf))


_P = f"2 * {_tail('sqrt(chisq)')}"


@query(f"""{_ASSOC}, l AS (SELECT greatest(median(chisq) / 0.456, 1.0) AS la, count(*)::DOUBLE AS t FROM res WHERE chisq IS NOT NULL),
p AS (SELECT vid, {_P} AS p, 2 * {_tail('sqrt(chisq / la)')} AS gc, t FROM res, l WHERE chisq IS NOT NULL), o AS (SELECT *, row_number() OVER (ORDER BY p, vid) - 1 AS i FROM p), h AS (SELECT sum(1.0::DOUBLE / (i + 1)) AS h FROM o);;
SELECT vid, p AS unadj, gc, least(1, p * t) AS bonf, max(least(1, (t - i) * p)) OVER (ORDER BY p, vid ROWS UNBOUNDED PRECEDING) AS holm, 1 - pow(1 - p, t) AS sidak_ss, max(1 - pow(1 - p, t - i)) OVER (ORDER BY p, vid ROWS UNBOUNDED PRECEDING) AS sidak_sd,
 min(least(1, t * p / (i + 1))) OVER (ORDER BY p DESC, vid DESC ROWS UNBOUNDED PRECEDING) AS fdr_bh, min(least(1, h * t * p / (i + 1))) OVER (ORDER BY p DESC, vid DESC ROWS UNBOUNDED PRECEDING) AS fdr_by FROM o, h""", "unadj gc bonf holm sidak_ss sidak_sd fdr_bh fdr_by")
def multiple_testing(spark, sf):
    return permutation.multiple_testing(assoc.allelic(fx.genotypes(spark, sf), fx.samples(spark, sf)))


_SHUFFLE = "k0 AS (SELECT rep, sample_id, aff, sex, (sample_id * ((rep * 40692 + 69621 + 48271) % 2147483647) + rep * 7919) % 2147483647 AS x FROM s, (SELECT i AS rep FROM range(1, 21) t(i)) r), k AS (SELECT *, (x * x + x) % 2147483647 AS h FROM k0), k2 AS (SELECT *, row_number() OVER (PARTITION BY rep, sex ORDER BY sample_id) AS f, row_number() OVER (PARTITION BY rep, sex ORDER BY h, sample_id) AS t FROM k), lab AS (SELECT a.rep, a.sample_id, b.aff FROM k2 a JOIN k2 b ON a.rep = b.rep AND a.sex = b.sex AND a.t = b.f UNION ALL SELECT 0, sample_id, aff FROM s)"


@query(f"""{_SHUFFLE}, c AS (SELECT rep, vid, sum(CASE WHEN aff THEN dosage ELSE 0 END)::DOUBLE AS a, sum(CASE WHEN aff THEN 2 - dosage ELSE 0 END)::DOUBLE AS b, sum(CASE WHEN aff THEN 0 ELSE dosage END)::DOUBLE AS c, sum(CASE WHEN aff THEN 0 ELSE 2 - dosage END)::DOUBLE AS d FROM g JOIN lab USING (sample_id) WHERE dosage IS NOT NULL GROUP BY rep, vid),
x AS (SELECT rep, vid, {_x2('a', 'b', 'c', 'd')} AS st FROM c), top AS (SELECT rep, max(st) AS m FROM x WHERE rep > 0 GROUP BY rep), ob AS (SELECT vid, st AS chisq FROM x WHERE rep = 0),
r1 AS (SELECT vid, chisq, sum(CASE WHEN st >= chisq - 1e-9 THEN 1 ELSE 0 END) AS r FROM x JOIN ob USING (vid) WHERE rep > 0 GROUP BY vid, chisq);;
SELECT vid, chisq, (r + 1) / 21.0::DOUBLE AS emp1, ((SELECT count(*) FROM top WHERE m >= chisq - 1e-9) + 1) / 21.0::DOUBLE AS emp2 FROM r1""", "chisq emp1 emp2")
def maxt_permutation(spark, sf):
    return permutation.max_t(fx.genotypes(spark, sf), fx.samples(spark, sf), 20, within="sex")


# Families

_TRIO = "tr AS (SELECT k.vid, kid, k.dosage AS k, p.dosage AS p, m.dosage AS m, t.father, t.mother FROM trios t JOIN g k ON k.sample_id = kid LEFT JOIN g p ON p.sample_id = father AND p.vid = k.vid LEFT JOIN g m ON m.sample_id = mother AND m.vid = k.vid), mc AS (SELECT *, CASE WHEN k=1 AND p=2 AND m=2 THEN 1 WHEN k=1 AND p=0 AND m=0 THEN 2 WHEN k=2 AND p=0 AND m=0 THEN 5 WHEN k=2 AND p=0 THEN 3 WHEN k=2 AND m=0 THEN 4 WHEN k=0 AND p=2 AND m=2 THEN 8 WHEN k=0 AND p=2 THEN 6 WHEN k=0 AND m=2 THEN 7 ELSE 0 END AS code FROM tr)"
_TDT = f"""{_TRIO}, ok AS (SELECT mc.* FROM mc JOIN s ON kid = sample_id WHERE aff AND code = 0 AND k IS NOT NULL AND p IS NOT NULL AND m IS NOT NULL AND (p = 1 OR m = 1)),
tx AS (SELECT vid, kid, CASE WHEN p <> 1 THEN 0 WHEN k = 2 THEN 1 WHEN k = 0 THEN 0 WHEN m = 1 THEN 0.5 WHEN m = 0 THEN 1 ELSE 0 END::DOUBLE AS tp, CASE WHEN m <> 1 THEN 0 WHEN k = 2 THEN 1 WHEN k = 0 THEN 0 WHEN p = 1 THEN 0.5 WHEN p = 0 THEN 1 ELSE 0 END::DOUBLE AS tm, CASE WHEN p = 1 THEN 1 ELSE 0 END AS hp, CASE WHEN m = 1 THEN 1 ELSE 0 END AS hm FROM ok),
td AS (SELECT vid, sum(tp) AS tp, sum(hp - tp) AS up, sum(tm) AS tm, sum(hm - tm) AS um FROM tx GROUP BY vid)"""


@query(f"{_TRIO};;SELECT vid, kid, code FROM mc WHERE code > 0")
def mendel_errors(spark, sf):
    return family.mendel(fx.genotypes(spark, sf), fx.trios(spark, sf))


@query(f"{_TRIO}, bad AS (SELECT DISTINCT vid, unnest(CASE WHEN code IN (1,2) THEN [kid, father, mother] WHEN code IN (3,6) THEN [kid, father] WHEN code IN (4,7) THEN [kid, mother] ELSE [kid] END) AS sample_id FROM mc WHERE code > 0);;SELECT g.vid, count(CASE WHEN bad.vid IS NULL THEN dosage END) AS n FROM g LEFT JOIN bad ON g.vid = bad.vid AND g.sample_id = bad.sample_id GROUP BY g.vid")
def mendel_clean(spark, sf):
    return family.mendel_clean(fx.genotypes(spark, sf), fx.trios(spark, sf)).groupBy("vid").agg(F.count("dosage").alias("n"))


@query(f"{_TDT};;SELECT vid, tp + tm AS t, up + um AS u, (tp + tm) / nullif(up + um, 0) AS odds_ratio, pow(tp + tm - up - um, 2) / nullif(tp + tm + up + um, 0) AS chisq FROM td", "t u odds_ratio chisq")
def tdt(spark, sf):
    return family.tdt(fx.genotypes(spark, sf), fx.trios(spark, sf), fx.samples(spark, sf))


@query(f"{_TDT};;SELECT vid, tp, up, tm, um, pow(tp - up, 2) / nullif(tp + up, 0) AS chisq_pat, pow(tm - um, 2) / nullif(tm + um, 0) AS chisq_mat, CASE WHEN tp > 0 AND up > 0 AND tm > 0 AND um > 0 THEN (ln(tp/up) - ln(tm/um)) / sqrt(1/tp + 1/up + 1/tm + 1/um) END AS z FROM td", "tp up tm um chisq_pat chisq_mat z")
def parent_of_origin(spark, sf):
    return family.poo(fx.genotypes(spark, sf), fx.trios(spark, sf), fx.samples(spark, sf))


@query(f"{_TRIO};;SELECT vid, kid, k AS \"case\", p + m - k AS control FROM mc WHERE code = 0 AND k IS NOT NULL AND p IS NOT NULL AND m IS NOT NULL")
def pseudo_controls(spark, sf):
    return family.pseudo_controls(fx.genotypes(spark, sf), fx.trios(spark, sf))


@query("c AS (SELECT t.father, t.mother, f.aff AS fa FROM trios t JOIN s f ON f.sample_id = father JOIN s m ON m.sample_id = mother WHERE f.aff <> m.aff), x AS (SELECT p.vid, CASE WHEN fa THEN p.dosage ELSE m.dosage END AS a, CASE WHEN fa THEN m.dosage ELSE p.dosage END AS u FROM c JOIN g p ON p.sample_id = father JOIN g m ON m.sample_id = mother AND m.vid = p.vid WHERE p.dosage IS NOT NULL AND m.dosage IS NOT NULL), y AS (SELECT vid, CAST(sum(greatest(a - u, 0)) AS BIGINT) AS b, CAST(sum(greatest(u - a, 0)) AS BIGINT) AS c FROM x GROUP BY vid);;SELECT vid, b, c, pow(b - c, 2)::DOUBLE / nullif(b + c, 0) AS chisq FROM y", "chisq")
def parent_tdt(spark, sf):
    return family.parent_tdt(fx.genotypes(spark, sf), fx.trios(spark, sf), fx.samples(spark, sf))


@query("x AS (SELECT vid, sample_id // 3 AS sib, count(*)::DOUBLE AS n, (count(*) FILTER (WHERE aff))::DOUBLE AS a, sum(dosage)::DOUBLE AS t, coalesce(sum(dosage) FILTER (WHERE aff), 0)::DOUBLE AS o, coalesce(var_pop(dosage::DOUBLE), 0) AS vv FROM g JOIN s USING (sample_id) WHERE dosage IS NOT NULL GROUP BY vid, sib);;SELECT vid, pow(sum(o - a*t/n), 2) / nullif(sum(a*(n-a)/(n-1)*vv), 0) AS chisq FROM x WHERE n > 1 AND a > 0 AND a < n GROUP BY vid", "chisq")
def sibship_test(spark, sf):
    return family.sibship_test(fx.genotypes(spark, sf), fx.samples(spark, sf).withColumn("cluster", F.floor(F.col("sample_id") / 3)))


@query(f"{_TRIO}, q AS (SELECT vid, count(*) AS n, var_samp(k - (p+m)/2.0::DOUBLE) AS vx, var_samp(pheno) AS vy, covar_samp(k - (p+m)/2.0::DOUBLE, pheno) AS c FROM tr JOIN s ON kid = sample_id WHERE k IS NOT NULL AND p IS NOT NULL AND m IS NOT NULL GROUP BY vid);;SELECT vid, n, c/vx AS beta, c/vx / sqrt((vy/vx - pow(c/vx, 2)) / (n - 2)) AS t FROM q", "beta t")
def qfam_within(spark, sf):
    return family.qfam(fx.genotypes(spark, sf), fx.trios(spark, sf), fx.samples(spark, sf))


# Pairs

_IBS = f"ib AS (SELECT a.sample_id AS i, b.sample_id AS j, {_N('abs(a.dosage - b.dosage) = 2')} AS ibs0, {_N('abs(a.dosage - b.dosage) = 1')} AS ibs1, {_N('a.dosage = b.dosage')} AS ibs2, {_N('a.dosage = 1 AND b.dosage = 1')} AS h2 FROM g a JOIN g b ON a.vid = b.vid AND a.sample_id < b.sample_id WHERE a.dosage IS NOT NULL AND b.dosage IS NOT NULL GROUP BY 1, 2)"
_ZP = "((h2 / nullif(ibs0 + h2, 0)::DOUBLE - 2.0/3.0::DOUBLE) / nullif(sqrt(2.0/9.0::DOUBLE / nullif(ibs0 + h2, 0)), 0))"


@query(f"{_IBS};;SELECT i, j, ibs0, ibs1, ibs2, (0.5 * ibs1 + ibs2) / nullif(ibs0 + ibs1 + ibs2, 0)::DOUBLE AS dst, CASE WHEN {_ZP} IS NULL THEN NULL WHEN {_ZP} >= 0 THEN 1 - {_tail(_ZP)} ELSE {_tail(_ZP)} END AS ppc FROM ib", "dst ppc", 5, many=True)
def ibs_pairs(spark, sf):
    return pairs.ibs(fx.genotypes(spark, sf))


_E = "x/t"


@query(f"""{_IBS}, a AS (SELECT vid, sum(dosage)::DOUBLE AS x, 2.0::DOUBLE * count(*) AS t, 2.0::DOUBLE * count(*) - sum(dosage) AS y FROM g WHERE dosage IS NOT NULL GROUP BY vid),
e AS (SELECT avg(2*x*(x-1)*y*(y-1)/d4) AS e00, avg((4*x*(x-1)*(x-2)*y + 4*x*y*(y-1)*(y-2))/d4) AS e01, avg((x*(x-1)*(x-2)*(x-3) + y*(y-1)*(y-2)*(y-3) + 4*x*(x-1)*y*(y-1))/d4) AS e02, avg((2*x*(x-1)*y + 2*x*y*(y-1))/d3) AS e11, avg((x*(x-1)*(x-2) + y*(y-1)*(y-2) + x*(x-1)*y + x*y*(y-1))/d3) AS e12 FROM (SELECT *, t*(t-1)*(t-2)*(t-3) AS d4, t*(t-1)*(t-2) AS d3 FROM a WHERE x > 0 AND y > 0 AND t > 3) q),
z AS (SELECT i, j, ibs0, ibs1, ibs2, e.*, (ibs0+ibs1+ibs2)::DOUBLE AS n, ibs0 / (e00 * (ibs0+ibs1+ibs2)) AS z0 FROM ib, e), z1 AS (SELECT *, (ibs1 - z0*e01*n) / (e11*n) AS z1 FROM z), z2 AS (SELECT i, j, greatest(least(z0, 1), 0) AS z0, greatest(least(z1, 1), 0) AS z1, greatest(least((ibs2 - z0*e02*n - z1*e12*n)/n, 1), 0) AS z2 FROM z1);;
SELECT i, j, z0/(z0+z1+z2) AS z0, z1/(z0+z1+z2) AS z1, z2/(z0+z1+z2) AS z2, z1/(z0+z1+z2)/2 + z2/(z0+z1+z2) AS pi_hat FROM z2""", "z0 z1 z2 pi_hat", 5, many=True)
def ibd_moments(spark, sf):
    return pairs.ibd(fx.genotypes(spark, sf))


@query("SELECT a.sample_id AS i, b.sample_id AS j, count(*) FILTER (WHERE (a.dosage IS NULL) = (b.dosage IS NULL)) / count(*)::DOUBLE AS ibm FROM g a JOIN g b ON a.vid = b.vid AND a.sample_id < b.sample_id GROUP BY 1, 2", "ibm")
def missing_identity(spark, sf):
    return pairs.missing_identity(fx.genotypes(spark, sf))


@query(f"{_IBS}, d AS (SELECT i, j, (0.5 * ibs1 + ibs2) / (ibs0 + ibs1 + ibs2)::DOUBLE AS dst FROM ib), b AS (SELECT i AS id, j AS o, dst FROM d UNION ALL SELECT j, i, dst FROM d), r AS (SELECT id, dst, row_number() OVER (PARTITION BY id ORDER BY dst DESC, o) AS rank FROM b), m AS (SELECT rank, avg(dst) AS m, stddev_samp(dst) AS sd FROM r WHERE rank BETWEEN 1 AND 3 GROUP BY rank);;SELECT id, CAST(rank AS INTEGER) AS rank, dst, (dst - m) / nullif(sd, 0) AS z FROM r JOIN m USING (rank)", "dst z", 5)
def neighbours(spark, sf):
    return pairs.nearest_neighbours(fx.genotypes(spark, sf), 1, 3)


_LD = "mo AS (SELECT {by} a.vid AS v1, b.vid AS v2, count(*)::DOUBLE AS n, sum(a.dosage)::DOUBLE AS sa, sum(b.dosage)::DOUBLE AS sb, sum(a.dosage*a.dosage)::DOUBLE AS saa, sum(b.dosage*b.dosage)::DOUBLE AS sbb, sum(a.dosage*b.dosage)::DOUBLE AS sab FROM g a JOIN g b ON a.sample_id = b.sample_id AND a.vid < b.vid {cond} WHERE a.dosage IS NOT NULL AND b.dosage IS NOT NULL GROUP BY ALL), ld AS (SELECT {byo} v1, v2, (n*sab - sa*sb) / nullif(sqrt((n*saa - sa*sa) * (n*sbb - sb*sb)), 0) AS r FROM mo)"


@query(_LD.format(by="", byo="", cond="AND b.vid - a.vid < 20") + ";;SELECT v1, v2, r, r*r AS r2 FROM ld", "r r2")
def ld_r2_window(spark, sf):
    return pairs.ld(fx.genotypes(spark, sf), 20)


@query(_LD.format(by="", byo="", cond="AND b.vid - a.vid < 30") + ", t AS (SELECT v1 AS vid FROM ld WHERE r*r >= 0.01 UNION ALL SELECT v2 FROM ld WHERE r*r >= 0.01);;SELECT v.vid, count(t.vid) AS n_tags FROM v LEFT JOIN t USING (vid) GROUP BY v.vid")
def tag_snps(spark, sf):
    return pairs.tags(fx.genotypes(spark, sf), fx.variants(spark, sf), 30, 0.01)


@query(_LD.format(by="aff,", byo="aff,", cond="AND b.vid - a.vid < 30 JOIN s ON s.sample_id = a.sample_id") + ", p AS (SELECT v1, v2, max(CASE WHEN aff THEN r END) AS ra, max(CASE WHEN NOT aff THEN r END) AS ru FROM ld GROUP BY v1, v2), q AS (SELECT * FROM p WHERE abs(ra) >= 0.05 AND abs(ru) >= 0.05), b AS (SELECT v1 AS vid, ra, ru FROM q UNION ALL SELECT v2, ra, ru FROM q);;SELECT vid, count(*) FILTER (WHERE ra*ru > 0) AS pos, count(*) FILTER (WHERE ra*ru < 0) AS neg FROM b GROUP BY vid")
def flip_scan(spark, sf):
    return pairs.flip_scan(fx.genotypes(spark, sf), fx.samples(spark, sf), 30, 0.05)


_PRUNED = """, pos AS (SELECT vid, chr, CAST(row_number() OVER (PARTITION BY chr ORDER BY bp, vid) - 1 AS INTEGER) AS i FROM v),
lk AS (SELECT a.chr, least(a.i, b.i) AS i, greatest(a.i, b.i) AS j FROM ld JOIN pos a ON a.vid = v1 JOIN pos b ON b.vid = v2 WHERE a.chr = b.chr AND abs(a.i - b.i) < 16 AND r*r >= 0.02),
st AS (SELECT pos.chr, k.start, pos.i, list_concat([pos.i], coalesce(list(j ORDER BY j) FILTER (WHERE j < k.start + 16), CAST([] AS INTEGER[]))) AS e FROM pos JOIN range(0, 64, 4) k(start) ON pos.i >= k.start AND pos.i < k.start + 16 LEFT JOIN lk ON lk.chr = pos.chr AND lk.i = pos.i GROUP BY 1, 2, 3),
fo AS (SELECT chr, list_reduce(list_prepend(CAST([-1] AS INTEGER[]), list(e ORDER BY start, i)), lambda gone, e: CASE WHEN list_contains(gone, e[1]) THEN gone ELSE list_concat(gone, e[2:]) END) AS gone FROM st GROUP BY chr)"""


@query(_LD.format(by="", byo="", cond="") + _PRUNED + ";;SELECT vid, NOT list_contains(gone, i) AS kept FROM pos JOIN fo USING (chr)")
def ld_prune(spark, sf):
    return pairs.ld_prune(fx.genotypes(spark, sf), fx.variants(spark, sf), 16, 4, 0.02)


_CLUMPS = f""", res AS (SELECT *, 2 * {_tail('sqrt(chisq)')} AS p FROM (SELECT *, {_X2} AS chisq FROM al) y), ca AS (SELECT vid, p FROM res WHERE p <= 1.0),
nr AS (SELECT v1 AS vid, v2 AS o FROM ld WHERE r*r >= 0.01 UNION ALL SELECT v2, v1 FROM ld WHERE r*r >= 0.01),
ne AS (SELECT ca.vid, ca.p, [list_concat([ca.vid], coalesce(list(o ORDER BY o) FILTER (WHERE o IN (SELECT vid FROM ca)), CAST([] AS INTEGER[])))] AS e FROM ca LEFT JOIN nr USING (vid) GROUP BY 1, 2),
fo AS (SELECT list_reduce(list_prepend([CAST([-1] AS INTEGER[])], list(e ORDER BY p, vid) FILTER (WHERE p <= 0.3)), lambda acc, e: CASE WHEN list_contains(flatten(acc), e[1][1]) THEN acc ELSE list_concat(acc, [list_filter(e[1], lambda x: NOT list_contains(flatten(acc), x))]) END) AS acc FROM ne)"""


@query(f"al AS ({_ALLELES}), " + _LD.format(by="", byo="", cond="") + _CLUMPS + ", cl AS (SELECT unnest(acc[2:]) AS c FROM fo);;SELECT c[1] AS index, p, len(c) - 1 AS total, array_to_string(c[2:], ',') AS members FROM cl JOIN ca ON ca.vid = c[1]", "p")
def clump(spark, sf):
    g = fx.genotypes(spark, sf)
    out = pairs.clump(assoc.allelic(g, fx.samples(spark, sf)), pairs.ld(g), 0.3, 1.0, 0.01)
    return spark.createDataFrame([(c["index"], c["p"], c["total"], ",".join(map(str, c["members"]))) for c in out], "index int, p double, total long, members string")


@query(f"SELECT a.vid AS v1, b.vid AS v2, a.dosage AS d1, b.dosage AS d2, {_N('aff')} AS n_aff, {_N('NOT aff')} AS n_unaff FROM g a JOIN g b ON a.sample_id = b.sample_id AND a.vid < b.vid JOIN s ON s.sample_id = a.sample_id WHERE a.dosage IS NOT NULL AND b.dosage IS NOT NULL GROUP BY 1, 2, 3, 4")
def twolocus_table(spark, sf):
    return pairs.two_locus(fx.genotypes(spark, sf), fx.samples(spark, sf))


_CELLS = {"p": "a.dosage * b.dosage", "q": "a.dosage * (2 - b.dosage)", "r": "(2 - a.dosage) * b.dosage", "t": "(2 - a.dosage) * (2 - b.dosage)"}
_EPI = "c AS (SELECT a.vid AS v1, b.vid AS v2, " + ", ".join(f"sum(CASE WHEN {w} THEN {e} ELSE 0 END)::DOUBLE AS {k}{n}" for n, w in (("a", "aff"), ("u", "NOT aff")) for k, e in _CELLS.items()) + " FROM g a JOIN g b ON a.sample_id = b.sample_id AND a.vid < b.vid JOIN s ON s.sample_id = a.sample_id WHERE a.dosage IS NOT NULL AND b.dosage IS NOT NULL GROUP BY 1, 2)"
_LO = lambda n: f"CASE WHEN least(p{n}, q{n}, r{n}, t{n}) > 0 THEN ln(p{n}*t{n}/(q{n}*r{n})) END"
_VO = lambda n: f"(1/nullif(p{n},0) + 1/nullif(q{n},0) + 1/nullif(r{n},0) + 1/nullif(t{n},0))"


@query(f"{_EPI};;SELECT v1, v2, abs(({_LO('a')}) - ({_LO('u')})) / sqrt({_VO('a')} + {_VO('u')}) AS z FROM c", "z")
def fast_epistasis(spark, sf):
    return pairs.fast_epistasis(fx.genotypes(spark, sf), fx.samples(spark, sf))


@query(f"{_EPI};;SELECT v1, v2, abs(({_LO('a')}) / sqrt({_VO('a')})) AS z FROM c", "z")
def case_only(spark, sf):
    return pairs.fast_epistasis(fx.genotypes(spark, sf), fx.samples(spark, sf), case_only=True)


@query(f"{_EPI}, z AS (SELECT v1, v2, abs(({_LO('a')}) - ({_LO('u')})) / sqrt({_VO('a')} + {_VO('u')}) AS z FROM c), b AS (SELECT v1 AS vid, v2 AS o, z FROM z UNION ALL SELECT v2, v1, z FROM z), r AS (SELECT *, row_number() OVER (PARTITION BY vid ORDER BY z DESC, o) AS k, count(*) OVER (PARTITION BY vid) AS n FROM b WHERE z IS NOT NULL);;SELECT vid, n, o AS best, z FROM r WHERE k = 1", "z")
def best_partner(spark, sf):
    return pairs.best_partner(pairs.fast_epistasis(fx.genotypes(spark, sf), fx.samples(spark, sf)))


@query()
def haplotype_ld(spark, sf):
    return models.two_snp_em(fx.genotypes(spark, sf))


@query()
def haplotype_freq(spark, sf):
    windows = fx.variants(spark, sf).select("vid", F.floor((F.col("vid") - 1) / 4).cast("int").alias("window"))
    return models.haplotype_freq(fx.genotypes(spark, sf), windows)


# Segments


@query(f"""w AS (SELECT sample_id, chr, bp, g.vid, dosage, {{}} FROM g JOIN v USING (vid)), x AS (SELECT *, CASE WHEN ln = 6 AND het <= 2 AND ms <= 1 THEN 1 ELSE 0 END AS good, CASE WHEN ln = 6 THEN 1 ELSE 0 END AS whole FROM w),
y AS (SELECT *, coalesce(sum(good) OVER b / nullif(sum(whole) OVER b, 0)::DOUBLE >= 0.5, false) AS inside FROM x WINDOW b AS (PARTITION BY sample_id, chr ORDER BY bp ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)),
z AS (SELECT *, CASE WHEN inside AND NOT coalesce(lag(inside) OVER o, false) THEN 1 ELSE 0 END AS fresh FROM y WINDOW o AS (PARTITION BY sample_id, chr ORDER BY bp)), r AS (SELECT *, sum(fresh) OVER (PARTITION BY sample_id, chr ORDER BY bp) AS run FROM z),
q AS (SELECT sample_id, chr, min(bp) AS start, max(bp) AS stop, count(*) AS nsnp, {_N('dosage <> 1')} AS hom, {_N('dosage = 1')} AS hets FROM r WHERE inside GROUP BY sample_id, chr, run);;
SELECT sample_id, chr, start, stop, nsnp, (stop - start) / 1000.0::DOUBLE AS kb, (stop - start) / 1000.0::DOUBLE / nsnp AS density, hom / nsnp::DOUBLE AS phom, hets / nsnp::DOUBLE AS phet FROM q WHERE nsnp >= 4""".format("sum(CASE WHEN dosage = 1 THEN 1 ELSE 0 END) OVER a AS het, sum(CASE WHEN dosage IS NULL THEN 1 ELSE 0 END) OVER a AS ms, count(*) OVER a AS ln").replace("FROM g JOIN v USING (vid))", "FROM g JOIN v USING (vid) WINDOW a AS (PARTITION BY sample_id, chr ORDER BY bp ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING))"), "kb density phom phet")
def roh_windows(spark, sf):
    return segments.homozygous_runs(fx.genotypes(spark, sf), fx.variants(spark, sf), window=6, most_het=2, most_missing=1, share=0.5, least_snps=4, least_kb=0)


@query("SELECT sample_id, count(*) AS nseg, sum((bp2 - bp1) / 1000.0::DOUBLE) AS kb, avg((bp2 - bp1) / 1000.0::DOUBLE) AS kbavg FROM seg WHERE (bp2 - bp1) / 1000.0 >= 0.2 AND sites >= 3 AND type > 2 GROUP BY sample_id", "kb kbavg")
def cnv_filter_summary(spark, sf):
    return segments.cnv_summary(segments.cnv_filter(fx.segments(spark, sf), least_kb=0.2, least_sites=3, kind="dup"))


@query("SELECT a.seg_id, count(*) AS n FROM seg a JOIN seg b ON a.chr = b.chr AND a.bp1 <= b.bp2 AND b.bp1 <= a.bp2 WHERE (least(a.bp2, b.bp2) - greatest(a.bp1, b.bp1) + 1) / ((a.bp2 - a.bp1 + 1) + (b.bp2 - b.bp1 + 1) - (least(a.bp2, b.bp2) - greatest(a.bp1, b.bp1) + 1))::DOUBLE >= 0.5 GROUP BY a.seg_id")
def cnv_frequency(spark, sf):
    return segments.cnv_frequency(fx.segments(spark, sf))


@query("SELECT seg_id, sample_id FROM seg x WHERE NOT EXISTS (SELECT 1 FROM ranges r WHERE r.chr = x.chr AND x.bp1 <= r.stop AND r.start <= x.bp2 AND (least(x.bp2, r.stop) - greatest(x.bp1, r.start) + 1) / (x.bp2 - x.bp1 + 1)::DOUBLE >= 0.3)")
def cnv_exclude_regions(spark, sf):
    r = fx.ranges(spark, sf).select("chr", F.col("start").alias("bp1"), F.col("stop").alias("bp2"), "name")
    return segments.cnv_intersect(fx.segments(spark, sf), r, 0.3, exclude=True).select("seg_id", "sample_id")


@query("m AS (SELECT DISTINCT r.name, seg_id, sample_id FROM seg x JOIN ranges r ON r.chr = x.chr AND x.bp1 <= r.stop AND r.start <= x.bp2);;SELECT name, count(*) FILTER (WHERE aff) AS aff, count(*) FILTER (WHERE NOT aff) AS unaff FROM m JOIN s USING (sample_id) GROUP BY name")
def cnv_region_counts(spark, sf):
    r = fx.ranges(spark, sf).select("chr", F.col("start").alias("bp1"), F.col("stop").alias("bp2"), "name")
    return segments.cnv_region_counts(fx.segments(spark, sf), r, fx.samples(spark, sf))


@query("e AS (SELECT chr, pos, sum(d) AS d FROM (SELECT chr, bp1 AS pos, 1 AS d FROM seg UNION ALL SELECT chr, bp2 + 1, -1 FROM seg) q GROUP BY chr, pos), w AS (SELECT chr, pos AS start, lead(pos) OVER (PARTITION BY chr ORDER BY pos) - 1 AS stop, CAST(sum(d) OVER (PARTITION BY chr ORDER BY pos) AS BIGINT) AS n FROM e);;SELECT chr, start, stop, n FROM w WHERE n >= 3")
def segment_pools(spark, sf):
    return segments.run_pools(fx.segments(spark, sf).select("chr", F.col("bp1").alias("start"), F.col("bp2").alias("stop")), 3)


@query("r AS (SELECT vid, chr, bp, sum(CASE WHEN aff AND dosage = 2 THEN 1 ELSE 0 END) AS a, sum(CASE WHEN NOT aff AND dosage = 2 THEN 1 ELSE 0 END) AS u FROM g JOIN s USING (sample_id) JOIN v USING (vid) GROUP BY 1, 2, 3);;SELECT vid, CAST(sum(a) OVER w AS BIGINT) AS case_rare, CAST(sum(u) OVER w AS BIGINT) AS control_rare FROM r WINDOW w AS (PARTITION BY chr ORDER BY bp RANGE BETWEEN 2000 PRECEDING AND 2000 FOLLOWING)")
def rare_variant_window(spark, sf):
    t = assoc.genotype_table(fx.genotypes(spark, sf), fx.samples(spark, sf)).join(fx.variants(spark, sf), "vid")
    return segments.rare_window(t.select("vid", "chr", "bp", F.col("a2").alias("case_rare"), F.col("u2").alias("control_rare")), 2000)


# Networks

_PM = "pm AS (SELECT {by} a.attr_id AS i, b.attr_id AS j, count(*)::DOUBLE AS n, sum(a.value) AS sa, sum(b.value) AS sb, sum(a.value*a.value) AS saa, sum(b.value*b.value) AS sbb, sum(a.value*b.value) AS sab FROM num a JOIN num b ON a.sample_id = b.sample_id AND a.attr_id <= b.attr_id {cond} GROUP BY ALL)"
_R = "(n*sab - sa*sb) / nullif(sqrt((n*saa - sa*sa) * (n*sbb - sb*sb)), 0)"
_CO = _PM.format(by="aff,", cond="JOIN s ON s.sample_id = a.sample_id") + f", co AS (SELECT i, j, max(CASE WHEN aff THEN r END) AS r_aff, max(CASE WHEN NOT aff THEN r END) AS r_unaff, max(CASE WHEN aff THEN n END) AS n_aff, max(CASE WHEN NOT aff THEN n END) AS n_unaff FROM (SELECT aff, i, j, n, {_R} AS r FROM pm WHERE i < j) q GROUP BY i, j)"
_AT = lambda r: f"(0.5 * ln((1 + {r}) / (1 - {r})))"
_Z = f"abs({_AT('r_aff')} - {_AT('r_unaff')}) / sqrt(1/(n_aff - 3) + 1/(n_unaff - 3))"


@query(_PM.format(by="", cond="") + f";;SELECT i, j, (sab - sa*sb/n) / (n - 1) AS cov, {_R} AS r FROM pm", "cov r")
def covariance_matrix(spark, sf):
    return network.covariance(fx.numerics(spark, sf))


@query(f"{_CO};;SELECT *, r_aff - r_unaff AS diff FROM co", "r_aff r_unaff n_aff n_unaff diff")
def coexpression(spark, sf):
    return network.coexpression(fx.numerics(spark, sf), fx.samples(spark, sf))


@query(f"{_CO}, z AS (SELECT i, j, {_Z} AS z FROM co WHERE n_aff > 3 AND n_unaff > 3 AND abs(r_aff) < 1 AND abs(r_unaff) < 1);;SELECT i, j, z, 2 * {_tail('z')} AS p FROM z", "z p", 5)
def dcgain(spark, sf):
    return network.dcgain(fx.numerics(spark, sf), fx.samples(spark, sf))


@query(f"{_CO}, en AS (SELECT i AS k, r_aff, r_unaff FROM co UNION ALL SELECT j, r_aff, r_unaff FROM co), dg AS (SELECT k, sum(r_aff) + 1 AS ka, sum(r_unaff) + 1 AS ku FROM en GROUP BY k), mm AS (SELECT sum(ka) AS ma, sum(ku) AS mu FROM dg), nn AS (SELECT max(n_aff) AS na, max(n_unaff) AS nu FROM co);;SELECT co.i, co.j, abs((r_aff - a.ka*b.ka/ma) - (r_unaff - a.ku*b.ku/mu)) / sqrt(1/(na - 3) + 1/(nu - 3)) AS z FROM co JOIN dg a ON a.k = co.i JOIN dg b ON b.k = co.j, mm, nn", "z", 4)
def dmgain(spark, sf):
    return network.dmgain(fx.numerics(spark, sf), fx.samples(spark, sf))


@query(f"""pm AS (SELECT g.vid, dosage > 0 AS aff, a.attr_id AS i, b.attr_id AS j, count(*)::DOUBLE AS n, sum(a.value) AS sa, sum(b.value) AS sb, sum(a.value*a.value) AS saa, sum(b.value*b.value) AS sbb, sum(a.value*b.value) AS sab FROM num a JOIN num b ON a.sample_id = b.sample_id AND a.attr_id < b.attr_id JOIN g ON g.sample_id = a.sample_id WHERE dosage IS NOT NULL GROUP BY ALL),
co AS (SELECT vid, i, j, max(CASE WHEN aff THEN r END) AS r_aff, max(CASE WHEN NOT aff THEN r END) AS r_unaff, max(CASE WHEN aff THEN n END) AS n_aff, max(CASE WHEN NOT aff THEN n END) AS n_unaff FROM (SELECT vid, aff, i, j, n, {_R} AS r FROM pm) q GROUP BY 1, 2, 3),
z AS (SELECT vid, i, j, {_Z} AS z FROM co WHERE n_aff > 3 AND n_unaff > 3 AND abs(r_aff) < 1 AND abs(r_unaff) < 1);;SELECT vid, i, j, z, 2 * {_tail('z')} AS p FROM z""", "z p", 5)
def dcvar(spark, sf):
    return network.dcvar(fx.numerics(spark, sf), fx.genotypes(spark, sf))


def _edges(spark, sf):
    return network.covariance(fx.numerics(spark, sf)).where("i < j").select("i", "j", F.abs("r").alias("weight"))


_EDGE = _PM.format(by="", cond="") + f", ed AS (SELECT i, j, abs({_R}) AS weight FROM pm WHERE i < j)"


@query(f"{_EDGE};;SELECT i, j, CASE WHEN abs(weight) > 0.1 THEN weight ELSE 0.0 END AS weight FROM ed", "weight")
def network_threshold(spark, sf):
    return network.transform_edges(_edges(spark, sf), "hard", 0.1)


@query(f"{_EDGE}, b AS (SELECT i AS node, weight FROM ed UNION ALL SELECT j, weight FROM ed);;SELECT node, count(*) FILTER (WHERE weight <> 0) AS degree, sum(weight) AS strength FROM b GROUP BY node", "strength")
def node_degree(spark, sf):
    return network.degrees(_edges(spark, sf))


@query()
def permuted_ranks(spark, sf):
    return network.permuted_ranks(fx.numerics(spark, sf), fx.samples(spark, sf), 5)


@query()
def snprank(spark, sf):
    gain = network.dcgain(fx.numerics(spark, sf), fx.samples(spark, sf)).select("i", "j", F.col("z").alias("weight"))
    main = models.rank_by_regression(fx.numerics(spark, sf), fx.samples(spark, sf)).select(F.col("attr_id").alias("i"), F.col("attr_id").alias("j"), F.abs(F.coalesce("t", F.lit(0.0))).alias("weight"))
    names, m = network.matrix(gain.unionByName(main))
    return spark.createDataFrame([(int(k), float(x)) for k, x in zip(names, network.snprank(m), strict=True)], "attribute int, score double")


@query()
def modularity(spark, sf):
    names, m = network.matrix(network.transform_edges(_edges(spark, sf), "hard", 0.05))
    q, module = network.modularity(m)
    return spark.createDataFrame([(int(k), int(x), q) for k, x in zip(names, module, strict=True)], "node int, module int, q double")


@query()
def ripm(spark, sf):
    names, m = network.matrix(_edges(spark, sf))
    return spark.createDataFrame([(int(k), int(x)) for k, x in zip(names, network.ripm(m, 20, 4), strict=True)], "node int, module int")


@query()
def deconvolve(spark, sf):
    names, m = network.matrix(_edges(spark, sf))
    return network.edges_of(spark, names, network.deconvolve(m))


# Models and rankings


@query("q AS (SELECT attr_id, count(*)::DOUBLE AS n, var_samp(value) AS vg, var_samp(pheno) AS vy, covar_samp(value, pheno) AS cv FROM num JOIN s USING (sample_id) WHERE attr_id >= 0 GROUP BY attr_id);;" + f"SELECT attr_id, cv/vg AS beta, CASE WHEN (vy/vg - pow(cv/vg, 2)) / (n - 2) > 1e-12 THEN cv/vg / sqrt((vy/vg - pow(cv/vg, 2)) / (n - 2)) END AS t FROM q", "beta t", 5)
def regression_rank(spark, sf):
    x = models.rank_by_regression(fx.numerics(spark, sf), fx.samples(spark, sf))
    # The phenotype's own attribute fits without a remainder: no t.
    return x.select("attr_id", "beta", F.when(F.abs("t") < 1e4, F.col("t")).alias("t"))


@query("q AS (SELECT attr_id, vid, count(*) AS n, var_samp(dosage::DOUBLE) AS vg, var_samp(value) AS vy, covar_samp(dosage::DOUBLE, value) AS cv FROM g JOIN num USING (sample_id) WHERE dosage IS NOT NULL GROUP BY 1, 2);;SELECT attr_id, vid, n, cv/vg AS beta, cv/vg / sqrt((vy/vg - pow(cv/vg, 2)) / (n - 2)) AS t FROM q", "beta t", 5)
def eqtl_scan(spark, sf):
    return models.eqtl(fx.genotypes(spark, sf), fx.numerics(spark, sf))


def _cis(spark, sf):
    """Attributes' places: a fourth of them on each chromosome, a thousand bases apart."""
    a = fx.numerics(spark, sf).select("attr_id").distinct()
    t = a.select(F.col("attr_id").alias("attr"), (F.col("attr_id") % 4 + 1).cast("int").alias("chr"), (F.col("attr_id") * 1000).alias("start"), (F.col("attr_id") * 1000 + 800).alias("stop"))
    return joins.radius_join(fx.variants(spark, sf).drop("name"), t, 4000).select(F.col("attr").alias("attr_id"), "vid")


@query("t AS (SELECT DISTINCT attr_id, attr_id % 4 + 1 AS chr, attr_id * 1000 AS start, attr_id * 1000 + 800 AS stop FROM num), cs AS (SELECT attr_id, vid FROM v JOIN t ON v.chr = t.chr AND bp BETWEEN start - 4000 AND stop + 4000), q AS (SELECT attr_id, vid, count(*) AS n, var_samp(dosage::DOUBLE) AS vg, var_samp(value) AS vy, covar_samp(dosage::DOUBLE, value) AS cv FROM g JOIN num USING (sample_id) JOIN cs USING (attr_id, vid) WHERE dosage IS NOT NULL GROUP BY 1, 2);;SELECT attr_id, vid, n, cv/vg AS beta, cv/vg / sqrt((vy/vg - pow(cv/vg, 2)) / (n - 2)) AS t FROM q", "beta t", 5)
def cis_eqtl(spark, sf):
    return models.eqtl(fx.genotypes(spark, sf), fx.numerics(spark, sf), _cis(spark, sf))


def _doses(spark, sf):
    return fx.numerics(spark, sf).select("sample_id", (F.col("attr_id") + 1).alias("vid"), (F.col("value") + 1).alias("dosage"))


@query("q AS (SELECT attr_id + 1 AS vid, count(*)::DOUBLE AS n, var_samp(value + 1) AS vg, var_samp(pheno) AS vy, covar_samp(value + 1, pheno) AS cv FROM num JOIN s USING (sample_id) GROUP BY 1);;" + f"SELECT vid, CAST(n AS BIGINT) AS nanal, cv/vg AS beta, CASE WHEN vid > 1 THEN sqrt({_VAR}) END AS se, cv*cv/(vg*vy) AS r2, CASE WHEN vid > 1 THEN cv/vg / sqrt({_VAR}) END AS t FROM q", "beta se r2 t", 5)
def dosage_assoc(spark, sf):
    x = assoc.quantitative(_doses(spark, sf), fx.samples(spark, sf))
    # The phenotype's own attribute fits without a remainder.
    return x.withColumns({c: F.when(F.col("vid") > 1, F.col(c)) for c in ("se", "t")})


@query("f AS (SELECT attr_id + 1 AS vid, avg((value + 1) / 2) AS f, var_pop((value + 1) / 2) AS vv FROM num GROUP BY 1);;SELECT CAST(vid AS VARCHAR) AS name, f AS freq, 2 * vv / (f * (1 - f)) AS info FROM f", "freq info")
def dosage_info(spark, sf):
    from strandflow.sources.text import dosage_info as info

    return info(_doses(spark, sf).select(F.col("vid").cast("string").alias("name"), F.col("dosage").alias("dose")))


@query()
def linear_cov(spark, sf):
    return models.glm(fx.genotypes(spark, sf), fx.samples(spark, sf), "linear", "genotypic", ["sex"])


def _two_terms(rows: str) -> str:
    """Least squares of y on two terms by variant from moments; rows is (vid, x1, x2, y)."""
    return f"""tt AS ({rows}), mo AS (SELECT vid, count(*)::DOUBLE AS n, var_samp(x1) AS c11, var_samp(x2) AS c22, covar_samp(x1, x2) AS c12, covar_samp(x1, y) AS c1, covar_samp(x2, y) AS c2, var_samp(y) AS cy FROM tt WHERE x1 IS NOT NULL AND x2 IS NOT NULL AND y IS NOT NULL GROUP BY vid),
be AS (SELECT *, c11 * c22 - c12 * c12 AS det, (c22 * c1 - c12 * c2) / (c11 * c22 - c12 * c12) AS b1, (c11 * c2 - c12 * c1) / (c11 * c22 - c12 * c12) AS b2 FROM mo),
fi AS (SELECT *, (n - 1) * (cy - b1 * c1 - b2 * c2) / (n - 3) AS s2 FROM be)"""


_ADD = "SELECT vid, CAST(n AS INTEGER) AS n, b1 AS beta, sqrt(s2 * c22 / det / (n - 1)) AS se, b1 / sqrt(s2 * c22 / det / (n - 1)) AS stat FROM fi"


def _add_rows(x: DataFrame) -> DataFrame:
    return x.where("test = 'ADD'").select("vid", F.col("nmiss").cast("int").alias("n"), "beta", "se", "stat")


@query(_two_terms("SELECT vid, dosage::DOUBLE AS x1, sex::DOUBLE AS x2, pheno AS y FROM g JOIN s USING (sample_id)") + f";;{_ADD}", "beta se stat")
def linear_covariate(spark, sf):
    return _add_rows(models.glm(fx.genotypes(spark, sf), fx.samples(spark, sf), "linear", "add", ["sex"]))


@query(_two_terms("SELECT g.vid, g.dosage::DOUBLE AS x1, c.dosage::DOUBLE AS x2, pheno AS y FROM g JOIN s USING (sample_id) JOIN g c ON c.sample_id = g.sample_id AND c.vid = 5 WHERE g.vid <> 5") + f";;{_ADD}", "beta se stat")
def linear_conditioned(spark, sf):
    g = fx.genotypes(spark, sf)
    return _add_rows(models.glm(g.where("vid <> 5"), models.condition(fx.samples(spark, sf), g, [5]), "linear", "add", ["cond_5"]))


@query(_two_terms("SELECT vid, CASE WHEN sex = 1 AND dosage = 1 THEN NULL WHEN sex = 1 THEN dosage / 2.0::DOUBLE ELSE dosage::DOUBLE END AS x1, sex::DOUBLE AS x2, pheno AS y FROM g JOIN s USING (sample_id) JOIN v USING (vid) WHERE chr = 4") + f";;{_ADD}", "beta se stat")
def linear_on_x(spark, sf):
    v, s = fx.variants(spark, sf), fx.samples(spark, sf)
    g = filters.keep(fx.genotypes(spark, sf), v.where("chr = 4").select("vid"), "vid")
    return _add_rows(models.glm(models.x_dosage(g, v, s, 4), s, "linear", "add", ["sex"]))


@query(_two_terms("SELECT vid, dosage::DOUBLE AS x1, sex::DOUBLE AS x2, pheno AS y FROM g JOIN s USING (sample_id)") + ";;SELECT vid, ((n - 1) * cy - (n - 3) * s2) / s2 AS stat, exp(-((n - 1) * cy - (n - 3) * s2) / s2 / 2) AS p FROM fi", "stat p")
def linear_joint_test(spark, sf):
    return models.glm(fx.genotypes(spark, sf), fx.samples(spark, sf), "linear", "add", ["sex"], tests=["ADD", "sex"]).where("test = 'USER_2DF'").select("vid", "stat", "p")


@query("w AS (SELECT vid, dosage::DOUBLE AS x, pheno AS y, cluster FROM g JOIN s USING (sample_id) WHERE dosage IS NOT NULL), f AS (SELECT vid, avg(x) AS mx, avg(y) AS my, covar_samp(x, y) / var_samp(x) AS b, var_pop(x) * count(*) AS sxx FROM w GROUP BY vid), c AS (SELECT w.vid, cluster, sum((x - mx) * (y - my - b * (x - mx))) AS u FROM w JOIN f USING (vid) GROUP BY 1, 2);;SELECT vid, max(b) AS beta, sqrt(sum(u * u)) / max(sxx) AS se FROM c JOIN f USING (vid) GROUP BY vid", "beta se")
def linear_robust(spark, sf):
    return models.glm(fx.genotypes(spark, sf), fx.samples(spark, sf), "linear", "add", ["sex"], parameters=["ADD"], clusters="cluster").where("test = 'ADD'").select("vid", "beta", "se")


@query()
def logistic(spark, sf):
    return models.glm(fx.genotypes(spark, sf), fx.samples(spark, sf), "logistic", "add", ["sex"], interaction=True)


@query()
def epistasis_glm(spark, sf):
    return models.epistasis(fx.genotypes(spark, sf), fx.samples(spark, sf))


@query()
def regain(spark, sf):
    return models.regain(fx.numerics(spark, sf), fx.samples(spark, sf))


@query()
def hotelling(spark, sf):
    sets = fx.variants(spark, sf).select("vid", F.concat(F.lit("chr"), F.col("chr").cast("string")).alias("set_name"))
    return models.hotelling(fx.genotypes(spark, sf), sets, fx.samples(spark, sf))


_NEAR = """mm AS (SELECT attr_id, min(value) AS lo, max(value) AS hi FROM num GROUP BY 1), sc AS (SELECT sample_id AS id, cls, list(CASE WHEN hi > lo THEN (value - lo) / (hi - lo) ELSE 0 END ORDER BY attr_id) AS x FROM num JOIN mm USING (attr_id) JOIN s USING (sample_id) GROUP BY 1, 2),
ds AS (SELECT a.id, a.cls, b.id AS oid, b.cls AS ocls, a.x AS u, b.x AS w, list_sum(list_transform(list_zip(a.x, b.x), lambda p: abs(p[1] - p[2]))) AS dist FROM sc a JOIN sc b ON a.id <> b.id),
nr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, ocls ORDER BY round(dist, 9), oid) AS rank FROM ds) q WHERE rank <= 5), pr AS (SELECT cls, count(*) / (SELECT count(*) FROM s)::DOUBLE AS prior FROM s GROUP BY cls),
df AS (SELECT id, nr.cls, ocls, rank, unnest(range(len(u))) AS attribute, unnest(list_transform(list_zip(u, w), lambda p: abs(p[1] - p[2]))) AS d FROM nr)"""


@query(f"{_NEAR};;SELECT CAST(attribute AS INTEGER) AS attribute, sum(CASE WHEN df.cls = ocls THEN -d ELSE d * o.prior / (1 - c.prior) END) / (5.0::DOUBLE * (SELECT count(*) FROM s)) AS score FROM df JOIN pr o ON o.cls = ocls JOIN pr c ON c.cls = df.cls GROUP BY attribute", "score")
def relieff(spark, sf):
    return ranking.relieff(fx.instances(spark, sf), 5)


@query(f"{_NEAR}, ms AS (SELECT attribute, avg(d) FILTER (WHERE cls = ocls) AS mh, avg(d) FILTER (WHERE cls <> ocls) AS mm, var_pop(d) FILTER (WHERE cls = ocls) AS vh, var_pop(d) FILTER (WHERE cls <> ocls) AS vm FROM df GROUP BY attribute);;SELECT CAST(attribute AS INTEGER) AS attribute, (mm - mh) / (sqrt(vh) + sqrt(vm) + 0.05) AS score FROM ms", "score")
def reliefseq_snr(spark, sf):
    return ranking.reliefseq(fx.instances(spark, sf), 5)


_NEAR_Q = _NEAR.replace("PARTITION BY id, ocls", "PARTITION BY id").replace("SELECT sample_id AS id, cls,", "SELECT sample_id AS id, pheno AS cls,")


@query(f"{_NEAR_Q}, rg AS (SELECT max(pheno) - min(pheno) AS r, count(*)::DOUBLE AS m FROM s), sm AS (SELECT attribute, sum(abs(cls - ocls) / r * 0.2) AS ndc, sum(d * 0.2) AS nda, sum(abs(cls - ocls) / r * d * 0.2) AS bo, any_value(m) AS m FROM df, rg GROUP BY attribute);;SELECT CAST(attribute AS INTEGER) AS attribute, bo/ndc - (nda - bo)/(m - ndc) AS score FROM sm", "score", 5)
def rrelieff(spark, sf):
    x = fx.instances(spark, sf)
    return ranking.rrelieff(x.withColumn("cls", F.element_at("values", 1)), 5)


@query()
def relieff_best_k(spark, sf):
    return ranking.best_k(fx.instances(spark, sf), [3, 5, 9])


@query("c AS (SELECT vid, dosage, cls, count(*)::DOUBLE AS o FROM g JOIN s USING (sample_id) WHERE dosage IS NOT NULL GROUP BY 1, 2, 3), ro AS (SELECT vid, dosage, sum(o) AS r FROM c GROUP BY 1, 2), ko AS (SELECT vid, cls, sum(o) AS k FROM c GROUP BY 1, 2), t AS (SELECT vid, sum(o) AS n FROM c GROUP BY 1), e AS (SELECT ro.vid, r * k / n AS e, coalesce(o, 0) AS o FROM ro JOIN ko USING (vid) JOIN t USING (vid) LEFT JOIN c ON c.vid = ro.vid AND c.dosage = ro.dosage AND c.cls = ko.cls);;SELECT vid, sum(pow(o - e, 2) / e) AS chisq, any_value(df) AS df FROM e JOIN (SELECT vid, (count(DISTINCT dosage) - 1) * (count(DISTINCT cls) - 1) AS df FROM c GROUP BY vid) q USING (vid) GROUP BY vid", "chisq")
def chi_square_rank(spark, sf):
    return ranking.chi_square_rank(fx.genotypes(spark, sf), fx.samples(spark, sf))


def _h(*keys: str) -> str:
    k = ", ".join(("v1", "v2", *keys))
    return f"(SELECT v1, v2, -sum(n/t * log2(n/t)) AS h FROM (SELECT {k}, sum(n)::DOUBLE AS n FROM c GROUP BY {k}) q JOIN tt USING (v1, v2) GROUP BY v1, v2)"


@query(f"c AS (SELECT a.vid AS v1, b.vid AS v2, a.dosage AS a, b.dosage AS b, cls, count(*)::DOUBLE AS n FROM g a JOIN g b ON a.sample_id = b.sample_id AND a.vid < b.vid JOIN s ON s.sample_id = a.sample_id WHERE a.dosage IS NOT NULL AND b.dosage IS NOT NULL GROUP BY 1, 2, 3, 4, 5), tt AS (SELECT v1, v2, sum(n) AS t FROM c GROUP BY 1, 2);;SELECT v1, v2, ha.h + hb.h - hab.h AS i_ab, hac.h + hbc.h - habc.h - hc.h - (ha.h + hb.h - hab.h) AS i_ab_c FROM {_h('a')} ha JOIN {_h('b')} hb USING (v1, v2) JOIN {_h('cls')} hc USING (v1, v2) JOIN {_h('a', 'b')} hab USING (v1, v2) JOIN {_h('a', 'cls')} hac USING (v1, v2) JOIN {_h('b', 'cls')} hbc USING (v1, v2) JOIN {_h('a', 'b', 'cls')} habc USING (v1, v2)", "i_ab i_ab_c")
def interaction_information(spark, sf):
    return ranking.interaction_information(fx.genotypes(spark, sf), fx.samples(spark, sf))


@query("a AS (SELECT attr_id AS k, round(var_samp(value), 9) AS x FROM num GROUP BY 1), b AS (SELECT attr_id AS k, round(avg(value), 9) AS y FROM num GROUP BY 1), c AS (SELECT k, x, y FROM a JOIN b USING (k));;SELECT sum(sign(p.x - q.x) * sign(p.y - q.y))::DOUBLE / count(*) AS tau FROM c p JOIN c q ON p.k < q.k", "tau")
def kendall_tau(spark, sf):
    n = fx.numerics(spark, sf).groupBy(F.col("attr_id").alias("attribute"))
    return ranking.kendall_tau(n.agg(F.round(F.var_samp("value"), 9).alias("score")), n.agg(F.round(F.avg("value"), 9).alias("score")))


def _windows(spark, sf):
    return fx.variants(spark, sf).select("vid", F.floor((F.col("vid") - 1) / 4).cast("int").alias("window"))


@query()
def haplotype_case_control(spark, sf):
    return haplotypes.haplotype_case_control(haplotypes.phase(fx.genotypes(spark, sf), _windows(spark, sf)), fx.samples(spark, sf))


@query()
def haplotype_quantitative(spark, sf):
    return haplotypes.haplotype_quantitative(haplotypes.phase(fx.genotypes(spark, sf), _windows(spark, sf)), fx.samples(spark, sf))


@query()
def haplotype_impute(spark, sf):
    return haplotypes.impute(fx.genotypes(spark, sf), _windows(spark, sf))


@query()
def mishap(spark, sf):
    return haplotypes.mishap(fx.genotypes(spark, sf), fx.variants(spark, sf))


def _chr_sets(spark, sf):
    return fx.variants(spark, sf).select("vid", F.concat(F.lit("chr"), F.col("chr").cast("string")).alias("set_name"))


@query()
def ld_set_test(spark, sf):
    g = fx.genotypes(spark, sf)
    return sets.ld_set_test(assoc.allelic(g, fx.samples(spark, sf)), pairs.ld(g), _chr_sets(spark, sf), 0.01)


@query()
def set_screen(spark, sf):
    g = fx.genotypes(spark, sf)
    return sets.set_screen(assoc.allelic(g, fx.samples(spark, sf)), pairs.ld(g), _chr_sets(spark, sf))


@query()
def set_stepwise(spark, sf):
    return sets.stepwise(fx.genotypes(spark, sf), _chr_sets(spark, sf), fx.samples(spark, sf))


@query()
def vif_prune(spark, sf):
    return sets.vif_prune(fx.genotypes(spark, sf), fx.variants(spark, sf), 16, 1.05)


@query()
def gene_pair_test(spark, sf):
    s = _chr_sets(spark, sf)
    names = [f"chr{i}" for i in range(1, 5)]
    todo = spark.createDataFrame([(a, b) for i, a in enumerate(names) for b in names[i + 1 :]], "set1 string, set2 string")
    return sets.gene_pair_test(fx.genotypes(spark, sf), s, fx.samples(spark, sf), todo)


@query()
def genotype_mh(spark, sf):
    return sets.genotype_mh(fx.genotypes(spark, sf), _strata(spark, sf))


@query()
def generic_variants(spark, sf):
    d = F.col("dosage")
    gv = fx.genotypes(spark, sf).select("sample_id", F.concat(F.lit("v"), F.col("vid").cast("string")).alias("name"), d.alias("dose1"), (2 - d + F.col("sample_id") % 2).alias("dose2"))
    return sets.generic_variant_tests(gv, fx.samples(spark, sf), "linear")


@query(f"{_IBS}, d AS (SELECT i, j, (0.5 * ibs1 + ibs2) / (ibs0 + ibs1 + ibs2)::DOUBLE AS dst FROM ib);;SELECT CASE WHEN a.aff AND b.aff THEN 'AFF/AFF' WHEN NOT a.aff AND NOT b.aff THEN 'UNAFF/UNAFF' ELSE 'AFF/UNAFF' END AS grp, count(*) AS n, avg(dst) AS mean, stddev_samp(dst) AS sd FROM d JOIN s a ON a.sample_id = i JOIN s b ON b.sample_id = j GROUP BY 1", "mean sd")
def ibs_groups(spark, sf):
    return relatives.similar_groups(fx.genotypes(spark, sf), fx.samples(spark, sf))


@query()
def ibs_test(spark, sf):
    return relatives.similar_test(fx.genotypes(spark, sf), fx.samples(spark, sf), 20)


@query(f"{_IBS}, cl AS (SELECT i, j FROM ib WHERE (0.5 * ibs1 + ibs2) / (ibs0 + ibs1 + ibs2)::DOUBLE >= 0.72), e AS (SELECT i AS id, j AS o FROM cl UNION ALL SELECT j, i FROM cl);;WITH RECURSIVE r AS (SELECT id, o FROM e UNION SELECT r.id, e.o FROM r JOIN e ON r.o = e.id) SELECT id, min(least(id, o)) AS grp FROM r GROUP BY id")
def genome_groups(spark, sf):
    return relatives.groups(pairs.close(fx.genotypes(spark, sf), 0.72), 0.72, "dst")


@query()
def random_forest(spark, sf):
    return ranking.forest_scores(fx.instances(spark, sf), trees=30, depth=5)


# Further queries register themselves.
from strandflow.plans import formats  # noqa: E402, F401
