"""Registered queries that write a format, read it back, and return what was read; and those of the recodes and list operators.

Files go to the folder that all executors share and are deleted when the application ends.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.lineage import _place, shared_dir
from strandflow.operators import family, filters, joins, pairs, ranking, recodes, relatives, segments, summaries
from strandflow.plans import fixtures as fx
from strandflow.plans.registry import _N, query
from strandflow.sources import bed, sinks, text


def stored(lines: DataFrame, name: str, codec: str = "none") -> str:
    """The lines as text files in the shared folder; where they are."""
    spark = lines.sparkSession
    path = f"{shared_dir(spark)}/strandflow-{name}-{uuid.uuid4().hex}"
    sinks.write_lines(lines.select("value"), path, codec)
    at, files = _place(spark, path)
    files.deleteOnExit(at)
    return path


# Fixtures with alleles and pedigrees


def _lettered(spark, sf) -> DataFrame:
    vid = F.col("vid")
    letter = lambda k: F.substring(F.lit("ACGT"), (vid + k) % 4 + 1, F.lit(1))
    return fx.variants(spark, sf).select((vid - 1).alias("idx"), "vid", "chr", "name", F.lit(0.0).alias("cm"), "bp", letter(0).alias("a1"), letter(1).alias("a2"))


def _people(spark, sf) -> DataFrame:
    i = F.col("sample_id")
    parent = lambda k: F.when(i % 3 == 2, F.concat(F.lit("I"), (i - k).cast("string"))).otherwise("0")
    pheno = F.when(i % 7 != 0, F.when(F.col("aff"), 2.0).otherwise(1.0))
    return fx.samples(spark, sf).select(i.cast("int").alias("idx"), "sample_id", F.concat(F.lit("F"), F.floor(i / 3).cast("string")).alias("fid"), F.concat(F.lit("I"), i.cast("string")).alias("iid"), parent(2).alias("pat"), parent(1).alias("mat"), "sex", pheno.alias("pheno"), "aff", "cluster")


def _calls(spark, sf) -> DataFrame:
    d = F.col("dosage")
    x = fx.genotypes(spark, sf).join(_lettered(spark, sf), "vid").join(_people(spark, sf).select("sample_id", "fid", "iid"), "sample_id")
    return x.select("fid", "iid", "name", F.when(d >= 1, F.col("a1")).when(d == 0, F.col("a2")).alias("a"), F.when(d == 2, F.col("a1")).when(d <= 1, F.col("a2")).alias("b"))


_LET = "lv AS (SELECT vid - 1 AS idx, vid, chr, name, bp, substr('ACGT', vid % 4 + 1, 1) AS a1, substr('ACGT', (vid + 1) % 4 + 1, 1) AS a2 FROM v)"
_PEO = "pe AS (SELECT CAST(sample_id AS INTEGER) AS idx, sample_id, 'F' || (sample_id // 3) AS fid, 'I' || sample_id AS iid, CASE WHEN sample_id % 3 = 2 THEN 'I' || (sample_id - 2) ELSE '0' END AS pat, CASE WHEN sample_id % 3 = 2 THEN 'I' || (sample_id - 1) ELSE '0' END AS mat, sex, CASE WHEN sample_id % 7 <> 0 THEN CASE WHEN aff THEN 2.0 ELSE 1.0 END END::DOUBLE AS pheno, aff, cluster FROM s)"
_CL = f"{_LET}, {_PEO}, cl AS (SELECT fid, iid, pe.idx AS who, lv.idx AS pos, name, a1, a2, dosage, CASE WHEN dosage >= 1 THEN a1 WHEN dosage = 0 THEN a2 END AS a, CASE WHEN dosage = 2 THEN a1 WHEN dosage <= 1 THEN a2 END AS b FROM g JOIN lv USING (vid) JOIN pe USING (sample_id))"
_READ = f"{_CL};;SELECT fid, iid, name, a, b FROM cl"


# Genotype files


def _ped(spark, sf):
    v = _lettered(spark, sf)
    at = stored(sinks.ped_lines(_calls(spark, sf), _people(spark, sf), v), "ped")
    return text.ped(spark, at, stored(sinks.in_one(sinks.table_lines(v.select("chr", "name", "cm", "bp")), ["bp"]), "map"))


@query(_READ)
def ped_file(spark, sf):
    return _ped(spark, sf)[2]


@query(f"{_PEO};;SELECT fid, iid, pat, mat, sex, pheno FROM pe", "pheno")
def ped_people(spark, sf):
    return _ped(spark, sf)[0]


@query(_READ)
def tped_file(spark, sf):
    who = _people(spark, sf)
    at = stored(sinks.tped_lines(_calls(spark, sf), who, _lettered(spark, sf)), "tped", "gzip")
    fam = sinks.in_one(sinks.table_lines(who.select("idx", "fid", "iid", "pat", "mat", "sex", "pheno"), "-9").withColumn("value", F.regexp_replace("value", r"^\S+ ", "")), ["idx"])
    return text.tped(spark, at, stored(fam, "tfam"))[2]


@query(_READ)
def lgen_file(spark, sf):
    return text.lgen(spark, stored(sinks.lgen_lines(_calls(spark, sf)), "lgen"))


@query(_READ)
def lgen_by_reference(spark, sf):
    g, ref = _calls(spark, sf), _lettered(spark, sf).select("name", "a1")
    return text.fill_reference(text.lgen(spark, stored(sinks.lgen_lines(g, ref), "lgen")), _people(spark, sf), ref)


@query("SELECT sample_id::INTEGER AS sample_id, CAST(vid - 1 AS INTEGER) AS vid, dosage FROM g")
def bed_file(spark, sf):
    # The folder of a list of the samples takes the three files too.
    prefix = f"{stored(_people(spark, sf).select(F.col('iid').alias('value')), 'bed')}/x"
    g = fx.genotypes(spark, sf).select(F.col("sample_id").cast("int").alias("sample_id"), (F.col("vid") - 1).cast("int").alias("vid"), "dosage")
    bed.write_bed(g, _people(spark, sf).na.fill(-9.0, ["pheno"]), _lettered(spark, sf), prefix)
    return bed.read_bed(spark, prefix)[2]


@query(f"{_CL}, n AS (SELECT name, a1, a2, sum(dosage) AS x, sum(2 - dosage) AS y FROM cl GROUP BY ALL), t AS (SELECT name, a1, a2, x < y OR (x = y AND a1 < a2) AS same FROM n);;SELECT fid, iid, name, CASE WHEN same THEN dosage ELSE 2 - dosage END AS dosage FROM cl JOIN t USING (name)")
def rarer_allele_dosage(spark, sf):
    return text.to_dosage(_calls(spark, sf))[1]


@query(f"{_CL}, k AS (SELECT *, CASE WHEN dosage IS NULL THEN 'NIL' WHEN dosage = 2 THEN 'HOM' WHEN dosage = 1 THEN 'HET' END AS kind FROM cl);;SELECT name || ' ' || kind || ' ' || CASE WHEN kind = 'HET' THEN a2 ELSE a1 END || ' ' || a1 || ' ' || string_agg(fid || ' ' || iid, ' ' ORDER BY fid || ' ' || iid) AS value FROM k WHERE kind IS NOT NULL GROUP BY name, kind, a1, a2")
def rare_call_list(spark, sf):
    return sinks.rlist_lines(_calls(spark, sf), _lettered(spark, sf))


@query(f"{_CL};;SELECT name, coalesce(a, '0') || '/' || coalesce(b, '0') AS genotype, string_agg(fid || ' ' || iid, ',' ORDER BY fid || ' ' || iid) AS samples FROM cl GROUP BY 1, 2")
def genotype_list(spark, sf):
    return sinks.genotype_list(_calls(spark, sf)).withColumn("samples", F.concat_ws(",", "samples"))


@query(f"{_CL};;SELECT x.name, x.a AS a1, x.b AS b1, y.a AS a2, y.b AS b2, 2 - abs(x.dosage - y.dosage) AS ibs FROM cl x JOIN cl y USING (name) WHERE x.iid = 'I1' AND y.iid = 'I2'")
def pair_list(spark, sf):
    return sinks.pair_list(_calls(spark, sf), ("F0", "I1"), ("F0", "I2"))


@query(f"{_CL};;SELECT name, coalesce(a, '0') || '/' || coalesce(b, '0') AS genotype FROM cl WHERE iid = 'I4'")
def sample_report(spark, sf):
    return sinks.sample_report(_calls(spark, sf), "F1", "I4")


@query(f"{_CL};;SELECT '# ID ' || iid AS id, string_agg(coalesce(a, '?'), '' ORDER BY pos) AS first, string_agg(coalesce(b, '?'), '' ORDER BY pos) AS second FROM cl GROUP BY iid")
def phase_rows(spark, sf):
    return sinks.fastphase_lines(_calls(spark, sf), _lettered(spark, sf))


@query(f"{_CL};;SELECT iid || ' ' || string_agg(CASE dosage WHEN 2 THEN '1 1' WHEN 1 THEN '1 2' WHEN 0 THEN '2 2' ELSE '0 0' END, ' ' ORDER BY pos) AS value FROM cl GROUP BY iid")
def structure_rows(spark, sf):
    return sinks.structure_lines(_calls(spark, sf), _lettered(spark, sf))


@query(f"{_CL};;SELECT name || ',' || string_agg(coalesce(a, '?') || coalesce(b, '?'), ',' ORDER BY who) AS value FROM cl GROUP BY name")
def mean_genotype_rows(spark, sf):
    return sinks.bimbam_lines(_calls(spark, sf), _people(spark, sf))


# Side files


@query(f"{_PEO};;SELECT fid, iid, attr_id, 'x' || attr_id AS attr, value FROM num JOIN pe USING (sample_id)", "value")
def numeric_file(spark, sf):
    num = fx.numerics(spark, sf).join(_people(spark, sf), "sample_id")
    head = " ".join(["FID", "IID", *(f"x{i}" for i in range(64))])
    return text.numeric_file(spark, stored(sinks.in_one(sinks.numeric_lines(num), ["fid", "iid"], head), "num"))


@query(f"{_PEO};;SELECT fid, iid, 1 AS column, 'trait' AS name, pheno FROM pe UNION ALL SELECT fid, iid, 2, 'cluster', cluster::DOUBLE FROM pe", "pheno")
def phenotype_file(spark, sf):
    rows = sinks.table_lines(_people(spark, sf).select("fid", "iid", "pheno", "cluster"), "-9")
    return text.phenotypes(spark, stored(sinks.in_one(rows, ["fid", "iid"], "FID IID trait cluster"), "pheno"))


@query(f"{_PEO};;SELECT fid, iid, 'c' || cluster AS label, CAST(dense_rank() OVER (ORDER BY 'c' || cluster) - 1 AS INTEGER) AS cluster FROM pe")
def cluster_file(spark, sf):
    return text.clusters(spark, stored(sinks.table_lines(_people(spark, sf).select("fid", "iid", F.concat(F.lit("c"), F.col("cluster").cast("string")).alias("label"))), "clusters"))


@query("SELECT 'chr' || chr AS set_name, name FROM v")
def set_file(spark, sf):
    x = fx.variants(spark, sf).select(F.concat(F.lit("chr"), F.col("chr").cast("string")).alias("set_name"), "name")
    return text.sets(spark, stored(sinks.in_one(sinks.set_lines(x), ["set_name"]), "sets"))


@query("SELECT CAST(chr AS INTEGER) AS chr, greatest(start - 1000, 0) AS start, stop + 1000 AS stop, regexp_replace(name, '^.*/', 'g') AS name, replace(grp, ' ', '_') AS grp FROM ranges")
def range_file(spark, sf):
    r = fx.ranges(spark, sf).withColumn("name", F.regexp_replace("name", "^.*/", "g")).withColumn("grp", F.replace("grp", F.lit(" "), F.lit("_")))
    return text.range_list(spark, stored(sinks.table_lines(r), "ranges"), 1)


@query("SELECT 'f' || sample_id AS fid, 'i' || sample_id AS iid, chr, bp1, bp2, type, score, sites FROM seg", "score")
def cnv_file(spark, sf):
    who = lambda c: F.concat(F.lit(c), F.col("sample_id").cast("string"))
    x = fx.segments(spark, sf).select(who("f").alias("fid"), who("i").alias("iid"), "chr", "bp1", "bp2", "type", "score", "sites")
    return text.cnv_list(spark, stored(sinks.table_lines(x), "cnv", "gzip"))


@query("SELECT 'chr' || chr || chr(9) || bp1 || chr(9) || bp2 || chr(9) || 'f' || sample_id || '_' || 'i' || sample_id || chr(9) || sites AS value FROM seg")
def segment_track(spark, sf):
    who = lambda c: F.concat(F.lit(c), F.col("sample_id").cast("string"))
    return sinks.segment_track(fx.segments(spark, sf).select(who("f").alias("fid"), who("i").alias("iid"), "chr", "bp1", "bp2", F.col("sites").alias("score")))


@query("SELECT 'f' || sample_id AS fid, 'i' || sample_id AS iid, chr, bp1, bp2, sites AS n FROM seg")
def homozygous_run_file(spark, sf):
    x = fx.segments(spark, sf)
    rows = sinks.table_lines(x.select(F.concat(F.lit("f"), F.col("sample_id").cast("string")).alias("FID"), F.concat(F.lit("i"), F.col("sample_id").cast("string")).alias("IID"), F.col("chr").alias("CHR"), F.col("bp1").alias("POS1"), F.col("bp2").alias("POS2"), F.col("sites").alias("NSNP")))
    return text.runs_of_homozygosity(spark, stored(sinks.in_one(rows, ["FID", "CHR", "POS1"], "FID IID CHR POS1 POS2 NSNP"), "hom"))


@query("SELECT 'f' || sample_id AS fid1, 'i' || sample_id AS iid1, 'f' || (sample_id + 1) AS fid2, 'i' || (sample_id + 1) AS iid2, chr, bp1, bp2 FROM seg")
def shared_segment_file(spark, sf):
    who = lambda c, k: F.concat(F.lit(c), (F.col("sample_id") + k).cast("string"))
    rows = sinks.table_lines(fx.segments(spark, sf).select(who("f", 0).alias("FID1"), who("i", 0).alias("IID1"), who("f", 1).alias("FID2"), who("i", 1).alias("IID2"), F.col("chr").alias("CHR"), F.col("bp1").alias("BP1"), F.col("bp2").alias("BP2")))
    return text.shared_segments(spark, stored(sinks.in_one(rows, ["FID1", "CHR", "BP1"], "FID1 IID1 FID2 IID2 CHR BP1 BP2"), "segment"))


_FQ = "fq AS (SELECT vid, sum(dosage) / nullif(2 * count(dosage), 0)::DOUBLE AS freq, 2 * count(dosage) AS n FROM g GROUP BY vid)"


@query(f"{_LET}, {_FQ};;SELECT name, a1, a2, CASE WHEN vid % 5 <> 0 THEN freq END AS freq FROM lv JOIN fq USING (vid)", "freq")
def frequency_file(spark, sf):
    v, f = _lettered(spark, sf), summaries.allele_freq(fx.genotypes(spark, sf))
    turn, wrong = F.col("vid") % 3 == 0, F.col("vid") % 5 == 0
    # A third of the file's rows name the other allele, a fifth alleles that the variant doesn't have.
    x = v.join(f, "vid").select(F.col("chr").alias("CHR"), F.col("name").alias("SNP"), F.when(wrong, "N").when(turn, F.col("a2")).otherwise(F.col("a1")).alias("A1"), F.when(turn, F.col("a1")).otherwise(F.col("a2")).alias("A2"), F.when(turn, 1 - F.col("freq")).otherwise(F.col("freq")).alias("MAF"), F.col("nchrobs").alias("NCHROBS"))
    path = stored(sinks.in_one(sinks.table_lines(x), ["SNP"], "CHR SNP A1 A2 MAF NCHROBS"), "frq")
    return text.read_frequencies(text.frequencies(spark, path), v)


@query("SELECT 0 AS file, name, weight / 10 AS p FROM wt JOIN v USING (vid) WHERE vid % 4 <> 0 UNION ALL SELECT 1, name, q / 100 FROM wt JOIN v USING (vid)", "p")
def result_files(spark, sf):
    x = fx.weights(spark, sf).join(fx.variants(spark, sf), "vid")
    one = sinks.table_lines(x.select(F.col("name").alias("SNP"), F.when(F.col("vid") % 4 != 0, F.col("weight") / 10).alias("P")))
    two = sinks.table_lines(x.select((F.col("q") / 100).alias("P"), F.col("name").alias("SNP")))
    return text.results(spark, [stored(sinks.in_one(one, ["SNP"], "SNP P"), "assoc"), stored(sinks.in_one(two, ["SNP"], "P SNP"), "assoc")])


_ED = "ed AS (SELECT 'v' || a.i AS i, 'v' || b.i AS j, ((a.i * 7 + b.i * 3) % 11 / 4.0)::DOUBLE AS weight FROM range(10, 30) a(i) JOIN range(10, 30) b(i) ON a.i <= b.i)"


def _edges(spark) -> DataFrame:
    a, b = spark.range(10, 30).select(F.col("id").alias("x")), spark.range(10, 30).select(F.col("id").alias("y"))
    name = lambda c: F.concat(F.lit("v"), F.col(c).cast("string"))
    return a.join(b, F.col("x") <= F.col("y")).select(name("x").alias("i"), name("y").alias("j"), ((F.col("x") * 7 + F.col("y") * 3) % 11 / 4.0).alias("weight"))


@query(f"{_ED};;SELECT * FROM ed", "weight")
def matrix_file(spark, sf):
    names = [f"v{k}" for k in range(10, 30)]
    return text.matrix_file(spark, stored(sinks.in_one(sinks.matrix_lines(_edges(spark), names, upper=True), ["row"], " ".join(names)), "matrix"))


@query(f"{_ED};;SELECT i, j, weight FROM ed WHERE abs(weight) > 0.6 AND i <> j", "weight")
def sif_file(spark, sf):
    return text.sif(spark, stored(sinks.sif_lines(_edges(spark), 0.6), "sif"))


@query("SELECT CAST(s.cls AS INTEGER) AS cls, attr_id AS at, value FROM num JOIN s USING (sample_id)", "value")
def delimited_file(spark, sf):
    x = fx.instances(spark, sf)
    head = "\t".join([*(f"x{i}" for i in range(64)), "class"])
    rows = sinks.delimited(x)
    return text.instances(spark, stored(sinks.in_one(rows, [], head), "tab")).select("cls", F.posexplode("values").alias("at", "value"))


_DO = f"{_LET}, {_PEO}, ds AS (SELECT fid, iid, name, a1, a2, (sample_id * 3 + vid * 5) % 21 / 10.0::DOUBLE AS dose FROM g JOIN lv USING (vid) JOIN pe USING (sample_id))"


def _dosage_file(spark, sf) -> DataFrame:
    d = fx.genotypes(spark, sf).join(_lettered(spark, sf), "vid").join(_people(spark, sf).select("sample_id", "fid", "iid"), "sample_id")
    d = d.select("fid", "iid", "name", "a1", "a2", ((F.col("sample_id") * 3 + F.col("vid") * 5) % 21 / 10.0).alias("dose"))
    return text.dosages(spark, stored(sinks.dosage_lines(d, _people(spark, sf)), "dose", "gzip"), _people(spark, sf), numbers=1)


@query(f"{_DO};;SELECT fid, iid, name, a1, a2, dose FROM ds", "dose")
def dosage_file(spark, sf):
    return _dosage_file(spark, sf)


@query(f"{_DO};;SELECT name, {_N('dose IN (0, 0.1, 1.9, 2, 0.9, 1, 1.1)')} AS called, count(*) AS n FROM ds GROUP BY name")
def dosage_calls(spark, sf):
    # A little above a tenth, so that no call hangs on the last bit of a difference.
    return text.hard_calls(_dosage_file(spark, sf), 0.11).groupBy("name").agg(F.count("dosage").alias("called"), F.count("*").alias("n"))


@query(f"{_CL};;SELECT fid, iid, name, a1 AS allele1, dosage / 1.0::DOUBLE AS dose1, a2 AS allele2, (2 - dosage) / 1.0::DOUBLE AS dose2 FROM cl", "dose1 dose2")
def generic_variant_file(spark, sf):
    d = F.col("dosage").cast("double")
    x = fx.genotypes(spark, sf).join(_lettered(spark, sf), "vid").join(_people(spark, sf).select("sample_id", "fid", "iid"), "sample_id")
    return text.generic_variants(spark, stored(sinks.table_lines(x.select("fid", "iid", "name", F.col("a1").alias("al1"), d.alias("d1"), F.col("a2").alias("al2"), (2 - d).alias("d2"))), "gvar"))


_CT = "ct AS (SELECT 'a' || attr_id AS gene, 's' || label AS sample, count(*) FILTER (WHERE value > 0) AS n FROM num JOIN (SELECT sample_id, cluster AS label FROM s) USING (sample_id) GROUP BY ALL)"


def _counts(spark, sf) -> DataFrame:
    """How many instances of a class have a positive value, as if read counts of genes by sample."""
    x = fx.numerics(spark, sf).join(fx.samples(spark, sf), "sample_id")
    levels = [r.cluster for r in fx.samples(spark, sf).select("cluster").distinct().orderBy("cluster").collect()]
    wide = x.groupBy("attr_id").pivot("cluster", levels).agg(F.sum((F.col("value") > 0).cast("long")))
    rows = sinks.table_lines(wide.select(F.concat(F.lit("a"), F.col("attr_id").cast("string")).alias("gene"), *(F.col(f"`{c}`").alias(f"s{c}") for c in levels)))
    return text.counts_table(spark, stored(sinks.in_one(rows, ["gene"], " ".join(["gene", *(f"s{c}" for c in levels)])), "counts"))


@query(f"{_CT};;SELECT gene, sample, n FROM ct")
def counts_file(spark, sf):
    return _counts(spark, sf)


@query(f"{_CT};;SELECT sample, CAST(sum(n) AS BIGINT) AS depth, {_N('n > 0')} AS genes, max(n) AS most FROM ct GROUP BY sample")
def reads_by_sample(spark, sf):
    return summaries.reads_by_sample(_counts(spark, sf))


# Recodes and updates


@query(f"{_PEO};;SELECT fid, iid, CASE WHEN cluster = 3 THEN 2.0 ELSE 1.0 END::DOUBLE AS pheno FROM pe", "pheno")
def phenotype_of_label(spark, sf):
    s = _people(spark, sf).drop("pheno")
    labels = s.select("sample_id", F.concat(F.lit("c"), F.col("cluster").cast("string")).alias("label"))
    return recodes.make_phenotype(s, labels, "c3").select("fid", "iid", "pheno")


@query(f"{_LET};;SELECT name, CASE WHEN vid % 3 = 0 THEN translate(a1, 'ACGT', 'TGCA') ELSE a1 END AS a1, CASE WHEN vid % 3 = 0 THEN translate(a2, 'ACGT', 'TGCA') ELSE a2 END AS a2 FROM lv")
def flip_strand(spark, sf):
    v = _lettered(spark, sf)
    # A name listed twice is turned once.
    names = v.where("vid % 3 = 0").select("name")
    return recodes.flip_strand(v, names.unionByName(names)).select("name", "a1", "a2")


@query(f"{_LET};;SELECT vid, CAST(sum(CASE WHEN vid % 2 = 0 THEN 2 - dosage ELSE dosage END) AS BIGINT) AS copies FROM g GROUP BY vid")
def reference_allele(spark, sf):
    v = _lettered(spark, sf)
    refs = v.select("name", F.when(F.col("vid") % 2 == 0, F.col("a2")).otherwise(F.col("a1")).alias("allele"))
    return recodes.reference_allele(fx.genotypes(spark, sf), v, refs).groupBy("vid").agg(F.sum("dosage").alias("copies"))


@query(f"{_LET};;SELECT name, translate(a1, 'ACGT', '1234') AS n1, translate(a2, 'ACGT', '1234') AS n2, a1 AS l1, a2 AS l2 FROM lv")
def allele_codes(spark, sf):
    n = [recodes.to_numbers(F.col(c)) for c in ("a1", "a2")]
    return _lettered(spark, sf).select("name", n[0].alias("n1"), n[1].alias("n2"), recodes.to_letters(n[0]).alias("l1"), recodes.to_letters(n[1]).alias("l2"))


@query(f"{_PEO};;SELECT iid, pheno = 2 AS usual, pheno - 1 = 1 AS zero_one FROM pe")
def affection_codes(spark, sf):
    p = F.col("pheno")
    return _people(spark, sf).select("iid", recodes.affection(p).alias("usual"), recodes.affection(p - 1, zero_one=True).alias("zero_one"))


@query(f"{_PEO};;SELECT CASE WHEN sample_id % 4 = 0 THEN 'N' || fid ELSE fid END AS fid, CASE WHEN sample_id % 4 = 0 THEN 'N' || iid ELSE iid END AS iid, pat, mat FROM pe")
def update_ids(spark, sf):
    s = _people(spark, sf).select("sample_id", "fid", "iid", "pat", "mat")
    new = s.where("sample_id % 4 = 0").select("sample_id", F.concat(F.lit("N"), "fid").alias("fid"), F.concat(F.lit("N"), "iid").alias("iid"))
    return recodes.update(s, new, "sample_id", ["fid", "iid"]).drop("sample_id")


@query(f"{_LET};;SELECT name, CASE WHEN vid < 20 THEN 'A' ELSE a1 END AS a1, CASE WHEN vid < 20 THEN 'B' ELSE a2 END AS a2 FROM lv")
def update_alleles(spark, sf):
    v = _lettered(spark, sf).select("vid", "name", "a1", "a2")
    new = v.where("vid < 20").select("name", F.lit("A").alias("a1"), F.lit("B").alias("a2"))
    return recodes.update(v, new, "name", ["a1", "a2"]).drop("vid")


_GONE = f"{_PEO}, here AS (SELECT * FROM pe WHERE sample_id % 9 <> 0)"


@query(f"{_GONE};;SELECT iid, NOT EXISTS (SELECT 1 FROM here p WHERE p.fid = k.fid AND p.iid = k.pat) AND NOT EXISTS (SELECT 1 FROM here p WHERE p.fid = k.fid AND p.iid = k.mat) AS founder FROM here k")
def founders(spark, sf):
    return recodes.make_founders(_people(spark, sf).where("sample_id % 9 <> 0")).select("iid", "founder")


@query(f"{_GONE};;SELECT fid, pat AS iid, 1 AS sex FROM here k WHERE pat <> '0' AND NOT EXISTS (SELECT 1 FROM here p WHERE p.fid = k.fid AND p.iid = k.pat)")
def missing_parents(spark, sf):
    return recodes.missing_parents(_people(spark, sf).where("sample_id % 9 <> 0"))


@query(f"{_GONE};;SELECT k.sample_id AS kid, f.sample_id AS father, m.sample_id AS mother FROM here k LEFT JOIN here f ON f.fid = k.fid AND f.iid = k.pat LEFT JOIN here m ON m.fid = k.fid AND m.iid = k.mat")
def trio_rows(spark, sf):
    return joins.trios(_people(spark, sf).where("sample_id % 9 <> 0"))


@query("SELECT sample_id, " + ", ".join(f"max(dosage) FILTER (WHERE vid = {k}) AS v{k}, CAST(max(dosage) FILTER (WHERE vid = {k}) = 1 AS INTEGER) AS v{k}_het" for k in (1, 2, 63, 64)) + " FROM g GROUP BY sample_id")
def recode_dominance(spark, sf):
    return recodes.recode_additive(fx.genotypes(spark, sf), [1, 2, 63, 64], dominance=True)


_OB = "ob AS (SELECT g.*, s.cluster, g.vid % 10 = s.cluster AS design FROM g JOIN s USING (sample_id))"


@query(f"{_OB};;SELECT vid, {_N('dosage IS NULL AND NOT design')} AS n_miss, {_N('design')} AS n_design, {_N('NOT design')} AS n_geno, {_N('dosage IS NULL AND NOT design')} / nullif({_N('NOT design')}, 0)::DOUBLE AS f_miss FROM ob GROUP BY vid", "f_miss")
def obligatory_missing(spark, sf):
    s = fx.samples(spark, sf)
    blocks = fx.variants(spark, sf).select("vid", (F.col("vid") % 10).cast(s.schema["cluster"].dataType).alias("cluster"))
    return summaries.missing_but_by_design(recodes.obligatory_missing(fx.genotypes(spark, sf), s, blocks.unionByName(blocks)), "vid")


# Filters, sets, orders


_TI = "a1 || a2 IN ('AG', 'GA', 'CT', 'TC')"


@query(f"{_LET}, mixed AS (SELECT chr, a1, CASE WHEN vid % 3 = 0 THEN substr('ACGT', (vid + 2) % 4 + 1, 1) ELSE a2 END AS a2 FROM lv);;SELECT chr, {_N(_TI)} AS ti, {_N('NOT ' + _TI)} AS tv, {_N(_TI)} / nullif({_N('NOT ' + _TI)}, 0)::DOUBLE AS ratio FROM mixed GROUP BY chr", "ratio")
def transitions(spark, sf):
    third = F.substring(F.lit("ACGT"), (F.col("vid") + 2) % 4 + 1, F.lit(1))
    return summaries.transitions(_lettered(spark, sf).withColumn("a2", F.when(F.col("vid") % 3 == 0, third).otherwise(F.col("a2"))))


@query("SELECT sample_id, avg(value) AS mean, var_samp(value) AS var, stddev_samp(value) AS sd, stddev_samp(value) / nullif(avg(value), 0) AS cv FROM num GROUP BY sample_id", "mean var sd cv", 4)
def numeric_by_sample(spark, sf):
    return summaries.numeric_summary(fx.numerics(spark, sf), "sample_id")


@query("SELECT name, chr FROM v WHERE (vid % 4 = 1 OR vid % 3 = 0) AND vid % 5 <> 0")
def attribute_filter(spark, sf):
    vid = F.col("vid")
    tags = F.filter(F.array(F.when(vid % 4 == 1, "exon"), F.when(vid % 3 == 0, "coding"), F.when(vid % 5 == 0, "failed"), F.lit("any")), lambda x: x.isNotNull())
    return filters.has_attributes(fx.variants(spark, sf), tags, "exon,coding,-failed").select("name", "chr")


@query("SELECT vid, weight FROM wt ORDER BY weight DESC, vid LIMIT 10", "weight")
def top_weights(spark, sf):
    return filters.top_n(fx.weights(spark, sf).select("vid", "weight"), 10, "weight", "vid")


@query("SELECT vid, q / 100 AS p FROM wt WHERE q / 100 <= 0.25", "p")
def p_value_filter(spark, sf):
    return filters.pfilter(fx.weights(spark, sf).select("vid", (F.col("q") / 100).alias("p")), 0.25)


@query("SELECT sample_id, chr, count(*) AS n FROM seg GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, sf):
    return filters.duplicates(fx.segments(spark, sf), "sample_id", "chr")


@query("t AS (SELECT vid, CASE WHEN vid % 8 = 0 THEN 1 WHEN vid % 8 = 1 THEN NULL ELSE dosage END AS dosage FROM g);;SELECT vid FROM t GROUP BY vid HAVING count(DISTINCT dosage) <= 1")
def monomorphic_variants(spark, sf):
    vid = F.col("vid")
    return filters.monomorphic(fx.genotypes(spark, sf).withColumn("dosage", F.when(vid % 8 == 0, 1).when(vid % 8 != 1, F.col("dosage"))))


@query("SELECT 'COMPLEMENT' AS set_name, vid FROM v WHERE chr NOT IN (2, 3)")
def set_complement(spark, sf):
    v = fx.variants(spark, sf)
    return joins.set_complement(v, v.where("chr in (2, 3)").select(F.col("chr").cast("string").alias("set_name"), "vid"))


@query("SELECT vid, CAST(max(CASE WHEN vid % 2 = 0 THEN 1 ELSE 0 END) AS INTEGER) AS even, CAST(max(CASE WHEN chr = 1 THEN 1 ELSE 0 END) AS INTEGER) AS one FROM v WHERE vid % 2 = 0 OR chr = 1 GROUP BY vid")
def set_table(spark, sf):
    v = fx.variants(spark, sf)
    sets = v.where("vid % 2 = 0").select(F.lit("even").alias("set_name"), "vid").unionByName(v.where("chr = 1").select(F.lit("one").alias("set_name"), "vid"))
    return joins.set_table(sets, ["even", "one"])


@query("SELECT DISTINCT grp, chr, start, stop, name FROM ranges WHERE name IN (SELECT name FROM ranges WHERE start < 5000)")
def gene_subset(spark, sf):
    r = fx.ranges(spark, sf)
    return filters.gene_subset(r, r.where("start < 5000").select("name")).select("grp", "chr", "start", "stop", "name").distinct()


@query("SELECT a.vid, avg(b.weight) AS smooth FROM (SELECT vid, chr, bp, weight FROM wt JOIN v USING (vid)) a JOIN (SELECT chr, bp, weight FROM wt JOIN v USING (vid)) b ON a.chr = b.chr AND abs(a.bp - b.bp) <= 3000 GROUP BY a.vid", "smooth")
def smoothed(spark, sf):
    x = fx.weights(spark, sf).join(fx.variants(spark, sf), "vid")
    return segments.smooth(x, "weight", 3000).select("vid", "smooth")


@query("h AS (SELECT id, r, 1 / exp(power(r / 2.0, 2)) AS w FROM (SELECT sample_id AS id, row_number() OVER (PARTITION BY sample_id ORDER BY value DESC, attr_id) AS r FROM num) WHERE r <= 5);;SELECT id, CAST(r AS INTEGER) AS rank, w / sum(w) OVER (PARTITION BY id) AS weight FROM h", "weight")
def neighbour_weights(spark, sf):
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("sample_id").orderBy(F.desc("value"), "attr_id"))
    near = fx.numerics(spark, sf).select(F.col("sample_id").alias("id"), rank.alias("rank")).where("rank <= 5")
    return ranking.neighbour_weights(near, 2.0)


# Segments and pairs


_SS = "ss AS (SELECT seg_id, sample_id % 100 AS sample_id, chr, bp1 % 64000 AS bp1, bp1 % 64000 + greatest(bp2 - bp1, 0) % 3000 AS bp2 FROM seg)"


def _short(spark, sf) -> DataFrame:
    start = F.col("bp1") % 64000
    return fx.segments(spark, sf).select("seg_id", (F.col("sample_id") % 100).alias("sample_id"), "chr", start.alias("bp1"), (start + F.greatest(F.col("bp2") - F.col("bp1"), F.lit(0)) % 3000).alias("bp2"))


@query(f"{_SS}, ov AS (SELECT DISTINCT v.vid, sample_id, aff FROM v JOIN ss ON v.chr = ss.chr AND v.bp BETWEEN bp1 AND bp2 JOIN s USING (sample_id));;SELECT v.vid, count(*) FILTER (WHERE aff) AS aff, count(*) FILTER (WHERE NOT aff) AS unaff FROM v LEFT JOIN ov USING (vid) GROUP BY v.vid")
def segment_coverage(spark, sf):
    return segments.coverage(_short(spark, sf), fx.variants(spark, sf), fx.samples(spark, sf))


@query(f"{_SS}, o AS (SELECT sample_id, count(*) AS n, sum((bp2 - bp1) / 1000.0::DOUBLE) AS kb FROM ss GROUP BY sample_id);;SELECT aff, count(*) AS people, CAST(coalesce(sum(n), 0) AS BIGINT) AS segments, coalesce(sum(n), 0) / count(*)::DOUBLE AS rate, count(n) / count(*)::DOUBLE AS share, coalesce(sum(kb), 0) AS kb, coalesce(sum(kb), 0) / nullif(sum(n), 0) AS kb_each FROM s LEFT JOIN o USING (sample_id) GROUP BY aff", "rate share kb kb_each")
def segment_burden(spark, sf):
    return segments.burden(_short(spark, sf), fx.samples(spark, sf))


@query(f"{_SS}, r2 AS (SELECT * FROM ranges);;SELECT seg_id, count(*) AS genes FROM ss JOIN r2 ON ss.chr = r2.chr AND r2.start BETWEEN bp1 AND bp2 GROUP BY seg_id")
def genes_hit(spark, sf):
    return segments.genes_hit(_short(spark, sf), fx.ranges(spark, sf))


_RP = "rp AS (SELECT a.sample_id AS i, b.sample_id AS j, (a.sample_id * 7 + b.sample_id * 11) % 100 / 100.0::DOUBLE AS pi_hat FROM s a JOIN s b ON a.cluster = b.cluster AND a.sample_id < b.sample_id AND b.sample_id - a.sample_id < 50)"


def _related(spark, sf) -> DataFrame:
    """Pairs of a class whose ids are near, with a relatedness by arithmetic."""
    s = fx.samples(spark, sf).select("sample_id", "cluster")
    x = s.select(F.col("sample_id").alias("i"), "cluster").join(s.select(F.col("sample_id").alias("j"), "cluster"), "cluster").where("i < j and j - i < 50")
    return x.select("i", "j", ((F.col("i") * 7 + F.col("j") * 11) % 100 / 100.0).alias("pi_hat"))


@query(f"{_RP};;SELECT * FROM rp WHERE pi_hat >= 0.125 AND pi_hat <= 0.605", "pi_hat")
def relatedness_bounds(spark, sf):
    return pairs.within_bounds(_related(spark, sf), "pi_hat", 0.125, 0.605)


@query(f"{_RP};;SELECT * FROM rp WHERE (i % 3 = 0 AND j % 4 = 1) OR (j % 3 = 0 AND i % 4 = 1)", "pi_hat")
def pairs_between_lists(spark, sf):
    s = fx.samples(spark, sf)
    return pairs.between_lists(_related(spark, sf), s.where("sample_id % 3 = 0"), s.where("sample_id % 4 = 1"))


@query(f"{_RP};;SELECT i % 10 AS grp, CAST(sum(CASE WHEN i < j THEN 1 ELSE 0 END) AS BIGINT) AS n, max(pi_hat) AS most FROM rp WHERE pi_hat >= 0.5 GROUP BY 1", "most")
def relatedness_by_group(spark, sf):
    x = pairs.within_bounds(_related(spark, sf), "pi_hat", 0.5)
    return x.groupBy((F.col("i") % 10).alias("grp")).agg(F.count("*").alias("n"), F.max("pi_hat").alias("most"))


_VP = "vp AS (SELECT a.vid AS v1, b.vid AS v2, (a.vid * 3 + b.vid) % 17 / 4.0::DOUBLE AS z FROM v a JOIN v b ON a.vid < b.vid)"


def _variant_table(spark, sf) -> DataFrame:
    v = fx.variants(spark, sf).select("vid")
    return v.select(F.col("vid").alias("v1")).join(v.select(F.col("vid").alias("v2")), F.col("v1") < F.col("v2")).select("v1", "v2", ((F.col("v1") * 3 + F.col("v2")) % 17 / 4.0).alias("z"))


@query(f"{_VP};;SELECT vp.* FROM vp JOIN v a ON a.vid = v1 JOIN v b ON b.vid = v2 WHERE a.chr <> b.chr OR b.bp - a.bp >= 6000", "z")
def pairs_beyond_gap(spark, sf):
    return pairs.far_apart(_variant_table(spark, sf), fx.variants(spark, sf), 6000)


@query(f"{_VP};;SELECT * FROM vp WHERE (v1 % 5 = 0 AND v2 % 7 = 0) OR (v2 % 5 = 0 AND v1 % 7 = 0)", "z")
def set_by_set_pairs(spark, sf):
    v = fx.variants(spark, sf)
    return pairs.across_sets(_variant_table(spark, sf), v.where("vid % 5 = 0"), v.where("vid % 7 = 0"))


@query(f"{_VP};;SELECT * FROM vp WHERE v1 % 5 = 0 OR v2 % 5 = 0", "z")
def set_by_all_pairs(spark, sf):
    return pairs.across_sets(_variant_table(spark, sf), fx.variants(spark, sf).where("vid % 5 = 0"))


@query(f"{_PEO};;WITH RECURSIVE up AS (SELECT fid, iid, pat AS ancestor FROM pe WHERE pat <> '0' UNION SELECT fid, iid, mat FROM pe WHERE mat <> '0') SELECT fid, iid, ancestor, 1 AS meioses FROM up")
def ancestors(spark, sf):
    return family.ancestors(_people(spark, sf))


@query("al AS (SELECT 'a' || sample_id AS alias, 's' || (sample_id - sample_id % 2) AS id FROM s UNION ALL SELECT 'a' || sample_id, 's' || (sample_id + 1) FROM s WHERE sample_id % 10 = 0);;SELECT alias, string_agg(DISTINCT id, ',' ORDER BY id) AS ids FROM al GROUP BY alias HAVING count(DISTINCT id) > 1")
def conflicting_ids(spark, sf):
    i = F.col("sample_id")
    name = lambda c, x: F.concat(F.lit(c), x.cast("string"))
    s = fx.samples(spark, sf)
    aliases = s.select(name("a", i).alias("alias"), name("s", i - i % 2).alias("id")).unionByName(s.where(i % 10 == 0).select(name("a", i).alias("alias"), name("s", i + 1).alias("id")))
    return relatives.conflicting_ids(aliases).withColumn("ids", F.concat_ws(",", "ids"))


@query("a AS (SELECT 's' || (sample_id - sample_id % 2) AS id, sample_id AS x FROM s WHERE sample_id % 3 = 0), b AS (SELECT 's' || sample_id AS id, cluster AS y FROM s WHERE sample_id % 4 <> 1);;SELECT id, x, y, x IS NOT NULL AS in_a, y IS NOT NULL AS in_b FROM a FULL JOIN b USING (id)")
def matched_ids(spark, sf):
    i = F.col("sample_id")
    name = lambda c, x: F.concat(F.lit(c), x.cast("string"))
    s = fx.samples(spark, sf)
    aliases = s.select(name("a", i).alias("alias"), name("s", i - i % 2).alias("id"))
    a, b = s.where(i % 3 == 0).select(name("a", i).alias("id"), i.alias("x")), s.where(i % 4 != 1).select(name("s", i).alias("id"), F.col("cluster").alias("y"))
    return relatives.match_ids(a, b, ["id"], aliases)


@query("po AS (SELECT sample_id AS pair, attr_id AS idx, value FROM num), r AS (SELECT pair, idx, idx - row_number() OVER (PARTITION BY pair ORDER BY idx) AS k FROM po WHERE value >= 0.05);;SELECT pair, min(idx) AS start, max(idx) AS stop, count(*) AS n FROM r GROUP BY pair, k HAVING count(*) >= 2")
def ibd_runs(spark, sf):
    p = fx.numerics(spark, sf).select(F.col("sample_id").alias("pair"), F.col("attr_id").alias("idx"), F.col("value").alias("post"))
    return segments.ibd_segments(p, 0.05)
