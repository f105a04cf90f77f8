import numpy as np
import pytest
from pyspark.sql import functions as F

from strandflow.sources import bed, simulate, sinks, text
from strandflow.streaming import checkpoints


@pytest.fixture
def put(tmp_path):
    def f(name, body):
        (tmp_path / name).write_text(body)
        return str(tmp_path / name)

    return f


PED = "f1 a 0 0 1 2  A A  G T\n\n f1 b 0 0 2 1  A C  0 0\nf2 c a b 9 -9  C C  T T\n"
MAP = "1 rs1 0 100\nX rs2 0.5 200\n"


def test_ped_and_its_writers(spark, put, tmp_path):
    s, v, g = text.ped(spark, put("x.ped", PED), put("x.map", MAP))
    rows = {(r.iid, r.name): (r.a, r.b) for r in g.collect()}
    assert rows == {("a", "rs1"): ("A", "A"), ("a", "rs2"): ("G", "T"), ("b", "rs1"): ("A", "C"), ("b", "rs2"): (None, None), ("c", "rs1"): ("C", "C"), ("c", "rs2"): ("T", "T")}
    who = {r.iid: (r.sex, r.pheno) for r in s.collect()}
    assert who == {"a": (1, 2.0), "b": (2, 1.0), "c": (None, None)} and text.trait(s) == "disease"
    alleles, d = text.to_dosage(g)
    assert {r.name: (r.a1, r.a2) for r in alleles.collect()} == {"rs1": ("A", "C"), "rs2": ("G", "T")}
    assert {(r.iid, r.name): r.dosage for r in d.collect()} == {("a", "rs1"): 2, ("a", "rs2"): 1, ("b", "rs1"): 1, ("b", "rs2"): None, ("c", "rs1"): 0, ("c", "rs2"): 0}
    sinks.write_lines(sinks.ped_lines(g, s, v).coalesce(1), str(tmp_path / "out"))
    _, _, again = text.ped(spark, str(tmp_path / "out"), put("y.map", MAP))
    assert {(r.iid, r.name): (r.a, r.b) for r in again.collect()} == rows
    idx = spark.createDataFrame([("f1", "a", 0), ("f1", "b", 1), ("f2", "c", 2)], "fid string, iid string, idx int")
    sinks.write_lines(sinks.tped_lines(g, idx, v), str(tmp_path / "t"))
    _, tv, tg = text.tped(spark, str(tmp_path / "t"), put("x.tfam", "f1 a 0 0 1 2\nf1 b 0 0 2 1\nf2 c a b 9 -9\n"))
    assert {(r.iid, r.name): (r.a, r.b) for r in tg.collect()} == rows and tv.count() == 2
    sinks.write_lines(sinks.lgen_lines(g), str(tmp_path / "l"))
    assert {(r.iid, r.name): (r.a, r.b) for r in text.lgen(spark, str(tmp_path / "l")).collect()} == rows
    ref = alleles.select("name", F.col("a2").alias("a1"))
    sinks.write_lines(sinks.lgen_lines(g, ref), str(tmp_path / "lr"))
    filled = text.fill_reference(text.lgen(spark, str(tmp_path / "lr")), s, ref)
    assert {(r.iid, r.name): (r.a, r.b) for r in filled.collect()} == rows
    pair = {r.name: r.ibs for r in sinks.pair_list(g, ("f1", "a"), ("f1", "b")).collect()}
    assert pair == {"rs1": 1, "rs2": None}
    assert sinks.genotype_list(g).count() == 6 and sinks.rlist_lines(g, alleles).count() == 4
    va = v.select("name", "idx").join(alleles, "name")
    assert {r.value for r in sinks.structure_lines(g, va).collect()} == {"a 1 1 1 2", "b 1 2 0 0", "c 2 2 2 2"}
    assert {r.value for r in sinks.bimbam_lines(g, idx).collect()} == {"rs1,AA,AC,CC", "rs2,GT,??,TT"}
    assert {(r.id, r.first, r.second) for r in sinks.fastphase_lines(g, v).collect()} == {("# ID a", "AG", "AT"), ("# ID b", "A?", "C?"), ("# ID c", "CT", "CT")}


def test_bed_round_trip(spark, tmp_path):
    rng = np.random.default_rng(1)
    d = rng.integers(-1, 3, (5, 7))
    assert all(bed.unpack(bed.pack(r), 7).tolist() == r.tolist() for r in d)
    g = spark.createDataFrame([(i, v, int(x) if x >= 0 else None) for v, r in enumerate(d) for i, x in enumerate(r)], "sample_id int, vid int, dosage int")
    s = spark.createDataFrame([(i, "f", f"s{i}", "0", "0", 1, -9.0) for i in range(7)], "idx int, fid string, iid string, pat string, mat string, sex int, pheno double")
    v = spark.createDataFrame([(i, "1", f"v{i}", 0.0, i * 10, "A", "C") for i in range(5)], "idx int, chr string, name string, cm double, bp int, a1 string, a2 string")
    bed.write_bed(g, s, v, str(tmp_path / "x"))
    s2, v2, g2 = bed.read_bed(spark, str(tmp_path / "x"), parts=2)
    key = lambda x: sorted((r.sample_id, r.vid, r.dosage if r.dosage is not None else -1) for r in x.collect())
    assert key(g2) == key(g) and s2.count() == 7 and v2.count() == 5
    (tmp_path / "x.bed").write_bytes(b"zz\x01")
    with pytest.raises(ValueError):
        bed.read_bed(spark, str(tmp_path / "x"))


def test_side_files(spark, put):
    n = text.numeric_file(spark, put("n.txt", "FID IID g1 g2\nf a 1.5 x\nf b 2 -3\n"))
    assert {(r.iid, r.attr): r.value for r in n.collect()} == {("a", "g1"): 1.5, ("a", "g2"): None, ("b", "g1"): 2.0, ("b", "g2"): -3.0}
    p = text.phenotypes(spark, put("p.txt", "f a 1 -9\nf b 2 3.5\n"))
    assert {(r.iid, r.name): r.pheno for r in p.collect()} == {("a", "P1"): 1.0, ("a", "P2"): None, ("b", "P1"): 2.0, ("b", "P2"): 3.5}
    assert {r.iid: r.cluster for r in text.clusters(spark, put("c.txt", "f a y\nf b x\nf c y\n")).collect()} == {"a": 1, "b": 0, "c": 1}
    assert {(r.set_name, r.name) for r in text.sets(spark, put("s.txt", "G1 rs1 rs2\nEND\nG2\nrs3\nEND\n")).collect()} == {("G1", "rs1"), ("G1", "rs2"), ("G2", "rs3")}
    r = text.range_list(spark, put("r.txt", "chrX 100 200 geneA grp\n2 5 9 geneB\n"), 0.01).orderBy("chr").collect()
    assert [(x.chr, x.start, x.stop, x.name, x.grp) for x in r] == [(2, 0, 19, "geneB", None), (23, 90, 210, "geneA", "grp")]
    f = text.frequencies(spark, put("f.frq", " CHR SNP A1 A2 MAF NCHROBS\n 1 rs1 A C 0.2 10\n 1 rs2 G T NA 0\n"))
    v = spark.createDataFrame([("rs1", "C", "A"), ("rs2", "G", "T"), ("rs3", "A", "T")], "name string, a1 string, a2 string")
    assert {x.name: x.freq for x in text.read_frequencies(f, v).collect()} == {"rs1": 0.8, "rs2": 0.0, "rs3": None}
    assert {(x.file, x.name, x.p) for x in text.results(spark, [put("a.assoc", " SNP P X\n rs1 0.5 1\n rs2 NA 1\n"), put("b.assoc", "P SNP\n0.1 rs1\n")]).collect()} == {(0, "rs1", 0.5), (1, "rs1", 0.1)}
    assert text.cnv_list(spark, put("c.cnv", "FID IID CHR BP1 BP2 TYPE SCORE SITES\nf a 1 10 20 3 0.5 4\n")).count() == 1
    m = {(x.i, x.j): x.weight for x in text.matrix_file(spark, put("m.txt", "a b c\n1 2 3\n4 5\n6\n")).collect()}
    assert m == {("a", "a"): 1, ("a", "b"): 2, ("a", "c"): 3, ("b", "b"): 4, ("b", "c"): 5, ("c", "c"): 6}
    assert {(x.i, x.j) for x in text.matrix_file(spark, put("m.1D", "# a b\n1 2\n2 1\n")).collect()} == {("a", "a"), ("a", "b"), ("b", "b")}
    assert [(x.i, x.j, x.weight) for x in text.sif(spark, put("x.sif", "a\t0.5\tb\n")).collect()] == [("a", "b", 0.5)]
    x = text.instances(spark, put("i.tab", "u\tv\tclass\n1\t2\t0\n3\t4\t1\n"))
    assert sorted((r.cls, r.values) for r in x.collect()) == [(0, [1.0, 2.0]), (1, [3.0, 4.0])]
    assert {r.value for r in sinks.delimited(x).collect()} == {"1.0\t2.0\t0", "3.0\t4.0\t1"}
    e = text.matrix_file(spark, put("n2.txt", "a b\n1 2\n2 3\n"))
    assert [r.value for r in sinks.matrix_lines(e, ["a", "b"]).collect()] == ["1.0\t2.0", "2.0\t3.0"] and [r.value for r in sinks.matrix_lines(e, ["a", "b"], True).collect()] == ["1.0\t2.0", "3.0"]
    assert [r.value for r in sinks.sif_lines(e).collect()] == ["a\t2.0\tb"]


def test_dosages(spark, put):
    s = spark.createDataFrame([(0, "f", "a"), (1, "f", "b")], "idx int, fid string, iid string")
    d = text.dosages(spark, put("d.txt", "rs1 A C 1.0 0.0 0.2 0.6\n"), s)
    assert {r.iid: round(r.dose, 6) for r in d.collect()} == {"a": 2.0, "b": 1.0} and {r.iid: r.dosage for r in text.hard_calls(d).collect()} == {"a": 2, "b": 1}
    one = text.dosages(spark, put("e.txt", "rs1 A C 0.5 2.0\n"), s, numbers=1)
    assert {r.iid: r.dosage for r in text.hard_calls(one).collect()} == {"a": None, "b": 2}
    assert text.dosage_info(one).first().freq == pytest.approx(0.625)


def test_simulation_is_repeatable_and_fits(spark):
    p = spark.createDataFrame([(20, "null", 0.3, 0.5, 1.0, 1.0), (5, "dis", 0.3, 0.5, 2.0, 4.0)], "n int, label string, low double, high double, odds_het double, odds_hom double")
    s, v, g = simulate.case_control(spark, p, 300, 300)
    x = g.join(s, "sample_id").groupBy(F.substring_index("name", "_", 1).alias("l")).agg(F.avg(F.when(F.col("aff"), F.col("dosage"))).alias("a"), F.avg(F.when(~F.col("aff"), F.col("dosage"))).alias("u")).collect()
    diff = {r.l: r.a - r.u for r in x}
    assert diff["dis"] > 0.2 and abs(diff["null"]) < 0.06
    assert g.repartition(7).groupBy().agg(F.sum("dosage")).first()[0] == simulate.case_control(spark, p, 300, 300)[2].groupBy().agg(F.sum("dosage")).first()[0]
    q, _ = simulate.quantitative(spark, spark.createDataFrame([(4, "q", 0.3, 0.5, 0.1)], "n int, label string, low double, high double, variance double"), 2000)
    assert q.agg(F.var_samp("pheno")).first()[0] == pytest.approx(1, abs=0.15)
    s, g = simulate.dummy(spark, 50, 10)
    assert g.count() == 500 and 15 < s.where("aff").count() < 35


def test_resume(spark, tmp_path):
    keys, seen = spark.range(20).withColumnRenamed("id", "k"), []

    def work(part):
        seen.append(part.count())
        return part.withColumn("v", F.col("k") * 2)

    path = str(tmp_path / "r")
    work(keys.where("k < 5")).write.parquet(path)
    out = checkpoints.resume(keys, "k", path, work, batch=5)
    assert sorted((r.k, r.v) for r in out.collect()) == [(k, 2 * k) for k in range(20)] and sum(seen[1:]) == 15


def test_cells_of_compressed_files_are_never_broadcast(spark, tmp_path):
    # Lines that repeat: a file of under 10 kB for 40,000 cells.
    n = 10_000
    who = spark.range(n).select(F.col("id").cast("int").alias("idx"), F.lit("f").alias("fid"), F.concat(F.lit("i"), F.col("id").cast("string")).alias("iid"))
    doses, calls = " ".join(["0.5"] * n), " ".join(["A C"] * n)
    put = lambda name, rows: sinks.write_lines(spark.createDataFrame([(r,) for r in rows], "value string").coalesce(1), str(tmp_path / name), "gzip")
    put("dose", [f"v{k} A C {doses}" for k in range(4)])
    put("tped", [f"1 v{k} 0 {k} {calls}" for k in range(4)])
    put("tfam", [f"f i{k} 0 0 1 2" for k in range(n)])
    put("ped", [f"f i{k} 0 0 1 2 {calls}" for k in range(4)])
    put("map", [f"1 v{k} 0 {k}" for k in range(n)])
    path = lambda name: str(tmp_path / name)
    for g in (text.dosages(spark, path("dose"), who, numbers=1), text.tped(spark, path("tped"), path("tfam"))[2], text.ped(spark, path("ped"), path("map"))[2]):
        assert g.count() == 4 * n
        plan = g._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan
