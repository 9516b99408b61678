import gzip

import pytest

from intronaut.plans import pipelines
from intronaut.sources import readers, writers


def write(path, *lines):
    path.write_text("".join(x + "\n" for x in lines))
    return str(path)


def test_bed12(spark, tmp_path):
    p = write(tmp_path / "one.junc", "chr1\t100\t400\t.\t7\t+\t100\t400\t0\t2\t10,20\t0,280", "chr1 1 2 3", "chrUn 100 400 . 7 + 100 400 0 2 10,20 0,280", "chr1 100 400 . 7 + 100 400 0 3 10,20,5 0,280,290")
    assert [tuple(r) for r in readers.read_bed12(spark, p).collect()] == [("chr1", "+", "one", 110, 381, 7)]
    assert readers.read_bed12(spark, p, check_chromosomes=False).count() == 2


def test_six_columns_and_gzip(spark, tmp_path):
    with gzip.open(tmp_path / "two.junc.gz", "wt") as f:
        f.write("chr1\t110\t380\t.\t7\t+\n")
    path = str(tmp_path / "two.junc.gz")
    assert tuple(readers.read_junctions(spark, path).first()) == ("chr1", "NA", "two", 110, 381, 7)
    assert readers.read_junctions(spark, path, use_strand=True).first().strand == "+"
    assert readers.read_manifest(spark, write(tmp_path / "list", path, "")) == [path]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.read_junctions(spark, str(tmp_path / "missing")).count()


def test_clusters_round_trip(spark, tmp_path):
    rows = [(1, "chr1", "+", 100, 200, 5), (1, "chr1", "+", 100, 300, 6), (2, "chr2", "-", 5, 9, 7), (2, "chr2", "-", 5, 8, 7)]
    clusters = spark.createDataFrame(rows, "clu long, chrom string, strand string, a long, b long, n long")
    writers.write_refined(clusters, str(tmp_path / "refined"))
    assert sorted(tuple(r) for r in readers.read_clusters(spark, str(tmp_path / "refined")).collect()) == sorted(rows)


def test_matrix_and_groups(spark, tmp_path):
    p = write(tmp_path / "m", "# note", "chrom S0 S1", "chr1:10:20:clu_1 3/5 0/5", "chr1:10:30:clu_1 2/5")
    got = {(r.a, r.b, r["sample"]): (r.n, r.tot) for r in readers.read_counts(spark, p).collect()}
    assert got == {(10, 20, "S0"): (3, 5), (10, 20, "S1"): (0, 5), (10, 30, "S0"): (2, 5), (10, 30, "S1"): (None, None)}
    other = write(tmp_path / "m2", "S1 S2 S0", "chr1:10:20:clu_2 1/2 3/4 5/6")
    both = readers.read_counts(spark, [p, other]).where("clu = 'clu_2'").collect()
    assert {r["sample"]: (r.n, r.tot) for r in both} == {"S1": (1, 2), "S2": (3, 4), "S0": (5, 6)}
    g = readers.read_groups(spark, write(tmp_path / "g", "S0 A 1.5", "S1 B 2"))
    assert [tuple(r) for r in g.collect()] == [("S0", "A", "1.5"), ("S1", "B", "2")]


def test_count_files(spark, tmp_path):
    rows = [(1, "chr1", "+", 100, 200, s, n, 10) for s, n in (("S0", 4), ("S1", 6))]
    table = spark.createDataFrame(rows, "clu long, chrom string, strand string, a long, b long, sample string, n long, tot long")
    writers.write_counts(table, ["S0", "S1"], str(tmp_path / "c"))
    assert {r["sample"]: (r.n, r.tot) for r in readers.read_counts(spark, str(tmp_path / "c")).collect()} == {"S0": (4, 10), "S1": (6, 10)}


def test_dotted_sample_names(spark, tmp_path):
    names = ["RNA.NA06986_CEU.chr1.bam", "RNA.NA06994_CEU.chr1.bam"]
    rows = [(1, "chr1", "+", 100, b, s, 4 + i + b % 3, 20) for b in (200, 300, 400) for i, s in enumerate(names)]
    table = spark.createDataFrame(rows, "clu long, chrom string, strand string, a long, b long, sample string, n long, tot long")
    writers.write_counts(table, names, str(tmp_path / "c"))
    assert {(r.b, r["sample"]): r.n for r in readers.read_counts(spark, str(tmp_path / "c")).collect()} == {(r[4], r[5]): r[6] for r in rows}
    out = pipelines.phenotype_tables(table, names, pcs=5)
    assert out["pcs"].count() == 4
    writers.write_phenotypes(out["phen"], "value", names, str(tmp_path / "p"))
    assert spark.read.csv(str(tmp_path / "p"), sep="\t", header=True).columns == ["#Chr", "start", "end", "ID", *names, "chrom"]


def test_sample_files_are_in_the_order_of_text(spark, tmp_path):
    rows = [(1, "chr1", "+", a, a + 50, "S0", a, 500) for a in (90, 100, 1000)]
    writers.write_sample_files(spark.createDataFrame(rows, "clu long, chrom string, strand string, a long, b long, sample string, n long, tot long"), str(tmp_path / "s"))
    (path,) = [r.value for r in spark.read.text(str(tmp_path / "s" / "list")).collect()]
    assert [r.value for r in spark.read.text(path).collect()] == ["chrom S0", "chr1:100:150:clu_1_+ 100/500", "chr1:1000:1050:clu_1_+ 1000/500", "chr1:90:140:clu_1_+ 90/500"]


def test_samples_by_folder(spark, tmp_path):
    for name in ("file=S.1.junc", "T.junc"):
        (tmp_path / name).mkdir()
        write(tmp_path / name / "part-0", "chr1\t110\t380\t.\t7\t+")
    assert {r["sample"] for r in readers.read_junctions(spark, [str(tmp_path / "file=S.1.junc"), str(tmp_path / "T.junc")]).collect()} == {"S.1", "T"}


def test_mates_are_split(spark):
    from intronaut.sources import alignments

    reads = spark.createDataFrame([("a", 1 + 64), ("b", 1 + 128)], "qname string, flag int")
    first, second = alignments.split_mates(reads)
    assert [r.qname for r in first.collect()] == ["a"] and [r.qname for r in second.collect()] == ["b"]
    with pytest.raises(Exception, match="single"):
        alignments.split_mates(spark.createDataFrame([("a", 0)], "qname string, flag int"))[0].collect()


def test_scratch_tables_can_be_dropped(spark, tmp_path):
    from pathlib import Path

    from intronaut import scratch

    with scratch.temporary_tables(spark):
        kept = scratch.materialize(spark.range(3), "some")
        (folder,) = {str(Path(f.removeprefix("file://")).parent) for f in kept.inputFiles()}
        assert Path(folder).exists() and spark.sparkContext.applicationId in folder
    assert not Path(folder).exists()


def test_alignments_to_junctions(spark):
    lines = [("r1\t0\tchr1\t101\t60\t10M100N20M\t*\t0\t0\tA\tI",), ("r2\t0\tchr1\t101\t60\t10M100N20M\t*\t0\t0\tA\tI",), ("r3\t4\tchr1\t101\t60\t10M100N20M\t*\t0\t0\tA\tI",)]
    got = pipelines.alignments_to_junctions(spark.createDataFrame(lines, "value string")).collect()
    assert [tuple(r) for r in got] == [("chr1", 110, 210, "+", 2)]


def test_workflow_from_junctions_to_annotated_results(spark):
    import numpy as np

    rng, rows = np.random.default_rng(1), []
    for s in range(8):
        share = [0.6, 0.2, 0.2] if s < 4 else [0.1, 0.45, 0.45]
        for (a, b), n in zip([(100, 400), (100, 200), (300, 400)], rng.multinomial(200, share), strict=True):
            rows.append(("chr1", "+", f"S{s}", a, b, int(n)))
    j = spark.createDataFrame(rows, "chrom string, strand string, sample string, a long, b long, n long")
    clusters, table = pipelines.junctions_to_counts(j)
    groups = spark.createDataFrame([(f"S{i}", "A" if i < 4 else "B") for i in range(8)], "sample string, grp string")
    exons = spark.createDataFrame([("chr1", 50, 100, "+", "G"), ("chr1", 200, 300, "+", "G"), ("chr1", 400, 500, "+", "G")], "chr string, start_pos long, end_pos long, strand string, gene_name string")
    tested, effects = pipelines.differential_splicing(table, groups, exons, min_samples_per_group=3)
    r = tested.first()
    assert r.status == "Success" and r.p_adjust < 0.01 and r.genes == "G"
    known = spark.createDataFrame([("chr1", a, b, "G", "G", "+", t, 1, "x") for a, b, t in [(100, 400, "T1"), (100, 200, "T2"), (300, 400, "T2")]], "chr string, a long, b long, gene string, gene_id string, strand string, transcript string, intron_number long, biotype string")
    out = pipelines.annotated_results(effects, tested, clusters, known)
    c = out["clusters"].first()
    assert (c.gene, c.annotation, c.classification, c.N) == ("G", "annotated", "cassette exon - increased - annotated", 3)
    cells, per_cluster = pipelines.outlier_splicing(table)
    assert cells.count() == 24 and per_cluster.count() == 8
    tables = pipelines.phenotype_tables(table, [f"S{i}" for i in range(8)], pcs=2)
    assert {k: v.count() for k, v in tables.items()} == {"phen": 24, "qqnorm": 24, "ave": 3, "pcs": 16}
