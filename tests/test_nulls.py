"""Operators on nulls, empty tables, ties, repeated rows and further columns."""

import pytest

from intronaut.functions import stats
from intronaut.operators import annotate, counts, differential, genes, outlier, phenotype, plotdata, plots

CELLS = "clu long, chrom string, strand string, a long, b long, sample string, n long, tot long, gene string, coord string"
EXONS = "chr string, start_pos long, end_pos long, strand string, gene_name string, clu string"
KNOWN = "chr string, a long, b long, gene string, gene_id string, strand string, transcript string, intron_number long, biotype string"


@pytest.fixture(scope="module")
def cells(spark):
    rows = [(1, "chr1", "+", a, b, f"S{i}", n, 30, "x", "y") for i in range(4) for (a, b), n in (((100, 200), 10), ((100, 300), 20))]
    rows += [(2, "chr1", "+", 500, 600, "S0", None, None, "x", "y"), (2, "chr1", "+", 500, 700, "S0", 0, 0, "x", "y"), (None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, CELLS)


def test_usage_and_phenotypes(cells):
    psi = {(r.clu, r.b, r["sample"]): r.psi for r in counts.psi(cells).collect()}
    assert psi[1, 200, "S0"] == 10 / 30 and psi[2, 600, "S0"] is None and psi[2, 700, "S0"] is None
    ratios = phenotype.ratios(cells.where("clu is not null"))
    assert {r.ratio for r in ratios.where("clu = 2").collect()} == {None}
    # no spread: all samples alike
    assert phenotype.imputed(ratios).count() == 0
    for table in (ratios, ratios.limit(0)):
        assert phenotype.scaled(phenotype.imputed(table)).count() == 0 and phenotype.normalised(phenotype.scaled(phenotype.imputed(table))).count() == 0
    assert counts.usage_stats(cells.limit(0)).count() == 0


def test_p_values(spark):
    rows = [("g", 0.02, 1), ("g", 0.02, 2), ("g", None, 3), ("h", None, 4), (None, 0.5, 5)]
    table = spark.createDataFrame(rows, "by string, p double, _id int")
    got = {r._id: r.q for r in stats.adjusted_fdr(table, "p", "q").collect()}
    assert got == {1: 0.03, 2: 0.03, 3: None, 4: None, 5: 0.5}
    assert {r.by: r.m for r in stats.bonferroni_min(table, "p", "m", "by").collect()} == {"g": 0.04, "h": None, None: 0.5}
    assert stats.adjusted_fdr(table.limit(0), "p", "q").count() == 0
    assert plotdata.qq_points(table, "p", "by").count() == 3


def test_tests_of_nothing(spark, cells):
    groups = spark.createDataFrame([("S0", "A"), ("S1", "A"), ("S2", "B"), (None, "B")], "sample string, grp string")
    status = {r.clu: r.status for r in differential.testability(cells, groups).collect()}
    assert status[2] == differential.NO_COVERAGE and differential.testability(cells.limit(0), groups).count() == 0
    two = spark.createDataFrame([("S0", "A"), ("S1", "A"), ("S2", "B"), ("S3", "B")], "sample string, grp string")
    assert differential.differential_usage(cells.where("clu is not null").limit(0), two).count() == 0
    assert outlier.outliers(cells.limit(0)).count() == 0 and outlier.cluster_outliers(outlier.outliers(cells.limit(0))).count() == 0


def test_annotation(spark, cells):
    introns = cells.select("clu", "chrom", "strand", "a", "b", "n", "gene").distinct()
    known = spark.createDataFrame([("chr1", 100, 200, "G", "G", "+", "T", 1, "x"), ("chr1", 100, 200, "G", "G", "+", "T", 1, "x"), (None, None, None, None, None, None, None, None, None)], KNOWN)
    for table in (known, known.limit(0)):
        matched = annotate.match_annotation(introns.drop("gene"), table)
        assert matched.count() == introns.count()
        judged = annotate.constitutive(matched).join(annotate.cluster_gene(matched), "clu").withColumn("verdict", annotate.verdict())
        assert {r.verdict for r in judged.where("clu = 2").collect()} == {"unknown_strand"}
    assert annotate.cassette(introns.selectExpr("clu", "a", "b", "cast(null as double) deltapsi", "cast(null as string) verdict")).where("classification <> '.'").count() == 0
    exons = spark.createDataFrame([("chr1", 200, 250, "+", "G", "c"), ("chr1", 200, 250, "+", "G", "c"), ("chr1", None, 100, "+", "H", "c"), (None, 1, 2, None, None, "c")], EXONS)
    found = genes.clusters_to_genes(introns.select("clu", "chrom", "a", "b"), exons.drop("clu").withColumnRenamed("strand", "exon_strand")).collect()
    assert [(r.clu, r.genes) for r in found] == [(1, "G,H")]
    assert genes.clusters_to_genes(introns.select("clu", "chrom", "a", "b"), exons.limit(0).drop("clu").withColumnRenamed("strand", "exon_strand")).count() == 0
    assert genes.intron_gene(introns.drop("gene"), exons).where("gene = '?'").count() == introns.count() - 2


def test_plots_of_nothing(spark, cells):
    table = counts.psi(cells).select("clu", "a", "b", "sample", "n", "psi")
    groups = spark.createDataFrame([("S0", "A")], "sample string, grp string")
    near = spark.createDataFrame([(1, 100, 200, "+", "G")], "clu long, start_pos long, end_pos long, strand string, gene_name string")
    for t in (table.where("clu is not null"), table.limit(0)):
        for found in (*plots.differential_plot(t, groups, 3).values(), *plots.cluster_plot(t, groups, near).values()):
            found.collect()
    assert plots.cluster_plot(table, groups, near.limit(0))["arrows"].count() == 0
