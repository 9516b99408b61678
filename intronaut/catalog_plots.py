"""Queries over plot tables, result tables, models and checks that need inputs of their own."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intronaut.catalog import Query, _clusters, _counts, _known, _pvalues, _rounded, _some_clusters
from intronaut.catalog_files import _ratio_table, _tested
from intronaut.functions import special, stats, text
from intronaut.operators import annotate, clustering, counts, differential, genes, outlier, phenotype, plotdata, plots
from intronaut.plans import pipelines
from intronaut.sources import derived, writers

_QUERIES: dict[str, Query] = {}


def _query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


@_query
def differential_plot_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arcs of the introns of every cluster and group."""
    found = plots.differential_plot(_counts(spark, sf_dir), derived.groups(spark, sf_dir))["edges"]
    return _rounded(found, 6, "x0", "x1", "height", "mean_n").select("clu", "a", "b", "grp", "i", "x0", "x1", "height", "mean_n")


@_query
def differential_plot_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of their curves, five each."""
    found = plots.differential_plot(_counts(spark, sf_dir), derived.groups(spark, sf_dir), points=5)["curves"]
    return found.select("clu", "a", "b", "grp", "t", *((F.round(c, 6) + 0.0).alias(c) for c in ("x", "y", "weight")))


def _cluster_plot(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    near = plotdata.exons_near(derived.exons(spark, sf_dir), _clusters(spark, sf_dir).drop("strand"))
    return plots.cluster_plot(counts.psi(_counts(spark, sf_dir)), derived.groups(spark, sf_dir), near)


@_query
def cluster_plot_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arcs of each cluster with the mean share in each group."""
    return _rounded(_cluster_plot(spark, sf_dir)["edges"], 9, "height", "mean_psi").select("clu", "a", "b", "grp", "i", "height", "mean_psi")


@_query
def cluster_plot_exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawn exons: on the axis, of a least length, each place once."""
    return _rounded(_cluster_plot(spark, sf_dir)["exons"], 6, "x", "xend")


@_query
def cluster_plot_arrows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrows along the strand of the gene with most exons, in wide gaps."""
    return _rounded(_cluster_plot(spark, sf_dir)["arrows"], 6, "x", "xend")


def _gene_plot(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    clusters, exons = _clusters(spark, sf_dir), derived.exons(spark, sf_dir)
    inside = plotdata.introns_in_genes(clusters.select("chrom", "a", "b").distinct(), exons)
    introns = clusters.join(inside, ["chrom", "a", "b"]).select("gene_name", "clu", F.concat(F.lit("clu_"), F.col("clu").cast("string"), F.lit("_"), "strand").alias("name"), "a", "b", "n")
    return plots.gene_plot(introns, exons, _tested(spark, sf_dir)[0].where("clu % 3 > 0"), limit=0.1)


@_query
def gene_plot_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arcs of a gene's introns, significant or not."""
    return _rounded(_gene_plot(spark, sf_dir)["edges"], 6, "x0", "height").select("gene_name", "clu", "a", "b", "i", "x0", "height", "significant", "fdr")


@_query
def gene_plot_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exons beside the axis, on scales of their own."""
    return _rounded(_gene_plot(spark, sf_dir)["outer"], 6, "x", "xend")


@_query
def gene_plot_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of clusters, above and below in turn."""
    return _rounded(_gene_plot(spark, sf_dir)["labels"], 6, "start", "end", "middle", "label_y")


@_query
def exon_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps between the exons of a gene that are wide enough for an arrow."""
    exons = derived.exons(spark, sf_dir)
    totals = exons.groupBy("gene_name").agg((F.max("end_pos") - F.min("start_pos")).alias("total"))
    return plots.wide_gaps(exons.select("gene_name", F.col("start_pos").alias("low"), F.col("end_pos").alias("high")), totals, "gene_name", share=0.1)


@_query
def qq_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed and expected p-values per supplier."""
    found = plotdata.qq_points(_pvalues(spark, sf_dir), "p", "l_suppkey")
    return found.select("l_suppkey", *((F.round(c, 9) + 0.0).alias(c) for c in ("observed", "expected")))


@_query
def qq_points_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed and expected p-values of all suppliers together."""
    found = plotdata.qq_points(_pvalues(spark, sf_dir), "p")
    return found.select(*((F.round(c, 9) + 0.0).alias(c) for c in ("observed", "expected")))


@_query
def outlier_few_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fits stopped after five steps: which clusters have come to an end, and how far the others are."""
    found = outlier.share_parameters(outlier.cluster_counts(_some_clusters(spark, sf_dir)), rounds=5)
    return _rounded(found, 4, "loglik").select("clu", "loglik", "status")


@_query
def gene_exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exons of a gene once, without long ones."""
    exons = derived.exons(spark, sf_dir).withColumn("end_pos", F.col("end_pos") + F.pmod(F.col("start_pos") / 100, F.lit(7)).cast("long") * 150)
    return plotdata.gene_exons(exons.union(exons))


@_query
def group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of each group."""
    return differential.group_sizes(derived.groups(spark, sf_dir))


@_query
def cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Introns of each cluster."""
    return differential.cluster_sizes(_clusters(spark, sf_dir))


@_query
def status_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters by the reason not to test them."""
    found = differential.testability(_counts(spark, sf_dir), derived.groups(spark, sf_dir), max_size=4, min_samples_per_intron=7, min_coverage=40)
    return differential.status_summary(found)


@_query
def constitutive_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a cluster's transcripts that have both sites of an intron."""
    found = annotate.constitutive(annotate.match_annotation(_clusters(spark, sf_dir), _known(spark, sf_dir)))
    return _rounded(found, 9, "constitutive").select("clu", "chrom", "a", "b", "constitutive")


@_query
def first_exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first exon of each gene."""
    exons = derived.exons(spark, sf_dir)
    return annotate.first_match(exons.select("gene_name").distinct(), exons.select("gene_name", "chr", "start_pos"), "gene_name", "start_pos")


@_query
def outlier_testable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters that the outlier analysis takes."""
    return outlier.testable(_some_clusters(spark, sf_dir), max_size=6, min_coverage=50).select("clu").distinct()


def _tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    clusters = outlier.cluster_counts(_some_clusters(spark, sf_dir))
    sums = "transform(sequence(0, k - 1), j -> aggregate(rows, 0D, (s, r) -> s + get(r.y, j)))"
    return outlier.outlier_cells(clusters, clusters.selectExpr("clu", f"{sums} as sums").selectExpr("clu", "transform(sums, c -> 20 * c / aggregate(sums, 0D, (s, d) -> s + d)) as alpha"))


@_query
def outlier_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-values and effects at parameters of 20 times the mean shares."""
    found = _tails(spark, sf_dir)
    return _rounded(_rounded(found, 6, "p"), 9, "effect").select("clu", "a", "b", "sample", "p", "effect")


@_query
def outlier_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-values of clusters and samples from those of their introns."""
    return _rounded(outlier.cluster_outliers(_tails(spark, sf_dir)), 5, "p")


@_query
def design_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model matrix of the samples: group, standardised number, one column for the second batch."""
    return _rounded(differential.design(derived.groups(spark, sf_dir)), 9, "age")


@_query
def dm_loglik(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dirichlet-multinomial log likelihood of each cluster at equal shares and concentration 12."""
    return _rounded(differential.loglik_at(_some_clusters(spark, sf_dir), 12.0), 5, "loglik")


@_query
def bb_loglik(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beta-binomial log likelihood of each intron's counts out of its cluster's at share 0.4 and concentration 7."""
    gain = lambda n, a: f"{special.lgamma(f'({a} + {n})')} - {math.lgamma(a)!r}D"
    value = f"sum({gain('n', 7 * 0.4)} + {gain('(tot - n)', 7 * 0.6)} - ({gain('tot', 7.0)}))"
    return _rounded(_some_clusters(spark, sf_dir).groupBy("clu", "a", "b").agg(F.expr(value).alias("loglik")), 5, "loglik")


def _two_categories(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    found = _some_clusters(spark, sf_dir)
    first = found.groupBy("clu").agg(F.min("a").alias("first"))
    two = found.join(first, "clu").select("clu", F.when(F.col("a") == F.col("first"), 1).otherwise(2).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), "sample", "n", "tot").groupBy("clu", "a", "b", "sample").agg(F.sum("n").alias("n"), F.first("tot").alias("tot"))
    fits = differential.differential_usage(two, derived.groups(spark, sf_dir).select("sample", "grp"), max_size=2, min_samples_per_group=3, multi=False, **options)
    return fits.where("introns is not null")


@_query
def bb_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beta-binomial tests of the first intron of every testable cluster against its others: one concentration, two categories."""
    return _rounded(_two_categories(spark, sf_dir).select("clu", "status", "df", "loglr", "p", F.get("introns", F.lit(0))["deltapsi"].alias("deltapsi")), 3, "loglr", "p", "deltapsi")


@_query
def bb_robust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same tests where a sample may be an outlier with flat shares."""
    return _rounded(_two_categories(spark, sf_dir, robust=True).select("clu", "status", "df", "loglr", "p"), 3, "loglr", "p")


@_query
def ds_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every fitted cluster must satisfy: degrees of freedom, the p-value of its statistic, shares that sum to one, effects to zero."""
    groups = derived.groups(spark, sf_dir).select("sample", "grp")
    found = differential.differential_usage(_some_clusters(spark, sf_dir), groups, min_samples_per_group=3).where("status = 'Success'")
    total = lambda c: F.aggregate("introns", F.lit(0.0), lambda s, x: s + x[c])
    found = found.withColumn("statistic", 2 * F.greatest(F.col("loglr"), F.lit(0.0)))
    p = stats.chi_square_p("statistic", "df")
    sums = (F.abs(total("baseline") - 1) < 1e-9) & (F.abs(total("perturbed") - 1) < 1e-9) & (F.abs(total("logef")) < 1e-6) & (F.abs(total("deltapsi")) < 1e-9)
    return found.select("clu", "df", F.size("introns").cast("long").alias("introns"), (F.abs(F.col("p") - p) < 1e-9).alias("p_fits"), sums.alias("sums"), (F.col("loglr") > -1e-3).alias("better"))


@_query
def ds_single_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tests with one concentration for all introns: status and degrees of freedom."""
    groups = derived.groups(spark, sf_dir).select("sample", "grp")
    found = differential.differential_usage(_some_clusters(spark, sf_dir), groups, min_samples_per_group=3, multi=False)
    return found.where("status = 'Success'").select("clu", "df")


@_query
def chi_square_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survival at every quantity, at twice the line number degrees of freedom and at one less."""
    rows = derived.table(spark, sf_dir, "lineitem").selectExpr("l_quantity as x", "explode(array(2 * l_linenumber, 2 * l_linenumber - 1)) as df").distinct()
    return rows.select("x", "df", F.round(stats.chi_square_p("x", "df"), 9).alias("p"))


@_query
def pca_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of the samples' scores summed over the components, which must be those of scaled usage."""
    scores = plotdata.pca_samples(counts.psi(_counts(spark, sf_dir)), derived.SAMPLES)[0]
    other = scores.select(F.col("sample").alias("other"), "pc", F.col("score").alias("y"))
    return scores.join(other, "pc").groupBy("sample", "other").agg((F.round(F.sum(F.col("score") * F.col("y")), 4) + 0.0).alias("g"))


@_query
def pca_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores with the samples' groups: squares summed by group."""
    scores = plotdata.pca_samples(counts.psi(_counts(spark, sf_dir)), derived.SAMPLES)[0]
    return plotdata.scores_with_meta(scores, derived.groups(spark, sf_dir)).groupBy("grp").agg(F.round(F.sum(F.col("score") * F.col("score")), 4).alias("g"))


@_query
def phen_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covariance of the samples put together again from components and their variances."""
    found = phenotype.components(_ratio_table(spark, sf_dir), "value", derived.SAMPLES, 8)
    other = found.select(F.col("sample").alias("other"), "pc", F.col("loading").alias("y"))
    return found.join(other, "pc").groupBy("sample", "other").agg((F.round(F.sum(F.col("variance") * F.col("loading") * F.col("y")), 8) + 0.0).alias("covariance"))


def _results(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    tested, effects = _tested(spark, sf_dir)
    return pipelines.annotated_results(effects, tested, _clusters(spark, sf_dir), _known(spark, sf_dir), limit=0.1)


@_query
def significant_introns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Introns of significant clusters with gene, verdict and effect."""
    return _results(spark, sf_dir)["introns"].drop("constitutive")


@_query
def significant_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Significant clusters with gene, annotation and size."""
    return _results(spark, sf_dir)["clusters"].select("clu", "coord", "gene", "annotation", "N", "FDR")


@_query
def annotation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Significant clusters by annotation."""
    return _results(spark, sf_dir)["cluster_summary"]


@_query
def intron_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Introns of a cluster labelled by falling size of effect."""
    return plotdata.letters(_tested(spark, sf_dir)[1]).select("clu", "a", "b", "label")


@_query
def browser_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of clusters to a genome browser, by the build in an annotation's name."""
    span = _clusters(spark, sf_dir).groupBy("clu").agg(F.first("chrom").alias("chrom"), F.min("a").alias("first"), F.max("b").alias("last"))
    db = plotdata.annotation_db(F.concat(F.lit("/data/annotation_"), F.element_at(F.array(F.lit("hg38"), F.lit("mm10"), F.lit("dm6")), (F.col("clu") % 3 + 1).cast("int")), F.lit("_all")))
    return span.select("clu", plotdata.browser_url(F.col("chrom"), F.col("first"), F.col("last"), db).alias("url"))


@_query
def intron_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of intron ids, chromosomes with their prefix."""
    ids = _clusters(spark, sf_dir).select(F.concat_ws(":", F.substring("chrom", 4, 9), F.col("a").cast("string"), F.col("b").cast("string"), F.concat(F.lit("clu_"), F.col("clu").cast("string"))).alias("id"))
    parts = ids.select(genes.intron_meta("id").alias("m")).select("m.*")
    return parts.withColumn("chr", genes.with_chr("chr", parts.first().chr))


@_query
def usage_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logistic, softmax and simplex scales over the lines of an order."""
    rows = derived.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_tax") * 10).alias("x"))
    out = rows.withColumn("logistic", stats.logistic(F.col("x") - 0.4)).withColumn("softmax", stats.softmax_over(F.col("x"), "l_orderkey"))
    return _rounded(out.withColumn("real", stats.beta_real(F.col("softmax"), F.lit(5.0), "l_orderkey")), 9, "logistic", "softmax", "real").select("l_orderkey", "l_linenumber", "logistic", "softmax", (F.col("real") + 0.0).alias("real"))


@_query
def text_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts and numbers as they are shown."""
    rows = derived.table(spark, sf_dir, "supplier").withColumn("broken", text.with_break(F.col("s_name")))
    rank = F.round(stats.significant_digits(F.col("s_acctbal"), 2), 4)
    return rows.select("s_suppkey", text.one_line(F.col("broken")).alias("line"), text.tagged(F.col("s_name"), "i").alias("tagged"), text.untagged(text.tagged(F.col("s_name"), "b")).alias("plain"), rank.alias("two_digits"), writers.shown(F.when(F.col("s_suppkey") % 3 > 0, F.col("s_suppkey") / 8), 3).alias("shown"))


@_query
def constitutive_scattered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Introns without alternative among junctions far apart."""
    return clustering.constitutive_introns(derived.scattered(spark, sf_dir))


@_query
def library_qc_flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Library checks where three samples lack a chromosome."""
    return counts.library_qc(derived.junctions(spark, sf_dir).withColumn("chrom", F.expr("if(sample in ('S1', 'S4', 'S6') and chrom = 'chr3', 'chr2', chrom)")))


@_query
def common_chroms_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chromosomes that all samples have where one sample lacks two."""
    return counts.common_chroms(derived.junctions(spark, sf_dir).withColumn("chrom", F.expr("if(sample = 'S2' and chrom in ('chr1', 'chr4'), 'chr2', chrom)")))


@_query
def gene_span_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plot widths of genes of all lengths."""
    exons = derived.exons(spark, sf_dir)
    return plotdata.gene_span(exons.withColumn("end_pos", F.col("end_pos") + (F.col("start_pos") - 1) % 1_000 * 1_500 + F.col("start_pos")))


@_query
def cassette_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of clusters of three introns out of the lines of orders: shapes, signs and verdicts in turn."""
    return annotate.cassette(derived.cassettes(spark, sf_dir))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)
