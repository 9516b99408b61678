"""Registry of the splicing queries: each runs an operator over inputs derived from the star-schema tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intronaut import catalog_sql
from intronaut.functions import stats
from intronaut.operators import annotate, clustering, counts, differential, genes, outlier, phenotype, plotdata
from intronaut.scratch import materialize
from intronaut.sources import alignments, derived

Query = Callable[[SparkSession, str], DataFrame]
CELL = ("clu", *clustering.KEY)
_QUERIES: dict[str, Query] = {}


def _query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters with the smaller minimum per intron, which all scales satisfy."""
    return clustering.cluster_introns(derived.junctions(spark, sf_dir), min_reads=5)


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # added up by sample and intron once: clusters and counts need no more than these sums
    added = materialize(counts.sample_counts(derived.junctions(spark, sf_dir)), "sample_counts")
    return counts.perind_counts(clustering.cluster_introns(added, min_reads=5), added)


def _pvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.when(F.col("l_orderkey") % 9 == 0, None).otherwise(F.least(F.lit(1.0), F.round((F.col("l_discount") + F.col("l_tax") + 0.001) / 0.2, 6)))
    return derived.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", p.alias("p"))


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    exons = derived.exons(spark, sf_dir).selectExpr("chr", "start_pos", "end_pos", "strand", "gene_name as gene", "gene_name as gene_id", "concat('T', gene_name) as transcript", "'protein_coding' as biotype")
    return genes.transcript_introns(exons)


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    matched = annotate.match_annotation(_clusters(spark, sf_dir), _known(spark, sf_dir))
    return matched.join(annotate.cluster_gene(matched), "clu").withColumn("verdict", annotate.verdict())


def _sam(spark: SparkSession, sf_dir: str, pos: str, cigar: str) -> DataFrame:
    """SAM lines out of line items."""
    rows = derived.table(spark, sf_dir, "lineitem").selectExpr("*", "cast(l_quantity as int) as q", "cast(60 + l_linenumber * 10 as int) as gap")
    line = f"concat_ws('\t', concat(l_orderkey, ':', l_linenumber), if(l_linestatus = 'O', '0', '16'), concat('chr', 1 + l_suppkey % 5), {pos}, q, {cigar}, '*', '0', '0', 'A', 'I', 'NM:i:1')"
    return alignments.tags(alignments.parse_sam(rows.selectExpr(f"{line} as value")))


BLOCK_CIGAR = "case l_linenumber % 4 when 1 then concat('5S10M2I8M', gap, 'N', q + 5, 'M') when 2 then concat('10M3D8M', gap, 'N', q + 5, 'M') when 3 then concat('10M', gap, 'N', q + 5, 'M') else concat('10M', gap, 'N', q + 5, 'M3S') end"


def _line_keys(df: DataFrame) -> DataFrame:
    return df.withColumn("l_orderkey", F.split_part("qname", F.lit(":"), F.lit(1)).cast("long")).withColumn("l_linenumber", F.split_part("qname", F.lit(":"), F.lit(2)).cast("int"))


@_query
def pool_introns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads per intron over all samples."""
    return clustering.pool_introns(derived.junctions(spark, sf_dir))


@_query
def overlap_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Islands of overlapping introns."""
    return clustering.overlap_islands(pool_introns(spark, sf_dir))


@_query
def linked_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Introns of islands that share a splice site."""
    return clustering.linked_components(clustering.large_islands(overlap_islands(spark, sf_dir)))


@_query
def refined_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters after refinement, numbered."""
    return _clusters(spark, sf_dir)


@_query
def constitutive_introns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Introns alone in their island."""
    return clustering.constitutive_introns(derived.junctions(spark, sf_dir))


@_query
def perind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and cluster totals of every intron and sample."""
    return _counts(spark, sf_dir)


@_query
def perind_numers_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, a column per sample."""
    return counts.wide(_counts(spark, sf_dir), derived.SAMPLES, "numers")


@_query
def perind_ratios_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``n/tot`` cells, a column per sample."""
    return counts.wide(_counts(spark, sf_dir), derived.SAMPLES, "ratios")


@_query
def library_qc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and chromosomes of each sample."""
    return counts.library_qc(derived.junctions(spark, sf_dir))


@_query
def common_chroms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chromosomes that all samples have."""
    return counts.common_chroms(derived.junctions(spark, sf_dir))


@_query
def intron_usage_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, median, least and largest usage of each intron."""
    return _rounded(counts.usage_stats(_counts(spark, sf_dir)), 9, "mean_usage", "median_usage", "min_usage", "max_usage")


@_query
def usage_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each intron in its cluster, null without reads."""
    return _rounded(counts.psi(_counts(spark, sf_dir)), 9, "psi").select(*CELL, "sample", "psi")


@_query
def phen_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothed ratios, null without reads."""
    return _rounded(phenotype.ratios(_counts(spark, sf_dir)), 9, "ratio")


def _imputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phenotype.imputed(phenotype.ratios(_counts(spark, sf_dir)))


@_query
def phen_imputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratios of introns with few missing ones and enough spread, filled with the mean."""
    return _rounded(_imputed(spark, sf_dir), 9, "value").drop("ratio")


@_query
def phen_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those ratios as z-scores of their introns."""
    return phenotype.scaled(_imputed(spark, sf_dir)).select(*CELL, "sample", (F.round("z", 6) + 0.0).alias("z"))  # no negative zero


@_query
def phen_qqnorm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of the z-scores per sample as normal quantiles."""
    return phenotype.normalised(phenotype.scaled(_imputed(spark, sf_dir))).select(*CELL, "sample", (F.round("q", 6) + 0.0).alias("q"))


@_query
def phen_ave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least, largest and mean ratio of each intron."""
    return _rounded(phenotype.summary(_imputed(spark, sf_dir)), 9, "min_ratio", "max_ratio", "mean_ratio")


@_query
def exons_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exons derived from parts and suppliers."""
    return derived.exons(spark, sf_dir)


@_query
def transcript_introns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps between the exons of a transcript, numbered along its strand."""
    return _known(spark, sf_dir)


@_query
def splice_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both ends of annotated introns."""
    known = _known(spark, sf_dir)
    five, three = (genes.splice_sites(known, side).select(F.lit(side).alias("side"), "*") for side in ("five", "three"))
    return five.union(three)


@_query
def clusters_to_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genes whose exons meet a cluster's introns."""
    return genes.clusters_to_genes(_clusters(spark, sf_dir), derived.exons(spark, sf_dir).withColumnRenamed("strand", "exon_strand"))


@_query
def intron_gene_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gene of each intron by its sites."""
    return genes.intron_gene(_clusters(spark, sf_dir), derived.exons(spark, sf_dir))


@_query
def bh_fdr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benjamini-Hochberg over all p-values of lineitem."""
    return _rounded(stats.adjusted_fdr(_pvalues(spark, sf_dir), "p", "q"), 9, "p", "q").drop("l_suppkey")


@_query
def bonferroni_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smallest p-value of each supplier times their number."""
    return _rounded(stats.bonferroni_min(_pvalues(spark, sf_dir), "p", "p_min", "l_suppkey"), 9, "p_min")


@_query
def fisher_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fisher's combination of all p-values of each supplier."""
    return _rounded(stats.fisher_combined(_pvalues(spark, sf_dir), "p", "p_fisher", "l_suppkey"), 6, "p_fisher").where("p_fisher is not null")


@_query
def outlier_cluster_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-value of the smallest of each supplier's p-values."""
    known = _pvalues(spark, sf_dir).where("p is not null")
    least = known.groupBy("l_suppkey").agg(F.min("p").alias("m"), F.count("*").alias("n"))
    return least.select("l_suppkey", F.round(F.when(F.col("m") < 1, stats.cluster_p(F.col("m"), F.col("n"))).otherwise(1.0), 6).alias("p_cluster"))


@_query
def ds_testability_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a cluster isn't tested."""
    return differential.testability(_counts(spark, sf_dir), derived.groups(spark, sf_dir), max_size=10)


@_query
def junction_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of each intron against the annotation."""
    return _judged(spark, sf_dir).select("clu", "chrom", "a", "b", "n", "gene", "verdict")


@_query
def cassette_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of each cluster as a cassette exon."""
    return annotate.cassette(_judged(spark, sf_dir).withColumn("deltapsi", F.round((F.col("n") % 7 - 3) / 10.0, 1)))


@_query
def cluster_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extent, gene and annotation of each cluster."""
    return annotate.cluster_summary(_judged(spark, sf_dir))


@_query
def intron_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Introns by verdict."""
    return annotate.intron_summary(_judged(spark, sf_dir))


@_query
def plot_coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Axis of each cluster's plot."""
    return _rounded(plotdata.plot_coords(_clusters(spark, sf_dir), "clu"), 6, "coord")


@_query
def gene_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extent and plot width of each gene."""
    return plotdata.gene_span(derived.exons(spark, sf_dir))


@_query
def introns_in_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clustered introns inside genes."""
    return plotdata.introns_in_genes(_clusters(spark, sf_dir).select("chrom", "a", "b").distinct(), derived.exons(spark, sf_dir))


@_query
def exons_near_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exons that touch a cluster."""
    return plotdata.exons_near(derived.exons(spark, sf_dir), _clusters(spark, sf_dir).drop("strand"))


@_query
def group_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean share and reads of each intron and group."""
    return _rounded(plotdata.group_usage(counts.psi(_counts(spark, sf_dir)), derived.groups(spark, sf_dir)), 9, "mean_psi")


@_query
def top_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 30 clusters with the smallest values below a limit, a report."""
    scored = _clusters(spark, sf_dir).groupBy("clu").agg((1.0 / F.sum("n")).alias("fdr"))
    return _rounded(annotate.top_clusters(scored, "fdr", 0.01, 30), 9, "fdr")


@_query
def sam_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of alignments by CIGAR."""
    blocks = alignments.cigar_blocks(_sam(spark, sf_dir, "l_partkey * 10 + 1", BLOCK_CIGAR))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return _line_keys(blocks).select("l_orderkey", "l_linenumber", "chrom_start", text("block_sizes"), text("block_starts"))


@_query
def bed_junctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Junctions between blocks, counted."""
    return alignments.count_junctions(alignments.block_junctions(alignments.cigar_blocks(_sam(spark, sf_dir, "(l_partkey % 50) * 10 + 1", BLOCK_CIGAR))))


@_query
def spliced_read_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Well spliced alignments."""
    return _line_keys(alignments.spliced(_sam(spark, sf_dir, "l_partkey", "concat(q % 12, 'M', 40 + l_linenumber * 5, 'N20M')"))).select("l_orderkey", "l_linenumber")


def _some_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts as the fits take them, written once since they are looked at several times."""
    return materialize(_counts(spark, sf_dir).select("clu", "a", "b", "sample", "n", "tot"), "counts")


@_query
def ds_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dirichlet-multinomial tests of every testable cluster, adjusted."""
    results = differential.differential_usage(_some_clusters(spark, sf_dir), derived.groups(spark, sf_dir), min_samples_per_group=3)
    return differential.cluster_table(results)


@_query
def ds_effect_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effect sizes of the introns of tested clusters."""
    results = differential.differential_usage(_some_clusters(spark, sf_dir), derived.groups(spark, sf_dir).select("sample", "grp"), min_samples_per_group=3)
    return differential.effect_sizes(results)


@_query
def outlier_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-sided p-values and effects of every intron and sample under the fitted shares of its cluster."""
    return _rounded(_rounded(outlier.outliers(_some_clusters(spark, sf_dir)), 4, "p", "effect", "mean_share"), 9, "share")


@_query
def outlier_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log likelihood at the fitted parameters of each cluster, and whether the fit converged."""
    found = outlier.share_parameters(outlier.cluster_counts(_some_clusters(spark, sf_dir)))
    return _rounded(found, 4, "loglik").select("clu", "loglik", "status")


@_query
def pca_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the samples on the components of scaled usage."""
    return plotdata.pca_samples(counts.psi(_counts(spark, sf_dir)), derived.SAMPLES)[0]


@_query
def phen_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First three components of the normalised phenotypes."""
    return phenotype.components(phenotype.normalised(phenotype.scaled(_imputed(spark, sf_dir))), "q", derived.SAMPLES, 3)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(catalog_sql.SQL)
