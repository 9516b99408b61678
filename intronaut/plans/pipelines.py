"""The six workflows, each from its inputs to its result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intronaut.functions.stats import adjusted_fdr
from intronaut.operators import annotate, clustering, counts, differential, genes, outlier, phenotype
from intronaut.scratch import materialize
from intronaut.sources import alignments


def alignments_to_junctions(sam: DataFrame, use_rna_strand: bool = False, unique: bool = False) -> DataFrame:
    """SAM lines -> (chrom, start, end, strand, n) of well spliced reads."""
    rows = alignments.select_reads(alignments.tags(alignments.parse_sam(sam)), unique)
    kept = alignments.cigar_blocks(alignments.spliced(rows)).where("not problem")
    if use_rna_strand:
        kept = kept.withColumn("read_strand", F.col("rna_strand"))
    return alignments.count_junctions(alignments.block_junctions(kept))


def junctions_to_counts(junctions: DataFrame, max_length: int = 100_000, min_cluster_reads: int = 30, min_ratio: float = 0.001, min_reads: int | None = None, clusters: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(clusters, counts per intron and sample); given clusters are used as they are."""
    found = clusters if clusters is not None else clustering.cluster_introns(junctions, max_length, min_cluster_reads, min_ratio, min_reads)
    return found, counts.perind_counts(found, junctions)


def differential_splicing(table: DataFrame, groups: DataFrame, exons: DataFrame | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """(clusters with adjusted p-values and genes, effect sizes of introns)."""
    results = differential.differential_usage(table, groups, **options)
    tested = differential.cluster_table(results)
    if exons is not None:
        introns = table.select("clu", "chrom", "a", "b").distinct()
        tested = tested.join(genes.clusters_to_genes(introns, exons.withColumnRenamed("strand", "exon_strand")), "clu", "left")
    return tested, differential.effect_sizes(results)


def outlier_splicing(table: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """(cells with p-value and effect, p-values of clusters and samples)."""
    cells = materialize(outlier.outliers(table, **options), "outlier_cells")
    return cells, outlier.cluster_outliers(cells)


def phenotype_tables(table: DataFrame, samples: list[str], pcs: int = 50, blacklist: tuple[str, ...] = phenotype.BLACKLIST) -> dict[str, DataFrame]:
    """``phen``, ``qqnorm``, ``ave`` and ``pcs``."""
    phen = phenotype.imputed(phenotype.ratios(table, blacklist))
    normal = phenotype.normalised(phenotype.scaled(phen))
    return {"phen": phen, "qqnorm": normal, "ave": phenotype.summary(phen), "pcs": phenotype.components(normal, "q", samples, pcs)}


def annotated_results(effects: DataFrame, tested: DataFrame, introns: DataFrame, known: DataFrame, limit: float = 0.05) -> dict[str, DataFrame]:
    """Tables of clusters and introns significant at ``limit``, with genes, verdicts, classes and summaries."""
    significant = tested.where(F.col("p_adjust") <= limit).select("clu", "df", F.col("p_adjust").alias("FDR"))
    chosen = effects.join(significant, "clu").join(introns.select("clu", "chrom", "strand", "a", "b"), ["clu", "a", "b"])
    matched = annotate.match_annotation(chosen, known)
    judged = annotate.constitutive(matched).join(annotate.cluster_gene(matched), "clu").withColumn("verdict", annotate.verdict())
    clusters = annotate.cluster_summary(judged).join(annotate.cassette(judged), "clu").join(significant, "clu").withColumn("N", F.col("df") + 1)
    strong = clusters.where(F.col("FDR") < limit).orderBy("FDR", "clu")
    shown = judged.select("clu", "chrom", "a", "b", "gene", "verdict", F.round("deltapsi", 3).alias("deltapsi"), "constitutive")
    return {"clusters": strong, "introns": shown, "intron_summary": annotate.intron_summary(judged), "cluster_summary": clusters.groupBy("annotation").agg(F.count("*").alias("n"))}


def adjusted(tested: DataFrame) -> DataFrame:
    """Adjust p-values of a table read back from a file."""
    return adjusted_fdr(tested, "p", "p_adjust")
