"""Queries over the text formats: tables are written as files of a format below the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from intronaut.catalog import Query, _clusters, _counts, _known, _rounded, _sam
from intronaut.operators import clustering, counts, genes, phenotype
from intronaut.scratch import scratch_path
from intronaut.sources import alignments, derived, readers, writers

_QUERIES: dict[str, Query] = {}
#: Sample names as in real data, with dots.
DOTTED = {s: f"RNA.{s}_CEU.chr1.bam" for s in derived.SAMPLES}


def _query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def _dotted(table: DataFrame) -> DataFrame:
    return table.withColumn("sample", F.concat(F.lit("RNA."), "sample", F.lit("_CEU.chr1.bam")))


def _text(df: DataFrame, name: str, *partition_by: str) -> str:
    path = scratch_path(df.sparkSession, name)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.text(path)
    return path


def _bed12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BED12 lines of junctions in folders by sample: some on unknown chromosomes, of unknown strand, with three blocks or cut short."""
    rows = derived.junctions(spark, sf_dir).withColumns({"chrom": F.when(F.col("a") % 17 == 0, F.concat(F.lit("Un_"), "chrom")).otherwise(F.col("chrom")), "strand": F.when(F.col("b") % 7 == 0, "?").otherwise(F.col("strand"))})
    blocks = F.when(F.col("a") % 13 == 0, 3).otherwise(2)
    start, end, text = F.col("a") - 10, F.col("b") + 19, lambda c: c.cast("string")
    fields = ["chrom", text(start), text(end), F.lit("."), text(F.col("n")), "strand", text(start), text(end), F.lit("0"), text(blocks), F.lit("10,20"), F.concat(F.lit("0,"), text(F.col("b") - 1 - start))]
    value = F.when(F.col("a") % 19 == 0, F.concat_ws("\t", *fields[:5])).otherwise(F.concat_ws("\t", *fields))
    path = _text(rows.select(F.concat("sample", F.lit(".junc")).alias("file"), value.alias("value")), "bed12", "file")
    return readers.read_bed12(spark, path)


@_query
def bed12_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BED12 junctions read back: two-block rows on known chromosomes."""
    return _bed12(spark, sf_dir)


@_query
def bed12_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Introns pooled from BED12 rows without those of unknown strand and longer than 3000 bases."""
    return clustering.pool_introns(_bed12(spark, sf_dir), max_length=3000)


@_query
def junction_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six-column junctions as they are written, read back with their strand."""
    rows = derived.junctions(spark, sf_dir).select("chrom", F.col("a").alias("start"), (F.col("b") - 1).alias("end"), "n", "strand")
    path = scratch_path(spark, "junctions")
    writers.write_junctions(rows, path)
    return readers.read_junctions(spark, path, use_strand=True).drop("sample")


@_query
def manifest_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads per sample of the six-column files that a manifest lists."""
    rows = derived.junctions(spark, sf_dir)
    value = F.concat_ws("\t", "chrom", F.col("a").cast("string"), (F.col("b") - 1).cast("string"), F.lit("."), F.col("n").cast("string"), "strand")
    path = _text(rows.select(F.concat("sample", F.lit(".junc")).alias("file"), value.alias("value")), "listed", "file")
    listed = spark.createDataFrame([(f"{path}/file={s}.junc",) for s in derived.SAMPLES[:5]], "value string")
    found = readers.read_junctions(spark, readers.read_manifest(spark, _text(listed, "manifest")))
    return found.groupBy("sample", "strand").agg(F.count("*").alias("n_rows"), F.sum("n").alias("n"))


@_query
def cluster_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refined clusters written and read back, numbered in the order of the file."""
    path = scratch_path(spark, "refined")
    writers.write_refined(_clusters(spark, sf_dir), path)
    return readers.read_clusters(spark, path)


@_query
def quantified_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per sample of clusters that come from a file: reads of each cluster and sample."""
    found = counts.perind_counts(cluster_file(spark, sf_dir), derived.junctions(spark, sf_dir))
    return found.groupBy("clu", "sample").agg(F.count("*").alias("introns"), F.sum("n").alias("n"), F.max("tot").alias("tot"))


@_query
def pooled_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of islands of two introns or more."""
    path = scratch_path(spark, "pooled")
    writers.write_pooled(clustering.overlap_islands(clustering.pool_introns(derived.junctions(spark, sf_dir))), path)
    return spark.read.text(path)


@_query
def count_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix of ``n/tot`` with dotted sample names, read back."""
    path = scratch_path(spark, "counts")
    writers.write_counts(_dotted(_counts(spark, sf_dir)), list(DOTTED.values()), path)
    return readers.read_counts(spark, path)


@_query
def numers_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix of ``n`` with dotted sample names, read back as a map per row."""
    path = scratch_path(spark, "numers")
    writers.write_counts(_dotted(_counts(spark, sf_dir)), list(DOTTED.values()), path, "numers")
    cell = lambda s: F.col("cells")[DOTTED[s]].cast("long").alias(s)
    return readers.read_rows(spark, path).select("id", *map(cell, derived.SAMPLES))


@_query
def matrices_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matrices whose headers differ, read as one: even clusters with all samples backwards, odd ones with every other sample."""
    found, path = _counts(spark, sf_dir), scratch_path(spark, "matrices")
    writers.write_counts(found.where("clu % 2 = 0"), derived.SAMPLES[::-1], f"{path}/even", "numers")
    writers.write_counts(found.where("clu % 2 = 1 and sample in ('S0', 'S2', 'S4', 'S6')"), derived.SAMPLES[::2], f"{path}/odd")
    return readers.read_matrix(spark, [f"{path}/even", f"{path}/odd"])


@_query
def sample_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the count files of each sample that the list of files names."""
    path = scratch_path(spark, "samples")
    writers.write_sample_files(_counts(spark, sf_dir), path)
    paths = [r.value for r in spark.read.text(f"{path}/list").collect()]
    return spark.read.text(paths).select(F.regexp_extract("_metadata.file_path", "sample=([^/]+)", 1).alias("sample"), "value")


@_query
def sample_files_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each line in the count file of its sample; lines of one place on both strands share the first of theirs."""
    path = scratch_path(spark, "samples")
    writers.write_sample_files(_counts(spark, sf_dir), path)
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    lines = spark.read.text(f"{path}/files").select("sample", "value", place.alias("place"))
    lines = lines.withColumn("place", F.row_number().over(Window.partitionBy("sample").orderBy("place")).cast("long"))
    return lines.select("sample", "value", F.min("place").over(Window.partitionBy("sample", F.substring_index("value", ":", 3))).alias("place"))


@_query
def groups_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples, groups and covariates from a file without header."""
    value = F.concat_ws(" ", "sample", "grp", F.col("age").cast("string"), "batch")
    return readers.read_groups(spark, _text(derived.groups(spark, sf_dir).select(value.alias("value")), "groups"))


@_query
def exons_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exons from a file with a header."""
    path = scratch_path(spark, "exons")
    derived.exons(spark, sf_dir).select("chr", F.col("start_pos").alias("start"), F.col("end_pos").alias("end"), "strand", "gene_name").write.csv(path, sep="\t", header=True)
    return readers.read_exons(spark, path)


def _gtf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GTF rows read back from a file: names, biotypes and transcripts are missing here and there, comments and other features are between."""
    line = """concat_ws('\t', chr, 'made', if(end_pos % 11 = 0, 'CDS', 'exon'), start_pos, end_pos, '.', strand, '.',
      concat_ws(' ', concat('gene_id "', gene_name, '";'), case when start_pos div 100 % 5 = 0 then null when start_pos div 100 % 5 = 1 then 'transcript_id "TX";' else concat('transcript_id "T', gene_name, '";') end, if(start_pos % 7 = 0, 'gene_name "";', concat('gene_name "N', gene_name, '";')),
        if(end_pos % 3 = 0, 'transcript_type "lnc";', null), if(end_pos div 100 % 4 = 0, 'gene_biotype "coding";', null), concat('exon_number "', start_pos * 10 + substr(chr, 4), '";'), 'tag "x"; tag "y";'))"""
    rows = derived.exons(spark, sf_dir).selectExpr(f"{line} as value")
    comments = spark.range(3).selectExpr("if(id = 0, '', concat('#!comment ', id)) as value")
    return readers.read_gtf(spark, _text(rows.union(comments), "gtf"))


@_query
def gtf_exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exons of a GTF file, with the gene's id where it has no name."""
    return genes.gtf_exons(_gtf(spark, sf_dir))


@_query
def gtf_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exons of another feature than exon."""
    return genes.gtf_exons(_gtf(spark, sf_dir), "CDS")


@_query
def gtf_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exon rows of transcripts with their fallbacks: gene, biotype; those that contradict the first one by exon number are left out."""
    return genes.gtf_transcripts(_gtf(spark, sf_dir).withColumn("line", genes.attribute("exon_number").cast("long"))).drop("line")


@_query
def gtf_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes as a multimap: its keys, and the values of the repeated one."""
    found = _gtf(spark, sf_dir).withColumn("m", genes.attribute_map())
    return found.select("chr", "start", "end", F.array_join(F.array_sort(F.map_keys("m")), ",").alias("keys"), F.array_join(F.col("m")["tag"], ",").alias("tags"), F.get(F.col("m")["gene_id"], 0).alias("gene_id"))


@_query
def gtf_site_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gene of each splice site; the last row wins, in the order of their exon numbers."""
    rows = _gtf(spark, sf_dir).where("feature = 'exon'").select("chr", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), genes.attribute("gene_id").alias("gene_name"), genes.attribute("exon_number").cast("long").alias("line"))
    return genes.site_genes(rows)


def _annotation(spark: SparkSession, sf_dir: str) -> str:
    """Annotation files whose chromosomes lack their prefix."""
    path, known = scratch_path(spark, "annotation"), _known(spark, sf_dir).withColumn("chr", F.substring("chr", 4, 9))
    writers.write_annotation(derived.exons(spark, sf_dir), known, genes.splice_sites(known, "five"), genes.splice_sites(known, "three"), path)
    return path


@_query
def annotation_introns_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotated introns read back; chromosomes get their prefix."""
    return readers.read_splice_sites(spark, f"{_annotation(spark, sf_dir)}_all_introns")


@_query
def annotation_sites_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splice sites of both kinds read back."""
    path = _annotation(spark, sf_dir)
    five, three = (readers.read_splice_sites(spark, f"{path}_{n}").select(F.lit(n).alias("side"), "chr", "a", "b", "gene", "transcript", "intron_number") for n in ("fiveprime", "threeprime"))
    return five.union(three)


@_query
def result_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of a saved bundle: introns and exons per chromosome."""
    path = scratch_path(spark, "bundle")
    writers.write_bundle({"introns": _clusters(spark, sf_dir), "exons": derived.exons(spark, sf_dir)}, path)
    tables = readers.read_bundle(spark, path, ["introns", "exons"])
    introns = tables["introns"].groupBy("chrom").agg(F.count("*").alias("introns"), F.sum("n").alias("n"))
    return introns.join(tables["exons"].groupBy(F.col("chr").alias("chrom")).agg(F.count("*").alias("exons")), "chrom")


@_query
def bed_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BED12 lines of spliced alignments."""
    from intronaut.catalog import BLOCK_CIGAR

    path = scratch_path(spark, "bed")
    writers.write_bed(alignments.bed_lines(alignments.cigar_blocks(_sam(spark, sf_dir, "l_partkey * 10 + 1", BLOCK_CIGAR))), path)
    return spark.read.text(path)


def _tested(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A stand-in for fitted results: clusters with p-values and introns with effects, by formula."""
    introns = _clusters(spark, sf_dir)
    tested = introns.groupBy("clu").agg((F.count("*") - 1).alias("df"), F.sum("n").alias("t")).select("clu", F.lit("Success").alias("status"), (F.col("t") / 100).alias("loglr"), "df", F.round(F.lit(1.0) / F.col("t"), 6).alias("p"), F.round(0.001 + F.least(F.lit(0.9), F.lit(9.0) / F.col("t")), 3).alias("p_adjust"))
    psi = F.col("n") / F.sum("n").over(phenotype.Window.partitionBy("clu"))
    effects = introns.withColumn("psi", psi).select("clu", "a", "b", F.round(F.col("psi") - 0.5, 6).alias("logef"), F.round("psi", 6).alias("baseline"), F.round(1 - F.col("psi"), 6).alias("perturbed"), F.round(1 - 2 * F.col("psi"), 6).alias("deltapsi"))
    return tested, effects


@_query
def significance_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster p-values and effect sizes as files whose usage columns carry the groups' names: smallest and largest effect of a cluster."""
    path = scratch_path(spark, "ds")
    writers.write_differential(*_tested(spark, sf_dir), ("brain.A", "heart.B"), path)
    read = lambda n: spark.read.csv(f"{path}_{n}", sep="\t", header=True, inferSchema=True)
    usage = read("effect_sizes").groupBy("clu").agg(F.min("`brain.A`").alias("least"), F.max("`heart.B`").alias("most"))
    return read("cluster_significance").join(usage, "clu").select(F.col("clu").cast("long").alias("clu"), "status", F.col("df").cast("long").alias("df"), "p_adjust", "least", "most")


@_query
def outlier_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five outlier tables, read back as long rows; values by formula."""
    path, table = scratch_path(spark, "outliers"), _dotted(_counts(spark, sf_dir))
    share = F.round(F.col("n") / (F.col("tot") + 1), 6)
    cells = table.select(F.concat_ws(":", "chrom", "a", "b", "clu").alias("id"), "clu", "sample", F.round((F.col("n") + 1) / (F.col("tot") + 2), 6).alias("p"), F.round(share - 0.25, 6).alias("effect"), share.alias("share"), F.lit(0.25).alias("mean_share"))
    per = cells.groupBy("clu", "sample").agg(F.min("p").alias("p"))
    writers.write_outliers(cells, per, list(DOTTED.values()), path, verbose=True)
    out = None
    for name in ("pVals", "effSize", "clusterPvals", "test"):
        found = readers.read_matrix(spark, f"{path}_{name}").groupBy("sample").agg(F.count("*").alias("k"), F.round(F.sum(F.col("value").cast("double")), 4).alias("total")).select(F.lit(name).alias("file"), "sample", "k", "total")
        out = found if out is None else out.union(found)
    mean = spark.read.csv(f"{path}_controlMean", sep="\t").select(F.lit("controlMean").alias("file"), F.lit("all").alias("sample"), F.count("*").over(phenotype.Window.partitionBy()).alias("k"), F.round(F.sum(F.col("_c1").cast("double")).over(phenotype.Window.partitionBy()), 4).alias("total")).limit(1)
    return out.union(mean)


def _scaled(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Rounded like the SQL's doubles: times a power of ten, to the next whole number, and back. Spark's ``round`` goes by the text of the double, which at some ties is the other side."""
    return df.withColumns({c: F.round(F.col(c) * 10.0**digits) / 10.0**digits for c in columns})


def _ratio_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(phenotype.imputed(phenotype.ratios(_counts(spark, sf_dir))), 9, "value", "ratio")


@_query
def phenotype_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matrices per chromosome with dotted sample names, read back as long rows."""
    path = scratch_path(spark, "phen")
    writers.write_phenotypes(_dotted(_ratio_table(spark, sf_dir)), "value", list(DOTTED.values()), path)
    rows = spark.read.csv(path, sep="\t", header=True)
    cells = F.explode(F.array(*[F.struct(F.lit(s).alias("sample"), F.col(f"`{d}`").cast("double").alias("value")) for s, d in DOTTED.items()]))
    return rows.select(F.col("`#Chr`").alias("chr"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("ID").alias("id"), cells.alias("c")).select("chr", "start", "end", "id", "c.sample", "c.value")


@_query
def phenotype_summary_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of ``.ave`` and of the indexing script, and the number of cells of ``.PCs``."""
    path, table = scratch_path(spark, "ratios"), _dotted(_ratio_table(spark, sf_dir))
    chroms = sorted(r.chrom for r in table.select("chrom").distinct().collect())
    components = phenotype.components(table, "value", list(DOTTED.values()), 2)
    writers.write_phenotype_summary(_scaled(phenotype.summary(table), 6, "min_ratio", "max_ratio", "mean_ratio"), components, chroms, list(DOTTED.values()), path)
    pcs = readers.read_matrix(spark, f"{path}.PCs").agg(F.count("value").cast("string").alias("value"))
    lines = [spark.read.text(f"{path}{e}").select(F.lit(n).alias("file"), F.regexp_replace("value", r"\S*/ratios-\w+", "ratios").alias("line")) for e, n in ((".ave", "ave"), ("_prepare.sh", "prepare"))]
    return lines[0].union(lines[1]).union(pcs.select(F.lit("PCs").alias("file"), "value"))


@_query
def phenotype_blacklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Introns per chromosome without those of a blacklist file."""
    names = readers.read_chromosomes(spark, _text(spark.createDataFrame([("chr2",), ("chr5",), ("",)], "value string"), "blacklist"))
    return phenotype.ratios(_counts(spark, sf_dir), tuple(names)).groupBy("chrom").agg(F.count("*").alias("cells"), F.count("ratio").alias("known"))


@_query
def cluster_genes_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage of each intron with its gene, two decimals, as in the file; of introns whose mean is not at a tie of rounding."""
    path = scratch_path(spark, "clu2gene")
    found = genes.intron_gene(_clusters(spark, sf_dir), derived.exons(spark, sf_dir)).select("clu", "chrom", "strand", "a", "b", "gene")
    writers.write_clusters_to_genes(counts.usage_stats(_counts(spark, sf_dir)).join(found, ["clu", "chrom", "strand", "a", "b"]), path)
    rows = spark.read.csv(path, sep="\t", header=True)
    return rows.select(F.col("clu").cast("long").alias("clu"), "chrom", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), "gene", F.col("min_usage").cast("double").alias("min_usage"), F.col("max_usage").cast("double").alias("max_usage"))


@_query
def sam_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits of FLAG by name."""
    rows = derived.table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "cast(l_orderkey % 128 as int) as flag")
    return rows.select("l_orderkey", "l_linenumber", *(alignments.flag(name).alias(name) for name in alignments.FLAGS))


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = """concat_ws('\t', concat(l_orderkey, ':', l_linenumber), l_orderkey % 128, 'chr1', l_partkey, 60, '10M', '*', '0', '0', 'A', 'I',
      case l_linenumber % 4 when 0 then 'XS:A:-' when 1 then 'XS:A:.' when 2 then 'XS:A:+' end, if(l_suppkey % 3 = 0, concat('NM:i:', l_suppkey), null), if(l_partkey % 2 = 0, 'XT:A:U', 'XT:A:R'))"""
    return alignments.tags(alignments.parse_sam(derived.table(spark, sf_dir, "lineitem").selectExpr(f"{line} as value")))


@_query
def sam_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strands, edit distance and uniqueness from tags."""
    return _tagged(spark, sf_dir).select("qname", "read_strand", "rna_strand", "score", "unique")


@_query
def read_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapped unique reads of pairs, first and second ones told apart."""
    chosen = alignments.select_reads(_tagged(spark, sf_dir), unique=True).where(alignments.flag("paired"))
    return alignments.mates(chosen).select("qname", "mate")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)
