"""Annotation: GTF exons, transcripts and splice sites, and genes of introns and clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GTF_COLUMNS = ("chr", "source", "feature", "start", "end", "score", "strand", "frame", "attributes")


def attribute(name: str, column: str = "attributes") -> Column:
    """First value of a GTF attribute; null if missing or empty."""
    return F.nullif(F.regexp_extract(column, rf'(?:^|;)\s*{name} "([^"]*)"', 1), F.lit(""))


def attribute_map(column: str = "attributes") -> Column:
    """All attributes as a map from key to its values in order; ``tag`` may repeat, another repeated key is an error."""
    pairs = F.filter(F.split(F.col(column), ";"), lambda x: F.trim(x) != "")
    parsed = F.transform(pairs, lambda x: F.struct(F.regexp_extract(x, r"^\s*(\S+)", 1).alias("k"), F.regexp_extract(x, r'^\s*\S+\s+"?([^"]*)"?\s*$', 1).alias("v")))
    keys = F.array_distinct(F.transform(parsed, lambda x: x["k"]))
    values = F.transform(keys, lambda k: F.transform(F.filter(parsed, lambda x: x["k"] == k), lambda x: x["v"]))
    bad = F.exists(keys, lambda k: (k != "tag") & (F.size(F.filter(parsed, lambda x: x["k"] == k)) > 1))
    return F.when(bad, F.raise_error(F.concat(F.lit("a GTF attribute repeats: "), F.col(column)))).otherwise(F.map_from_arrays(keys, values))


def gtf_exons(gtf: DataFrame, feature: str = "exon") -> DataFrame:
    """Distinct (chr, start_pos, end_pos, strand, gene_name) of rows of a feature; the gene's id where it has no name."""
    rows = gtf.where(F.col("feature") == feature)
    return rows.select("chr", F.col("start").cast("long").alias("start_pos"), F.col("end").cast("long").alias("end_pos"), "strand", F.coalesce(attribute("gene_name"), attribute("gene_id")).alias("gene_name")).distinct()


def gtf_transcripts(gtf: DataFrame) -> DataFrame:
    """Exon rows with gene, biotype and transcript, their fallbacks applied; rows that contradict
    their transcript's first row (chromosome, strand or gene) are left out. ``gtf`` has ``line``, the order of the file.
    """
    rows = gtf.where(F.col("feature") == "exon").select(
        "line",
        "chr",
        F.col("start").cast("long").alias("start_pos"),
        F.col("end").cast("long").alias("end_pos"),
        "strand",
        F.coalesce(attribute("gene_name"), attribute("gene_id"), F.lit("Unknown")).alias("gene"),
        F.coalesce(attribute("gene_id"), F.lit("Unknown")).alias("gene_id"),
        attribute("transcript_id").alias("transcript"),
        F.coalesce(attribute("transcript_type"), attribute("gene_type"), attribute("gene_biotype"), F.lit("Unknown")).alias("biotype"),
    )
    first = Window.partitionBy("transcript").orderBy("line")
    keyed = rows.where("transcript is not null").withColumn("ref", F.first(F.struct("chr", "strand", "gene_id")).over(first))
    return keyed.where("ref.chr = chr and ref.strand = strand and ref.gene_id = gene_id").drop("ref")


def transcript_introns(exons: DataFrame) -> DataFrame:
    """Gaps between a transcript's neighbouring exons, numbered along its strand.

    ``exons`` has chr, start_pos, end_pos, strand, gene, gene_id, transcript and biotype.
    """
    order = Window.partitionBy("transcript").orderBy("start_pos", "end_pos")
    gaps = exons.withColumn("next", F.lead("start_pos").over(order)).where("next is not null and next > end_pos")
    number = Window.partitionBy("transcript")
    up, down = number.orderBy("end_pos", "next"), number.orderBy(F.desc("end_pos"), F.desc("next"))
    numbered = gaps.withColumn("intron_number", F.when(F.col("strand") == "-", F.row_number().over(down)).otherwise(F.row_number().over(up)).cast("long"))
    return numbered.select("chr", F.col("end_pos").alias("a"), F.col("next").alias("b"), "gene", "gene_id", "strand", "transcript", "intron_number", "biotype")


def splice_sites(introns: DataFrame, side: str) -> DataFrame:
    """``five``: intron starts, ``three``: intron ends, as one-base sites, whatever the strand."""
    site = F.col("a") if side == "five" else F.col("b")
    return introns.select("chr", site.alias("site"), (site + 1).alias("site_end"), "gene", "gene_id", "strand", "transcript", "intron_number", "biotype")


def clusters_to_genes(introns: DataFrame, exons: DataFrame) -> DataFrame:
    """(clu, genes): names of exons that begin at an intron's end, then of those that end at an intron's start, comma-joined.

    Genes are ordered by that side, then by name, each named once.
    """
    three = introns.join(exons, (F.col("chrom") == F.col("chr")) & (F.col("b") == F.col("start_pos"))).select("clu", "gene_name", F.lit(0).alias("side"))
    five = introns.join(exons, (F.col("chrom") == F.col("chr")) & (F.col("a") == F.col("end_pos"))).select("clu", "gene_name", F.lit(1).alias("side"))
    once = three.union(five).groupBy("clu", "gene_name").agg(F.min("side").alias("side"))
    ordered = F.array_sort(F.collect_list(F.struct("side", "gene_name")))
    return once.groupBy("clu").agg(F.array_join(F.transform(ordered, lambda x: x["gene_name"]), ",").alias("genes"))


def site_genes(exons: DataFrame) -> DataFrame:
    """(chr, site) -> gene from both ends of every exon: the last one by ``line``, where exons have it, else by (start, end, name), wins."""
    order = ("line", "gene_name") if "line" in exons.columns else ("start_pos", "end_pos", "gene_name")
    ends = exons.select("chr", F.explode(F.array("start_pos", "end_pos")).alias("site"), F.struct(*order).alias("exon"))
    return ends.groupBy("chr", "site").agg(F.max("exon")["gene_name"].alias("gene"))


def intron_gene(introns: DataFrame, exons: DataFrame) -> DataFrame:
    """The gene of an intron's start, else of its end, else ``?``, as ``gene``."""
    sites = site_genes(exons)
    start, end = (sites.select(F.col("chr").alias(f"chr_{c}"), F.col("site").alias(f"site_{c}"), F.col("gene").alias(f"gene_{c}")) for c in "ab")
    met = introns.join(start, (F.col("chrom") == F.col("chr_a")) & (F.col("a") == F.col("site_a")), "left").join(end, (F.col("chrom") == F.col("chr_b")) & (F.col("b") == F.col("site_b")), "left")
    return met.withColumn("gene", F.coalesce("gene_a", "gene_b", F.lit("?"))).drop("chr_a", "site_a", "gene_a", "chr_b", "site_b", "gene_b")


def with_chr(column: str, first: str | None) -> Column:
    """Prefix ``chr`` for the whole column if its first value lacks it."""
    return F.col(column) if first is not None and first.startswith("chr") else F.concat(F.lit("chr"), F.col(column))


def intron_meta(column: str) -> Column:
    """Struct of an id ``chr:start:end:clu``: chr, start, end, clu, middle."""
    part = lambda i: F.split_part(F.col(column), F.lit(":"), F.lit(i))
    start, end = part(2).cast("long"), part(3).cast("long")
    return F.struct(part(1).alias("chr"), start.alias("start"), end.alias("end"), part(4).alias("clu"), ((start + end) * 0.5).alias("middle"))
