"""Readers of the text formats: junctions, clusters, count matrices, groups, annotation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from intronaut.functions.ordering import numbered
from intronaut.operators.clustering import known_chromosomes
from intronaut.operators.genes import GTF_COLUMNS
from intronaut.operators.phenotype import BLACKLIST

JUNCTION = ("chrom", "strand", "sample", "a", "b", "n")


def _lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines with their sample: the name up to ``.junc`` of the file or of the folder that it is in, else the file's name.

    A folder may be a partition, as in ``file=S0.junc``. Gzip is transparent, a missing path is an error.
    """
    path = F.col("_metadata.file_path")
    name = F.coalesce(F.nullif(F.regexp_extract(path, r"(?:^|[/=])([^/=]+?)\.junc", 1), F.lit("")), F.element_at(F.split(path, "/"), -1))
    return spark.read.text(paths).select("value", name.alias("sample"))


def _part(i: int) -> Column:
    return F.get("p", F.lit(i))


def read_bed12(spark: SparkSession, paths: str | list[str], check_chromosomes: bool = True) -> DataFrame:
    """Junctions from BED12 rows of two blocks; rows with fewer than 12 fields or more than 2 blocks are skipped."""
    rows = _lines(spark, paths).withColumn("p", F.split(F.trim("value"), r"\s+")).where(F.size("p") >= 12).where(_part(9).cast("int") <= 2)
    sizes = F.split(_part(10), ",")
    a = _part(1).cast("long") + F.get(sizes, F.lit(0)).cast("long")
    b = _part(2).cast("long") - F.get(sizes, F.lit(1)).cast("long") + 1
    out = rows.select(_part(0).alias("chrom"), _part(5).alias("strand"), "sample", a.alias("a"), b.alias("b"), _part(4).cast("long").alias("n"))
    return known_chromosomes(out) if check_chromosomes else out


def read_junctions(spark: SparkSession, paths: str | list[str], use_strand: bool = False, check_chromosomes: bool = False) -> DataFrame:
    """Junctions from rows of six fields; the strand is ``NA`` unless used."""
    rows = _lines(spark, paths).withColumn("p", F.split(F.trim("value"), r"\s+")).where(F.size("p") == 6)
    strand = _part(5) if use_strand else F.lit("NA")
    out = rows.select(_part(0).alias("chrom"), strand.alias("strand"), "sample", _part(1).cast("long").alias("a"), (_part(2).cast("long") + 1).alias("b"), _part(4).cast("long").alias("n"))
    return known_chromosomes(out) if check_chromosomes else out


def read_manifest(spark: SparkSession, path: str) -> list[str]:
    """Paths listed one per line: as many as there are input files."""
    return [r.value.strip() for r in spark.read.text(path).where(F.trim("value") != "").collect()]


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """Refined clusters (clu, chrom, strand, a, b, n) from lines ``chrom:strand a:b:n ...``, numbered in the order of the file."""
    place = (F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    lines = spark.read.text(path).select("value", *place).where(F.trim("value") != "")
    ordered = numbered(lines, "clu", "file", "block", "line").withColumn("p", F.split(F.trim("value"), r"\s+"))
    introns = ordered.select("clu", F.split(_part(0), ":").alias("h"), F.explode(F.slice("p", F.lit(2), F.size("p"))).alias("x")).withColumn("x", F.split("x", ":"))
    number = lambda i: F.get("x", F.lit(i)).cast("long")
    return introns.select("clu", F.get("h", F.lit(0)).alias("chrom"), F.get("h", F.lit(1)).alias("strand"), number(0).alias("a"), number(1).alias("b"), number(2).alias("n"))


def read_matrix(spark: SparkSession, path: str | list[str], skip: str = "#") -> DataFrame:
    """Matrices of text cells as (id, sample, value) rows, from any number of files.

    The first line of a file that does not begin with ``skip`` names its samples, with or without a name for the id column,
    so files may have other samples or another order of them; a line that repeats the header of its file is one too. Short rows have a null for the last samples.
    The headers, one row for each file of the listing, are found in a scan of their own and sent to all tasks.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("place"))
    lines = lines.where((F.trim("value") != "") & ~F.col("value").startswith(skip)) if skip else lines.where(F.trim("value") != "")
    cells = F.split(F.trim("value"), r"\s+")
    heads = lines.groupBy("file").agg(F.min_by("value", "place").alias("header"), F.max(F.size(cells)).alias("width"))
    names = F.split(F.trim("header"), r"\s+")
    samples = F.when(F.size(names) == F.col("width"), F.slice(names, F.lit(2), F.size(names))).otherwise(names)
    rows = lines.join(F.broadcast(heads.select("file", "header", samples.alias("samples"))), "file").where(F.col("value") != F.col("header")).withColumn("p", cells)
    listed = F.transform("samples", lambda s, i: F.struct(s.alias("sample"), F.get("p", i + 1).alias("value")))
    return rows.select(_part(0).alias("id"), F.explode(listed).alias("c")).select("id", "c.sample", "c.value")


def read_rows(spark: SparkSession, path: str | list[str], skip: str = "#") -> DataFrame:
    """A table of text cells as (id, cells): a map from column to cell for each row; short rows have a null in the last columns."""
    cells = read_matrix(spark, path, skip)
    return cells.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("sample", "value"))).alias("cells"))


def read_chromosomes(spark: SparkSession, path: str | None = None) -> list[str]:
    """Chromosome names, one per line, as many as a genome has; the default blacklist without a path."""
    if path is None:
        return list(BLACKLIST)
    return [r.value.strip() for r in spark.read.text(path).where(F.trim("value") != "").collect()]


def read_counts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(clu, chrom, a, b, sample, n, tot) from a matrix of counts or of ``n/tot`` cells; ``clu`` is the name in the id."""
    cells = read_matrix(spark, path)
    part = lambda i: F.split_part("id", F.lit(":"), F.lit(i))
    n, tot = F.split_part("value", F.lit("/"), F.lit(1)), F.nullif(F.split_part("value", F.lit("/"), F.lit(2)), F.lit(""))
    return cells.select(part(4).alias("clu"), part(1).alias("chrom"), part(2).cast("long").alias("a"), part(3).cast("long").alias("b"), "sample", n.cast("long").alias("n"), tot.cast("long").alias("tot"))


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """Samples, groups and covariates ``x1``, ``x2``, ... without header."""
    rows = spark.read.text(path).where(F.trim("value") != "").withColumn("p", F.split(F.trim("value"), r"\s+"))
    width = rows.agg(F.max(F.size("p"))).first()[0] or 2
    return rows.select(_part(0).alias("sample"), _part(1).alias("grp"), *[_part(i).alias(f"x{i - 1}") for i in range(2, width)])


def read_exons(spark: SparkSession, path: str) -> DataFrame:
    """Exons with a header: chr, start, end, strand, gene_name."""
    rows = spark.read.csv(path, sep="\t", header=True)
    return rows.select("chr", F.col("start").cast("long").alias("start_pos"), F.col("end").cast("long").alias("end_pos"), "strand", "gene_name")


def read_gtf(spark: SparkSession, path: str) -> DataFrame:
    """GTF rows with ``line``, their order; comments and blank lines are skipped."""
    lines = spark.read.text(path).withColumn("line", F.monotonically_increasing_id()).where((F.trim("value") != "") & ~F.col("value").startswith("#"))
    parts = lines.withColumn("p", F.split("value", "\t"))
    return parts.select("line", *[_part(i).cast("long" if c in ("start", "end") else "string").alias(c) for i, c in enumerate(GTF_COLUMNS)])


def read_splice_sites(spark: SparkSession, path: str) -> DataFrame:
    """Annotated introns or sites: chr, a, b, gene, gene_id, strand, transcript, intron_number, biotype."""
    rows = spark.read.csv(path, sep="\t", schema="chr string, a long, b long, gene string, gene_id string, strand string, transcript string, intron_number long, biotype string")
    first = rows.first()
    return rows.withColumn("chr", F.col("chr") if first is None or first.chr.startswith("chr") else F.concat(F.lit("chr"), "chr"))


def read_bundle(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    """Tables of a result bundle by name."""
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}
