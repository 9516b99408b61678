"""Annotated result tables: genes and verdicts of junctions, cluster classes, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KNOWN = ("+", "-")


def match_annotation(introns: DataFrame, known: DataFrame) -> DataFrame:
    """Left joins of introns (chrom, a, b) with annotated introns (chr, a, b, gene, strand, transcript).

    Adds genes of the pair, of the start and of the end, the transcripts at both sites, ``u5``/``u3`` (no gene at the
    start / end) and ``known_pair``. Databases are by position, the strand is not compared.
    """
    names = lambda c: F.collect_set(c)
    pair = known.groupBy(F.col("chr").alias("pc"), F.col("a").alias("pa"), F.col("b").alias("pb")).agg(F.lit(True).alias("known_pair"))
    five = known.groupBy(F.col("chr").alias("fc"), F.col("a").alias("fa")).agg(F.collect_list(F.struct("gene", "strand")).alias("five_genes"), names("transcript").alias("five_transcripts"))
    three = known.groupBy(F.col("chr").alias("tc"), F.col("b").alias("tb")).agg(F.collect_list(F.struct("gene", "strand")).alias("three_genes"), names("transcript").alias("three_transcripts"))
    met = introns.join(pair, (F.col("chrom") == F.col("pc")) & (F.col("a") == F.col("pa")) & (F.col("b") == F.col("pb")), "left")
    met = met.join(five, (F.col("chrom") == F.col("fc")) & (F.col("a") == F.col("fa")), "left").join(three, (F.col("chrom") == F.col("tc")) & (F.col("b") == F.col("tb")), "left")
    out = met.withColumn("u5", F.col("five_genes").isNull()).withColumn("u3", F.col("three_genes").isNull()).withColumn("known_pair", F.coalesce("known_pair", F.lit(False)))
    return out.drop("pc", "pa", "pb", "fc", "fa", "tc", "tb")


def cluster_gene(matched: DataFrame) -> DataFrame:
    """Per cluster the most frequent gene of its sites (ties by name) and the only strand of its genes, null if several.

    A cluster without a gene has gene ``.`` and no strand.
    """
    votes = matched.select("clu", F.explode(F.concat(F.coalesce("five_genes", F.array()), F.coalesce("three_genes", F.array()))).alias("v")).groupBy("clu", F.col("v.gene").alias("gene"), F.col("v.strand").alias("gene_strand")).agg(F.count("*").alias("n"))
    by_gene = votes.groupBy("clu", "gene").agg(F.sum("n").alias("n"))
    best = by_gene.groupBy("clu").agg(F.min(F.struct((-F.col("n")).alias("n"), "gene"))["gene"].alias("gene"))
    strands = votes.groupBy("clu").agg(F.min("gene_strand").alias("low"), F.max("gene_strand").alias("high")).select("clu", F.when(F.col("low") == F.col("high"), F.col("low")).alias("gene_strand"))
    return matched.select("clu").distinct().join(best, "clu", "left").join(strands, "clu", "left").select("clu", F.coalesce("gene", F.lit(".")).alias("gene"), "gene_strand")


def verdict(strand: str = "gene_strand") -> Column:
    """Verdict of a junction from its gene's strand, ``u5``, ``u3`` and ``known_pair``."""
    plus, minus, u5, u3 = F.col(strand) == "+", F.col(strand) == "-", F.col("u5"), F.col("u3")
    return (
        F.when(F.col(strand).isNull() | ~F.col(strand).isin(*KNOWN), "unknown_strand")
        .when(u5 & u3, "cryptic_unanchored")
        .when((plus & u3) | (minus & u5), "cryptic_threeprime")
        .when((plus & u5) | (minus & u3), "cryptic_fiveprime")
        .when(F.col("known_pair"), "annotated")
        .otherwise("novel annotated pair")
    )


def constitutive(matched: DataFrame) -> DataFrame:
    """Per intron the transcripts with both its sites over all such transcripts of its cluster, as ``constitutive``."""
    both = F.array_intersect(F.coalesce("five_transcripts", F.array().cast("array<string>")), F.coalesce("three_transcripts", F.array().cast("array<string>")))
    own = matched.withColumn("both", both)
    every = own.groupBy("clu").agg(F.size(F.array_distinct(F.flatten(F.collect_list("both")))).alias("total"))
    return own.join(every, "clu").withColumn("constitutive", F.when(F.col("total") > 0, F.size("both") / F.col("total")).otherwise(F.lit(0.0))).drop("both", "total")


def cassette(judged: DataFrame) -> DataFrame:
    """(clu, classification) from introns with a, b, deltapsi and verdict.

    A cassette exon has three introns, the second in (a, b) order spanning the other two. Both signs and
    verdicts decide, and the verdict's suffix is added to clusters that are no clear cassette too.
    """
    row = F.struct("a", "b", F.col("deltapsi").alias("d"), F.col("verdict").alias("v"))
    grouped = judged.groupBy("clu").agg(F.array_sort(F.collect_list(row)).alias("x"))
    at = lambda i: F.get("x", F.lit(i))
    x1, x2, x3 = at(0), at(1), at(2)
    low, high = F.array_min(F.transform("x", lambda r: r["a"])), F.array_max(F.transform("x", lambda r: r["b"]))
    shape = (F.size("x") == 3) & (x2["a"] == low) & (x2["b"] == high) & (x1["b"] <= x3["a"]) & (x1["a"] == x2["a"]) & (x3["b"] == x2["b"])
    sign = F.when((x1["d"] > 0) & (x2["d"] < 0) & (x3["d"] > 0), "cassette exon - increased").when((x1["d"] < 0) & (x2["d"] > 0) & (x3["d"] < 0), "cassette exon - decreased").otherwise(".")
    known = lambda r: r["v"] == "annotated"
    suffix = F.when(known(x1) & known(x2) & known(x3), " - annotated").when(known(x2) & ~known(x1) & ~known(x3), " - cryptic").when((x2["v"] == "novel annotated pair") & known(x1) & known(x3), " - skiptic").otherwise("")
    return grouped.select("clu", F.when(shape, F.concat(sign, suffix)).otherwise(".").alias("classification"))


def cluster_summary(judged: DataFrame) -> DataFrame:
    """Extent, introns, gene and annotation of each cluster; ``cryptic`` if any verdict is cryptic or a novel pair."""
    cryptic = F.bool_or(F.col("verdict").rlike("cryptic|novel annotated pair"))
    return judged.groupBy("clu").agg(F.first("chrom").alias("chrom"), F.min("a").alias("first"), F.max("b").alias("last"), F.count("*").alias("introns"), F.min("gene").alias("gene"), F.when(cryptic, "cryptic").otherwise("annotated").alias("annotation")).withColumn("coord", F.concat("chrom", F.lit(":"), F.col("first").cast("string"), F.lit("-"), F.col("last").cast("string")))


def intron_summary(judged: DataFrame) -> DataFrame:
    """Number of introns of each verdict."""
    return judged.groupBy("verdict").agg(F.count("*").alias("n"))


def top_clusters(clusters: DataFrame, fdr: str, limit: float, most: int) -> DataFrame:
    """At most ``most`` clusters below the limit, smallest first."""
    return clusters.where(F.col(fdr) < limit).orderBy(fdr, "clu").limit(most)


def first_match(left: DataFrame, right: DataFrame, key: str, order: str) -> DataFrame:
    """Left join to the first row of ``right`` of each key."""
    w = Window.partitionBy(key).orderBy(order)
    return left.join(right.withColumn("_i", F.row_number().over(w)).where("_i = 1").drop("_i"), key, "left")
