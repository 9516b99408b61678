"""Writers of the text formats and of result bundles. Each writes a folder in parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intronaut.functions.text import number
from intronaut.operators.clustering import intron_id
from intronaut.operators.counts import wide


def named(samples: list[str]) -> list[Column]:
    """Columns of samples, whose names may have dots."""
    return [F.col(f"`{s}`") for s in samples]


def cluster_lines(introns: DataFrame, *keys: str) -> DataFrame:
    """(keys, value): a line ``chrom:strand a:b:n ...`` for each group of introns, in the order of (a, b)."""
    item = F.struct("a", "b", "n")
    text = lambda x: F.concat_ws(":", *[x[c].cast("string") for c in ("a", "b", "n")])
    grouped = introns.groupBy("chrom", "strand", *keys).agg(F.array_sort(F.collect_list(item)).alias("x"))
    return grouped.select(*keys, F.concat_ws(" ", F.concat_ws(":", "chrom", "strand"), F.array_join(F.transform("x", text), " ")).alias("value"))


def write_pooled(islands: DataFrame, path: str) -> None:
    """Islands of two introns or more."""
    lines = cluster_lines(islands, "island").where(F.size(F.split("value", " ")) > 2)
    lines.select("value").write.mode("overwrite").text(path)


def write_refined(clusters: DataFrame, path: str) -> None:
    """Clusters in the order of their numbers."""
    cluster_lines(clusters, "clu").orderBy("clu").select("value").write.mode("overwrite").text(path)


def write_counts(counts: DataFrame, samples: list[str], path: str, cell: str = "ratios") -> None:
    """The matrix of ``n/tot`` (``ratios``) or ``n`` (``numers``), gzip text with a header of samples."""
    table = wide(counts, samples, cell)
    _tsv(table.select(F.col("intron").alias("chrom" if cell == "ratios" else "intron"), *named(samples)), path, sep=" ")


def _tsv(df: DataFrame, path: str, sep: str = "\t", header: bool = True) -> None:
    df.write.mode("overwrite").csv(path, sep=sep, header=header, compression="gzip", emptyValue="")


def write_sample_files(counts: DataFrame, path: str) -> None:
    """A file ``id n/tot`` per sample under a header, in the order of the text of (chrom, a, b), and the list of their folders."""
    line = F.concat_ws(" ", intron_id(), F.concat_ws("/", F.col("n").cast("string"), F.col("tot").cast("string")))
    rows = counts.select("sample", "chrom", F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), line.alias("value"))
    samples = counts.select("sample").distinct()
    heads = samples.select("sample", *(F.lit(None).cast("string").alias(c) for c in ("chrom", "a", "b")), F.concat_ws(" ", F.lit("chrom"), "sample").alias("value"))
    ordered = heads.unionByName(rows).repartition("sample").sortWithinPartitions("sample", F.asc_nulls_first("chrom"), "a", "b")
    ordered.select("sample", "value").write.mode("overwrite").partitionBy("sample").text(f"{path}/files", compression="gzip")
    samples.select(F.concat(F.lit(f"{path}/files/sample="), "sample").alias("value")).orderBy("value").write.mode("overwrite").text(f"{path}/list")


def write_junctions(junctions: DataFrame, path: str) -> None:
    _tsv(junctions.select("chrom", "start", "end", F.lit(".").alias("dot"), "n", "strand"), path, header=False)


def write_bed(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").text(path)


def write_differential(table: DataFrame, effects: DataFrame, groups: tuple[str, str], path: str) -> None:
    """``cluster_significance`` and ``effect_sizes``, whose psi columns carry the names of the groups."""
    _tsv(table, f"{path}_cluster_significance")
    _tsv(effects.withColumnRenamed("baseline", groups[0]).withColumnRenamed("perturbed", groups[1]), f"{path}_effect_sizes")


def write_outliers(cells: DataFrame, clusters: DataFrame, samples: list[str], path: str, verbose: bool = False) -> None:
    """``pVals``, ``effSize`` and ``clusterPvals``, a column per sample; if ``verbose``, ``controlMean`` and ``test`` (shares) too.

    ``cells`` has id, sample, p, effect, share and mean_share, ``clusters`` clu, sample, p.
    """

    def spread(table: DataFrame, key: str, value: str) -> DataFrame:
        return table.groupBy(key).pivot("sample", samples).agg(F.first(value)).select(F.col(key).alias("id"), *named(samples))

    _tsv(spread(cells, "id", "p"), f"{path}_pVals")
    _tsv(spread(cells, "id", "effect"), f"{path}_effSize")
    _tsv(spread(clusters, "clu", "p"), f"{path}_clusterPvals")
    if verbose:
        _tsv(cells.select("id", "mean_share").distinct(), f"{path}_controlMean", header=False)
        _tsv(spread(cells, "id", "share"), f"{path}_test")


def write_phenotypes(table: DataFrame, value: str, samples: list[str], path: str) -> None:
    """A matrix per chromosome (``#Chr``, start, end, ID, samples), its rows in the order of (start, id)."""
    rows = table.groupBy("chrom", "a", "b", "clu").pivot("sample", samples).agg(F.first(value))
    wide_rows = rows.select("chrom", F.col("chrom").alias("#Chr"), F.col("a").alias("start"), F.col("b").alias("end"), phenotype_ids().alias("ID"), *named(samples))
    ordered = wide_rows.repartition("chrom").sortWithinPartitions("chrom", "start", "ID")
    ordered.write.mode("overwrite").partitionBy("chrom").csv(path, sep="\t", header=True, compression="gzip")


def phenotype_ids() -> Column:
    """``chrom:a:b:clu_<N>``."""
    return F.concat_ws(":", "chrom", F.col("a").cast("string"), F.col("b").cast("string"), F.concat(F.lit("clu_"), F.col("clu").cast("string")))


def write_phenotype_summary(summary: DataFrame, components: DataFrame, chroms: list[str], samples: list[str], path: str) -> None:
    """``.ave`` (id, least, largest and mean ratio), ``.PCs`` (a row per component) and the ``_prepare.sh`` that indexes the matrices."""
    text = [number(F.col(c)) for c in ("min_ratio", "max_ratio", "mean_ratio")]
    summary.select(F.concat_ws(" ", phenotype_ids(), *text).alias("value")).write.mode("overwrite").text(f"{path}.ave")
    loadings = components.groupBy("pc").pivot("sample", samples).agg(F.first("loading"))
    _tsv(loadings.select(F.col("pc").alias("id"), *named(samples)).orderBy("id").coalesce(1), f"{path}.PCs")
    script = [(line,) for c in chroms for line in (f"bgzip -f {path}.qqnorm_{c}", f"tabix -p bed {path}.qqnorm_{c}.gz")]
    summary.sparkSession.createDataFrame(script, "value string").coalesce(1).write.mode("overwrite").text(f"{path}_prepare.sh")


def write_annotation(exons: DataFrame, introns: DataFrame, five: DataFrame, three: DataFrame, path: str) -> None:
    """Exons, introns and both kinds of splice sites, the last three in the order of gene, transcript, number."""
    _tsv(exons, f"{path}_all_exons")
    for name, table in (("all_introns", introns), ("fiveprime", five), ("threeprime", three)):
        _tsv(table.orderBy("gene_id", "transcript", "intron_number"), f"{path}_{name}", header=False)


def write_clusters_to_genes(stats: DataFrame, path: str) -> None:
    """Usage of each intron with two decimals."""
    shown = [F.format_string("%.2f", c).alias(c) for c in ("mean_usage", "median_usage", "min_usage", "max_usage")]
    _tsv(stats.select("clu", "chrom", "a", "b", "gene", *shown), path)


def write_bundle(tables: dict[str, DataFrame], path: str) -> None:
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")


def shown(value: Column, digits: int = 3) -> Column:
    """A number rounded for display, ``.`` for null."""
    return F.coalesce(F.round(value, digits).cast("string"), F.lit("."))
