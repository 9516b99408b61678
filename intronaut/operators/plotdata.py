"""Tables behind the plots: coordinates, edges, exons, gene spans, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from intronaut.functions.ordering import placed
from intronaut.functions.products import column_products
from intronaut.scratch import materialize

#: Equal p-values whose places are made in one row.
PIECE = 20_000


def plot_coords(introns: DataFrame, *by: str) -> DataFrame:
    """(by, position, coord): sorted distinct ends of introns, drawn at the running sum of log(distance + 1)."""
    positions = introns.select(*by, F.explode(F.array("a", "b")).alias("position")).distinct()
    w = Window.partitionBy(*by).orderBy("position")
    step = F.coalesce(F.log1p((F.col("position") - F.lag("position").over(w)).cast("double")), F.lit(0.0))
    return positions.withColumn("step", step).withColumn("coord", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("step")


def invert_mapping(points: DataFrame, knots: DataFrame, *by: str) -> DataFrame:
    """Points (by, position) in the coordinates of knots (by, position, coord): linear between knots, the outer
    knots' coordinate beyond them.

    Points and knots are sorted together; the last knot is carried forward and, in the opposite order, the next one backward.
    """
    knot = F.struct("position", "coord")
    both = knots.select(*by, "position", F.lit(0).alias("asked"), knot.alias("knot")).unionByName(points.where("position is not null").distinct().select(*by, "position", F.lit(1).alias("asked")), allowMissingColumns=True)
    whole = Window.unboundedPreceding, Window.currentRow
    last = F.last("knot", ignorenulls=True)
    # a knot at the point itself is the last one, not the next one
    low = last.over(Window.partitionBy(*by).orderBy("position", "asked").rowsBetween(*whole))
    high = last.over(Window.partitionBy(*by).orderBy(F.desc("position"), F.desc("asked")).rowsBetween(*whole))
    met = both.withColumn("low", low).withColumn("high", high).where("asked = 1 and (low is not null or high is not null)")
    share = (F.col("position") - F.col("low.position")) / (F.col("high.position") - F.col("low.position"))
    between = F.col("low.coord") + share * (F.col("high.coord") - F.col("low.coord"))
    return met.select(*by, "position", F.when(F.col("low").isNull(), F.col("high.coord")).when(F.col("high").isNull(), F.col("low.coord")).otherwise(between).alias("coord"))


def exons_near(exons: DataFrame, introns: DataFrame, longest: int = 500) -> DataFrame:
    """Exons of each cluster's stretch that touch one of its splice sites, each once; longer ones only at its outer edges."""
    columns = ("chr", "start_pos", "end_pos", "strand", "gene_name")
    span = introns.groupBy("clu").agg(F.min("a").alias("low"), F.max("b").alias("high"))
    # an exon touches a cluster by an equal coordinate
    sides = (("start_pos", "b"), ("end_pos", "a"))
    touching = [exons.join(introns.select("clu", "chrom", c).distinct(), (F.col("chr") == F.col("chrom")) & (F.col(e) == F.col(c))).select("clu", *columns) for e, c in sides]
    met = touching[0].union(touching[1]).distinct().join(span, "clu")
    near = F.col("start_pos").between(F.col("low"), F.col("high")) | F.col("end_pos").between(F.col("low"), F.col("high"))
    short = (F.col("end_pos") - F.col("start_pos") <= longest) | (F.col("end_pos") == F.col("low")) | (F.col("start_pos") == F.col("high"))
    return met.where(near & short).select("clu", *columns)


def gene_exons(exons: DataFrame, longest: int = 1000) -> DataFrame:
    """Exons of each gene once, without long ones."""
    return exons.dropDuplicates(["gene_name", "start_pos", "end_pos"]).where(F.col("end_pos") - F.col("start_pos") <= longest)


def gene_span(exons: DataFrame) -> DataFrame:
    """First and last base of each gene and the width of its plot in pixels, null for automatic."""
    span = exons.groupBy("gene_name").agg(F.min("start_pos").alias("first"), F.max("end_pos").alias("last")).withColumn("length", F.col("last") - F.col("first"))
    pixels = F.when(F.col("length") > 1_000_000, 5000).when((F.col("length") > 500_000) & (F.col("length") < 1_000_000), 3000).when((F.col("length") > 150_000) & (F.col("length") <= 500_000), 2000)
    return span.withColumn("pixels", pixels)


def introns_in_genes(introns: DataFrame, exons: DataFrame, bin_size: int = 100_000) -> DataFrame:
    """Introns inside a gene's span on its chromosome, by an equi-join on bins of the intron's start."""
    span = exons.groupBy("gene_name", "chr").agg(F.min("start_pos").alias("first"), F.max("end_pos").alias("last"))
    binned = span.withColumn("bin", F.explode(F.sequence(F.floor(F.col("first") / bin_size), F.floor(F.col("last") / bin_size))))
    own = introns.withColumn("bin", F.floor(F.col("a") / bin_size))
    return own.join(binned, (F.col("chrom") == F.col("chr")) & (own["bin"] == binned["bin"])).where((F.col("a") >= F.col("first")) & (F.col("b") <= F.col("last"))).select("gene_name", "chrom", "a", "b")


def gaps(intervals: DataFrame, *by: str) -> DataFrame:
    """Gaps between the islands of (low, high) intervals of each ``by``."""
    w = Window.partitionBy(*by).orderBy("low", "high")
    reach = F.max("high").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return intervals.withColumn("from", reach).where("from < low").select(*by, F.col("from").alias("low"), F.col("low").alias("high"))


def group_usage(psi: DataFrame, groups: DataFrame) -> DataFrame:
    """Mean share of each intron in each group, samples without reads of the cluster left out."""
    return psi.join(F.broadcast(groups.select("sample", "grp")), "sample").groupBy("clu", "a", "b", "grp").agg(F.avg("psi").alias("mean_psi"), F.sum("n").alias("reads"))


def letters(effects: DataFrame) -> DataFrame:
    """Label the introns of a cluster a, b, ... by falling size of effect."""
    w = Window.partitionBy("clu").orderBy(F.desc(F.abs("deltapsi")), "a", "b")
    return effects.withColumn("label", F.chr(F.lit(96) + F.row_number().over(w)))


def parity(rows: DataFrame, order: str, *by: str) -> DataFrame:
    """Alternate ``up`` and ``down`` along the order."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    return rows.withColumn("side", F.when(n % 2 == 1, "up").otherwise("down"))


def annotation_db(path: Column) -> Column:
    """The genome build in the name of an annotation, ``<anything>_<build>_...``; null if there is none."""
    return F.get(F.split(F.substring_index(path, "/", -1), "_"), F.lit(1))


def browser_url(chrom: Column, first: Column, last: Column, db: Column, margin: int = 100) -> Column:
    """Genome-browser link with a margin on both sides; the organism is told for human and mouse builds."""
    org = F.when(db.contains("mm"), "&org=mouse").when(db.contains("hg"), "&org=human").otherwise("")
    return F.concat(F.lit("http://genome.ucsc.edu/cgi-bin/hgTracks?"), org, F.lit("&db="), db, F.lit("&position="), chrom, F.lit(":"), (first - margin).cast("string"), F.lit("-"), (last + margin).cast("string"))


def edge_labels(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """Extent and middle of each cluster's edges with its adjusted p-value, ``.`` where it has none, as label."""
    extent = edges.groupBy("clu").agg(F.min("a").alias("first"), F.max("b").alias("last"))
    fdr = F.coalesce(F.format_number("p_adjust", 4), F.lit("."))
    return extent.join(clusters.select("clu", "p_adjust"), "clu", "left").select("clu", "first", "last", ((F.col("first") + F.col("last")) * 0.5).alias("middle"), F.concat(F.lit("clu_"), F.col("clu").cast("string"), F.lit("\n"), fdr).alias("label"))


def pca_samples(psi: DataFrame, samples: list[str], max_missing: float = 0.4) -> tuple[DataFrame, list[float]]:
    """Scores of the samples on the components of scaled usage and the components' share of variance in per cent.

    Introns with few missing shares and some spread are scaled; their samples x samples products are summed
    in the tasks, and only that small matrix is decomposed on the driver.
    """
    import numpy as np

    wide = psi.groupBy("clu", "a", "b").pivot("sample", samples).agg(F.first("psi"))
    x = F.array(*[F.col(f"`{s}`") for s in samples])
    known = F.filter(x, lambda v: v.isNotNull())
    n = len(samples)
    mean = F.aggregate(known, F.lit(0.0), lambda s, v: s + v) / F.size(known)
    rows = wide.select(x.alias("x"), F.size(known).alias("k"), F.when(F.size(known) > 0, mean).alias("m")).where(F.col("k") >= n * (1 - max_missing)).select(F.transform("x", lambda v: F.coalesce(v, F.col("m")) - F.col("m")).alias("x"))
    rows = rows.withColumn("sd", F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v) / (n - 1))).where("sd > 0").select(F.transform("x", lambda v: v / F.col("sd")).alias("x"))
    _, _, gram = column_products(rows, "x", n)
    gram = gram - gram.mean(axis=0) - gram.mean(axis=1)[:, None] + gram.mean()
    values, vectors = np.linalg.eigh(gram)
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
    scores = vectors * np.sqrt(values)
    total = values.sum() or 1.0
    data = [(s, j + 1, float(scores[i, j])) for i, s in enumerate(samples) for j in range(n)]
    return psi.sparkSession.createDataFrame(data, "sample string, pc int, score double"), [float(f"{100 * v / total:.2g}") for v in values]


def scores_with_meta(scores: DataFrame, meta: DataFrame) -> DataFrame:
    """Scores of the samples that ``meta`` (a row per sample) knows, with its columns."""
    return scores.join(F.broadcast(meta), "sample")


def qq_points(table: DataFrame, p: str, *by: str) -> DataFrame:
    """Observed against expected -log10 p-values, ``(i - 0.5) / n`` for the i-th.

    Without ``by`` the places come from range partitions of the distinct p-values, and their rows are made in pieces: no task sees all
    p-values, nor all that are equal.
    """
    if not by:
        # equal p-values take a run of places: one row each until they are dealt out in pieces
        values = placed(table.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("p")).agg(F.count("*").alias("m")), "p", sums=("m",))
        values = materialize(values, "p_values")
        n = values.agg(F.sum("m")).first()[0] or 0
        # a set number of tasks: the pieces are few and become many rows
        tasks = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        pieces = values.select("p", "m", "_before_m", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1, F.lit(PIECE).cast("long"))).alias("first")).repartition(tasks, "p", "first")
        ranked = pieces.select("p", F.explode(F.sequence(F.col("_before_m") + F.col("first") + 1, F.col("_before_m") + F.least(F.col("first") + PIECE, F.col("m")))).alias("i"))
        return ranked.select((-F.log10("p")).alias("observed"), (-F.log10((F.col("i") - 0.5) / F.lit(n))).alias("expected"))
    w = Window.partitionBy(*by)
    i = F.row_number().over(w.orderBy(p))
    return table.where(F.col(p).isNotNull()).select(*by, (-F.log10(p)).alias("observed"), (-F.log10((i - 0.5) / F.count("*").over(w))).alias("expected"))
