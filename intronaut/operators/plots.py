"""Composite tables behind the plots of clusters and genes: curves, drawn exons, strand arrows, labels.

All work per cluster or gene (the columns named by ``by``); nothing is drawn here.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from intronaut.operators.plotdata import gaps, invert_mapping, plot_coords

#: Shortest drawn exon and the share of the axis that a gap needs for an arrow.
SHORTEST_EXON, ARROW_SHARE = 0.5, 0.025


def edges(introns: DataFrame, coords: DataFrame, value: str, *by: str) -> DataFrame:
    """Introns with a non-zero ``value`` as arcs: x0, x1, height and their number ``i`` among the introns of ``by`` by (a, b).

    Odd ones go up, even ones down. A null value counts as zero. ``total`` is the length of the axis.
    """
    number = F.dense_rank().over(Window.partitionBy(*by).orderBy("a", "b"))
    placed = introns.withColumn("i", number.cast("long")).where(F.coalesce(F.col(value), F.lit(0)) != 0)
    ends = [coords.select(*by, F.col("position").alias(c), F.col("coord").alias(x)) for c, x in (("a", "x0"), ("b", "x1"))]
    total = coords.groupBy(*by).agg(F.max("coord").alias("total"))
    met = placed.join(ends[0], [*by, "a"]).join(ends[1], [*by, "b"]).join(total, list(by))
    up = F.when(F.col("i") % 2 == 1, 1.0).otherwise(-1.0)
    return met.withColumn("height", (1 + F.sqrt(F.col("x1") - F.col("x0"))) * up)


def curves(arcs: DataFrame, value: str, points: int = 500) -> DataFrame:
    """Each arc as ``points`` points (t, x, y) of a Bezier curve of five control points, with its stroke width ``weight``."""
    t = F.col("t") / float(points - 1)
    middle, bulge, h = (F.col("x0") + F.col("x1")) / 2, 0.1 * F.col("total"), F.col("height")
    xs = [F.col("x0"), F.col("x0") - bulge, middle, F.col("x1") + bulge, F.col("x1")]
    ys = [F.lit(0.0), h * 2 / 3, h, h * 2 / 3, F.lit(0.0)]

    def bernstein(control: list[Column]) -> Column:
        out = F.lit(0.0)
        for k, c in enumerate(control):
            out = out + c * math.comb(4, k) * F.pow(t, F.lit(k)) * F.pow(1 - t, F.lit(4 - k))
        return out

    drawn = arcs.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    weight = F.log10(1 + F.col(value)) * F.sin(t * math.pi)
    return drawn.withColumn("x", bernstein(xs)).withColumn("y", bernstein(ys)).withColumn("weight", weight)


def differential_plot(counts: DataFrame, groups: DataFrame, points: int = 500) -> dict[str, DataFrame]:
    """``axis``, ``edges`` and ``curves`` of every cluster and group: mean counts of introns (clu, a, b) over the samples of a group.

    ``groups`` has one row per sample and is small enough for every task.
    """
    coords = plot_coords(counts.select("clu", "a", "b").distinct(), "clu")
    means = counts.join(F.broadcast(groups.select("sample", "grp")), "sample").groupBy("clu", "a", "b", "grp").agg(F.avg("n").alias("mean_n"))
    numbered = edges(means.groupBy("clu", "a", "b").agg(F.lit(1).alias("any")), coords, "any", "clu").drop("any")
    arcs = numbered.join(means, ["clu", "a", "b"]).where("mean_n <> 0")
    return {"axis": coords, "edges": arcs, "curves": curves(arcs, "mean_n", points)}


def drawn_exons(exons: DataFrame, coords: DataFrame, *by: str, shortest: float = SHORTEST_EXON) -> DataFrame:
    """Exons (by, start_pos, end_pos and others) on the axis: x, xend; at least ``shortest`` long, each place once (the first gene by name)."""
    points = exons.select(*by, F.explode(F.array("start_pos", "end_pos")).alias("position"))
    mapped = invert_mapping(points, coords, *by)
    ends = [mapped.select(*by, F.col("position").alias(c), F.col("coord").alias(x)) for c, x in (("start_pos", "x"), ("end_pos", "xend"))]
    placed = exons.join(ends[0], [*by, "start_pos"]).join(ends[1], [*by, "end_pos"])
    longer = placed.withColumn("xend", F.greatest(F.col("xend"), F.col("x") + shortest))
    return longer.groupBy(*by, "x", "xend").agg(F.min("gene_name").alias("label"))


def principal_strand(exons: DataFrame, *by: str) -> DataFrame:
    """(by, gene, strand): the gene with most exons (ties by name) and its strand, null if it has both."""
    sizes = exons.groupBy(*by, "gene_name").agg(F.count("*").alias("n"), F.min("strand").alias("low"), F.max("strand").alias("high"))
    top = sizes.groupBy(*by).agg(F.max(F.struct("n")).alias("m")).join(sizes, list(by)).where("n = m.n").groupBy(*by).agg(F.min(F.struct("gene_name", "low", "high")).alias("g"))
    return top.select(*by, F.col("g.gene_name").alias("gene"), F.when(F.col("g.low") == F.col("g.high"), F.col("g.low")).alias("strand"))


def wide_gaps(intervals: DataFrame, totals: DataFrame, *by: str, share: float = ARROW_SHARE) -> DataFrame:
    """Gaps between intervals (by, low, high) wider than ``share`` of the axis (by, total)."""
    return gaps(intervals, *by).join(totals, list(by)).where((F.col("high") - F.col("low")) > share * F.col("total")).drop("total")


def strand_arrows(drawn: DataFrame, strands: DataFrame, totals: DataFrame, *by: str) -> DataFrame:
    """Arrows in the wide gaps between drawn exons: the first half of a gap on ``+``, the second on ``-``; none without a strand."""
    free = wide_gaps(drawn.select(*by, F.col("x").alias("low"), F.col("xend").alias("high")), totals, *by)
    middle = F.col("low") + (F.col("high") - F.col("low")) / 2
    plus = F.col("strand") == "+"
    met = free.join(strands.where("strand in ('+', '-')"), list(by))
    return met.select(*by, F.when(plus, F.col("low")).otherwise(middle).alias("x"), F.when(plus, middle).otherwise(F.col("high")).alias("xend"), "strand")


def outer_exons(exons: DataFrame, coords: DataFrame, *by: str) -> DataFrame:
    """Exons that begin before or end after all introns, on scales of their own beside the axis (by, position, coord).

    Those before fill ``-log(1 + length)`` to 0, those after the same beyond the axis; an exon of both kinds is in both.
    """
    axis = coords.groupBy(*by).agg(F.min("position").alias("first"), F.max("position").alias("last"), F.max("coord").alias("end"))
    met = exons.join(axis, list(by))
    out = []
    for side, outside, at in (("up", F.col("start_pos") < F.col("first"), -1), ("down", F.col("end_pos") > F.col("last"), 0)):
        mine = met.where(outside)
        knots = mine.groupBy(*by).agg(F.min("start_pos").alias("k0"), F.max("end_pos").alias("k1"))
        width = F.log1p((F.col("k1") - F.col("k0")).cast("double"))
        left = -width if at else F.col("end")
        place = lambda c: left + (F.col(c) - F.col("k0")) / (F.col("k1") - F.col("k0")) * width  # noqa: E731, B023
        out.append(mine.join(knots, list(by)).select(*dict.fromkeys((*by, "gene_name", "start_pos", "end_pos")), F.lit(side).alias("side"), place("start_pos").alias("x"), place("end_pos").alias("xend")))
    return out[0].union(out[1])


def cluster_labels(arcs: DataFrame, tested: DataFrame, *by: str) -> DataFrame:
    """Label of each cluster of a gene plot: its extent on the axis, its text and its height.

    ``arcs`` has (by, clu, name, x0, x1, height), ``tested`` (clu, p_adjust). The text is the cluster's name and its
    adjusted p-value on a further line, which is left out where there is none; the strand goes and underscores become
    line breaks. Along the axis labels stand below and above in turn, at four fifths of the lowest and highest arc.
    """
    extent = arcs.groupBy(*by, "clu", "name").agg(F.min("x0").alias("start"), F.max("x1").alias("end"), F.min("height").alias("low"), F.max("height").alias("high"))
    fdr = F.coalesce(F.col("p_adjust").cast("string"), F.lit("."))
    text = F.regexp_replace(F.concat("name", F.lit("\n"), fdr), r"\n.$", "")
    text = F.regexp_replace(F.regexp_replace(text, "_[+-]", ""), "_", "\n")
    middle = (F.col("start") + F.col("end")) / 2
    labelled = extent.join(tested.select("clu", "p_adjust"), "clu", "left").withColumn("label", text).withColumn("middle", middle)
    w, whole = Window.partitionBy(*by).orderBy("middle", "clu"), Window.partitionBy(*by)
    below = F.row_number().over(w) % 2 == 1
    height = F.when(below, 0.8 * F.min("low").over(whole)).otherwise(0.8 * F.max("high").over(whole))
    return labelled.select(*by, "clu", "start", "end", "middle", "label", height.alias("label_y"))


def split_edges(arcs: DataFrame, tested: DataFrame, limit: float = 0.05) -> DataFrame:
    """Arcs with the adjusted p-value of their cluster and whether it is significant at ``limit``; missing ones are not."""
    fdr = F.col("p_adjust")
    return arcs.join(tested.select("clu", "p_adjust"), "clu", "left").withColumn("significant", F.coalesce(fdr < limit, F.lit(False))).withColumn("fdr", F.coalesce(fdr.cast("string"), F.lit("."))).drop("p_adjust")


def cluster_plot(counts: DataFrame, groups: DataFrame, exons: DataFrame) -> dict[str, DataFrame]:
    """Tables of a plot of each cluster: arcs with mean share per group, drawn exons, arrows.

    ``counts`` has clu, a, b, sample, psi; ``exons`` the exons near each cluster (clu, start_pos, end_pos, strand, gene_name).
    """
    coords = plot_coords(counts.select("clu", "a", "b").distinct(), "clu")
    shares = counts.join(F.broadcast(groups.select("sample", "grp")), "sample").groupBy("clu", "a", "b", "grp").agg(F.avg("psi").alias("mean_psi"))
    base = edges(shares.select("clu", "a", "b").distinct().withColumn("any", F.lit(1)), coords, "any", "clu").drop("any")
    drawn = drawn_exons(exons, coords, "clu")
    totals = coords.groupBy("clu").agg(F.max("coord").alias("total"))
    return {"axis": coords, "edges": base.join(shares.where("mean_psi > 0"), ["clu", "a", "b"]), "exons": drawn, "arrows": strand_arrows(drawn, principal_strand(exons, "clu"), totals, "clu")}


def gene_plot(introns: DataFrame, exons: DataFrame, tested: DataFrame, limit: float = 0.05) -> dict[str, DataFrame]:
    """Tables of a plot of each gene: its introns (gene_name, clu, name, a, b, n) on one axis, exons on it and beside it, labels.

    ``exons`` has gene_name, start_pos, end_pos, strand; ``tested`` clu and p_adjust.
    """
    by = "gene_name"
    coords = plot_coords(introns.select(by, "a", "b").distinct(), by)
    arcs = edges(introns, coords, "n", by)
    mine = exons.join(coords.select(by).distinct(), by, "left_semi")
    drawn = drawn_exons(mine.withColumn("gene", F.col(by)), coords, by)
    totals = coords.groupBy(by).agg(F.max("coord").alias("total"))
    strands = mine.groupBy(by).agg(F.min("strand").alias("low"), F.max("strand").alias("high")).select(by, F.when(F.col("low") == F.col("high"), F.col("low")).alias("strand"))
    return {"axis": coords, "edges": split_edges(arcs, tested, limit), "exons": drawn, "outer": outer_exons(mine, coords, by), "arrows": strand_arrows(drawn, strands, totals, by), "labels": cluster_labels(arcs, tested, by)}
