"""Plot tables on small golden cases."""

import math

from intronaut.operators import plotdata, plots


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_arcs_alternate_and_leave_out_zeros(spark):
    introns = frame(spark, [(1, 100, 200, 5), (1, 100, 300, 0), (1, 150, 300, 2), (2, 10, 20, None)], "clu long, a long, b long, n long")
    coords = plotdata.plot_coords(introns, "clu")
    got = {(r.a, r.b): r for r in plots.edges(introns, coords, "n", "clu").collect()}
    assert set(got) == {(100, 200), (150, 300)}
    assert got[100, 200].i == 1 and got[100, 200].height > 0 and got[150, 300].i == 3
    length = math.log(51) + math.log(51)
    assert abs(got[100, 200].x1 - length) < 1e-12 and abs(got[100, 200].height - 1 - math.sqrt(length)) < 1e-12
    points = plots.curves(plots.edges(introns, coords, "n", "clu").where("a = 100"), "n", 3).orderBy("t").collect()
    assert [round(p.y, 9) for p in points] == [0.0, round(got[100, 200].height * (6 + 4 * 2 * 2 / 3) / 16, 9), 0.0]
    assert abs(points[1].weight - math.log10(6)) < 1e-9


def test_drawn_exons_have_a_least_length_and_a_place_once(spark):
    coords = frame(spark, [(1, 100, 0.0), (1, 200, 4.0), (1, 300, 8.0)], "clu long, position long, coord double")
    exons = frame(spark, [(1, 100, 101, "+", "B"), (1, 10, 50, "+", "C"), (1, 20, 60, "+", "A"), (1, 150, 250, "-", "B")], "clu long, start_pos long, end_pos long, strand string, gene_name string")
    got = sorted((r.x, r.xend, r.label) for r in plots.drawn_exons(exons, coords, "clu").collect())
    assert got == [(0.0, 0.5, "A"), (2.0, 6.0, "B")]
    strands = plots.principal_strand(exons, "clu").collect()
    assert [(r.gene, r.strand) for r in strands] == [("B", None)]


def test_arrows_stand_in_wide_gaps(spark):
    drawn = frame(spark, [(1, 0.0, 1.0), (1, 1.1, 2.0), (1, 6.0, 7.0), (2, 0.0, 1.0), (2, 3.0, 4.0)], "clu long, x double, xend double")
    strands = frame(spark, [(1, "+"), (2, "-")], "clu long, strand string")
    totals = frame(spark, [(1, 10.0), (2, 10.0)], "clu long, total double")
    got = sorted((r.clu, r.x, r.xend) for r in plots.strand_arrows(drawn, strands, totals, "clu").collect())
    assert got == [(1, 2.0, 4.0), (2, 2.0, 3.0)]
    assert plots.strand_arrows(drawn.limit(0), strands, totals, "clu").count() == 0


def test_exons_beside_the_axis(spark):
    coords = frame(spark, [("G", 100, 0.0), ("G", 200, 4.0)], "gene_name string, position long, coord double")
    exons = frame(spark, [("G", 10, 50, "+"), ("G", 40, 90, "+"), ("G", 120, 150, "+"), ("G", 250, 350, "+")], "gene_name string, start_pos long, end_pos long, strand string")
    got = {(r.side, r.start_pos): (round(r.x, 6), round(r.xend, 6)) for r in plots.outer_exons(exons, coords, "gene_name").collect()}
    up, down = math.log(81), math.log(101)
    assert got == {("up", 10): (round(-up, 6), round(-up / 2, 6)), ("up", 40): (round(-up + 30 / 80 * up, 6), 0.0), ("down", 250): (4.0, round(4 + down, 6))}


def test_labels_alternate_and_lose_missing_p_values(spark):
    arcs = frame(spark, [("G", 1, "clu_1_+", 0.0, 2.0, 3.0), ("G", 2, "clu_2_-", 5.0, 6.0, -2.0), ("G", 1, "clu_1_+", 1.0, 4.0, -1.0)], "gene string, clu long, name string, x0 double, x1 double, height double")
    tested = frame(spark, [(1, 0.25)], "clu long, p_adjust double")
    got = {r.clu: (r.label, r.label_y) for r in plots.cluster_labels(arcs, tested, "gene").collect()}
    assert got == {1: ("clu\n1\n0.25", -1.6), 2: ("clu\n2", 2.4000000000000004)}
    split = plots.split_edges(arcs, tested, 0.3).collect()
    assert {(r.clu, r.significant, r.fdr) for r in split} == {(1, True, "0.25"), (2, False, ".")}


def test_points_among_many_knots(spark):
    """A cluster of 100 000 knots, points on, between and beyond them; one without knots has no coordinates."""
    import numpy as np

    knots = spark.range(100_000).selectExpr("1L as clu", "id * 3 as position", "double(id * id % 1009) as coord")
    asked = [-5, 0, 1, 3, 299_996, 299_997, 299_998, 400_000, *range(7, 290_000, 9973)]
    points = spark.createDataFrame([(1, p) for p in asked] * 2 + [(2, 5), (1, None)], "clu long, position long")
    got = {r.position: r.coord for r in plotdata.invert_mapping(points, knots, "clu").collect()}
    n = np.arange(100_000)
    assert sorted(got) == sorted(set(asked)) and all(abs(got[p] - np.interp(p, n * 3, n * n % 1009)) < 1e-9 for p in asked)


def test_quantiles_of_all_p_values(spark):
    rows = [(i, (i * 7919 % 1000 + 1) / 1001) for i in range(1000)] + [(-1, None), (-2, 0.5), (-3, 0.5)]
    got = plotdata.qq_points(spark.createDataFrame(rows, "i int, p double").repartition(5), "p").collect()
    known = sorted(p for _, p in rows if p is not None)
    want = [(-math.log10(p), -math.log10((k + 0.5) / len(known))) for k, p in enumerate(known)]
    assert all(abs(a - c) < 1e-12 and abs(b - d) < 1e-12 for (a, b), (c, d) in zip(sorted(map(tuple, got)), sorted(want), strict=True))


def test_equal_p_values_are_dealt_out_in_pieces(spark):
    """90 000 rows of 2 values: no task of the result holds more than a share of one of them."""
    rows = spark.range(90_000).selectExpr("if(id % 3 = 0, 0.25D, 0.5D) as p")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = plotdata.qq_points(rows, "p")
        sizes = [n for n in found.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect() if n]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(sizes) == 90_000 and max(sizes) < 60_000 and len(sizes) > 2
    want = sorted([round(-math.log10((i + 0.5) / 90_000), 9) for i in range(90_000)])
    assert sorted(round(r.expected, 9) for r in found.collect()) == want
