import random

from intronaut.operators import clustering, counts

J = "chrom string, strand string, sample string, a long, b long, n long"


def islands(spark, rows):
    return clustering.overlap_islands(spark.createDataFrame([("chr1", "+", *r) for r in rows], "chrom string, strand string, a long, b long, n long"))


def test_touching_intervals_overlap(spark):
    got = {(r.a, r.b): r.island for r in islands(spark, [(10, 20, 1), (20, 30, 1), (31, 40, 1), (35, 36, 1)]).collect()}
    assert got[10, 20] == got[20, 30] != got[31, 40] == got[35, 36]


def test_linking_drops_singletons(spark):
    got = clustering.linked_components(islands(spark, [(100, 200, 5), (100, 300, 5), (150, 250, 5), (300, 400, 5)])).collect()
    assert {(r.a, r.b) for r in got} == {(100, 200), (100, 300), (300, 400)}
    assert {r.component for r in got} == {1}


def refined(spark, bridge, ratio):
    rows = [("chr1", "+", "S0", 100, 200, 400), ("chr1", "+", "S0", 100, 300, bridge), ("chr1", "+", "S0", 300, 400, 60)]
    return clustering.cluster_introns(spark.createDataFrame(rows, J), min_ratio=ratio, min_reads=5).count()


def test_refinement_golden_cases(spark):
    assert refined(spark, 4, 0.001) == 0
    assert refined(spark, 6, 0.001) == 3
    assert refined(spark, 6, 0.05) == 0


def test_counts_share_the_cluster_total(spark):
    rows = [("chr1", "+", "S0", 100, 200, 3), ("chr1", "+", "S0", 300, 400, 2), ("chr1", "+", "S1", 100, 300, 40), ("chr1", "+", "S1", 100, 200, 40), ("chr1", "+", "S1", 300, 400, 40)]
    j = spark.createDataFrame(rows, J)
    got = {(r.a, r.b): (r.n, r.tot) for r in counts.perind_counts(clustering.cluster_introns(j, min_reads=5), j).where("sample = 'S0'").collect()}
    assert got == {(100, 200): (3, 5), (100, 300): (0, 5), (300, 400): (2, 5)}


def test_library_checks(spark):
    j = spark.createDataFrame([("chr1", "+", "L1", 1, 2, 1), ("chr2", "+", "L1", 1, 2, 1), ("chr1", "+", "L2", 1, 2, 1)], J)
    assert {r.sample: r.flagged for r in counts.library_qc(j).collect()} == {"L1": False, "L2": True}
    assert [r.chrom for r in counts.common_chroms(j).collect()] == ["chr1"]


def recursive(rows, m, p):
    """Own recursive model of refinement: filter, link, recurse."""

    def linked(xs):
        groups = []
        for x in sorted(xs):
            hit = [g for g in groups if any({x[0], x[1]} & {y[0], y[1]} for y in g)]
            groups = [g for g in groups if g not in hit] + [[*(y for g in hit for y in g), x]]
        return [g for g in groups if len(g) > 1]

    def go(g):
        total = sum(x[2] for x in g)
        kept = [x for x in g if x[2] / total >= p and x[2] >= m]
        return [frozenset(g)] if len(kept) == len(g) else [s for h in linked(kept) for s in go(h)]

    return {s for g in linked(rows) for s in go(g)}


def test_one_pass_equals_recursion(spark):
    rnd, rows = random.Random(3), []
    for c in range(25):
        sites = sorted(rnd.sample(range(100, 900, 20), 7))
        pairs = {tuple(sorted(rnd.sample(sites, 2))) for _ in range(8)}
        rows += [(f"c{c}", "+", "S0", a, b, rnd.choice([1, 2, 5, 9, 40, 300])) for a, b in pairs]
    j = spark.createDataFrame(rows, J)
    islands_ = clustering.large_islands(clustering.overlap_islands(clustering.pool_introns(j, min_reads=0)), 1, 0)
    got = clustering.number_clusters(clustering.refine(clustering.linked_components(islands_), 0.02, 5)).collect()
    mine = {}
    for r in got:
        mine.setdefault(r.clu, set()).add((r.chrom, r.a, r.b))
    want = {frozenset((c, a, b) for a, b, _ in s) for c in {r[0] for r in rows} for s in recursive([r[3:] for r in rows if r[0] == c], 5, 0.02)}
    assert {frozenset(x) for x in mine.values()} == want


def test_large_islands_link_as_small_ones(spark, monkeypatch):
    rnd, rows = random.Random(5), []
    for c in range(6):
        sites = sorted(rnd.sample(range(100, 1500, 10), 14))
        rows += [(f"c{c}", "+", *sorted(rnd.sample(sites, 2)), 5) for _ in range(16)]
    found = clustering.overlap_islands(spark.createDataFrame(sorted(set(rows)), "chrom string, strand string, a long, b long, n long"))
    want = sorted(map(tuple, clustering.linked_components(found).collect()))
    monkeypatch.setattr(clustering, "FOLDED", 3)
    assert sorted(map(tuple, clustering.linked_components(found).collect())) == want and len(want) > 20


def test_nulls_empty_tables_and_further_columns(spark):
    rows = [("chr1", "+", "S0", 100, 200, 40, "x"), ("chr1", "+", "S0", 100, 300, 40, "x"), ("chr1", "+", "S1", 100, 300, 40, "x"), (None, "+", "S0", 100, 200, 9, "x"), ("chr1", None, "S0", 100, 200, 9, "x"), ("chr1", "+", "S0", None, 200, 9, "x"), ("chr1", "+", "S0", 100, 200, None, "x"), ("chr1", "?", "S0", 100, 200, 9, "x")]
    j = spark.createDataFrame(rows, J + ", clu string")
    pooled = {(r.a, r.b): r.n for r in clustering.pool_introns(j).collect()}
    assert pooled == {(100, 200): 40, (100, 300): 80}
    clusters = clustering.cluster_introns(j, min_reads=5)
    assert {(r.clu, r.a, r.b, r.n) for r in clusters.collect()} == {(1, 100, 200, 40), (1, 100, 300, 80)}
    table = counts.perind_counts(clusters, j.drop("clu"))
    assert {(r["sample"], r.b): (r.n, r.tot) for r in table.collect()} == {("S0", 200): (40, 80), ("S0", 300): (40, 80), ("S1", 200): (0, 40), ("S1", 300): (40, 40)}
    empty = clustering.cluster_introns(j.limit(0))
    assert empty.count() == 0 and counts.perind_counts(empty, j.limit(0).drop("clu")).count() == 0


def test_islands_of_one_chromosome_over_many_partitions(spark):
    """Long introns reach over the borders of partitions; numbers go on from one to the next."""
    rng = random.Random(9)
    rows = {("chr1" if rng.random() < 0.9 else "chr2", rng.choice("+-"), a := rng.randrange(200_000), a + rng.choice([5, 60, 400, 30_000 if rng.random() < 0.02 else 90])) for _ in range(3000)}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "23")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = clustering.overlap_islands(spark.createDataFrame([(*r, 1) for r in rows], "chrom string, strand string, a long, b long, n long")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want, reach, number = {}, {}, {}
    for chrom, strand, a, b in sorted(rows):
        key = (chrom, strand)
        number[key] = number.get(key, 0) + (a > reach.get(key, -1))
        reach[key] = max(reach.get(key, -1), b)
        want[chrom, strand, a, b] = number[key]
    assert {(r.chrom, r.strand, r.a, r.b): r.island for r in got} == want and max(want.values()) > 100
