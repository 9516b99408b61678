from intronaut.sources import alignments


def blocks(spark, cigar, pos=101, mapq=60, flag=0, tags="NM:i:2 XS:A:."):
    line = "\t".join(["r", str(flag), "chr1", str(pos), str(mapq), cigar, "*", "0", "0", "A", "I", tags])
    return alignments.cigar_blocks(alignments.tags(alignments.parse_sam(spark.createDataFrame([("@HD",), ("",), (line,)], "value string"))))


def test_blocks_and_junctions(spark):
    for cigar, sizes, starts, junction in [("10M100N20M", [10, 20], [0, 110], (110, 210)), ("5S10M2I8M100N20M", [18, 20], [0, 118], (118, 218)), ("10M3D8M100N20M", [21, 20], [0, 121], (121, 221))]:
        rows = blocks(spark, cigar)
        r = rows.first()
        assert (r.block_sizes, r.block_starts, r.problem, r.score, r.rna_strand) == (sizes, starts, False, 2, "+")
        j = alignments.block_junctions(rows).first()
        assert (j.start, j.end) == junction


def test_insertion_before_a_gap_swallows_the_junction(spark):
    assert blocks(spark, "10M2I100N20M").first().block_sizes == [30]


def test_other_operations_are_a_problem(spark):
    r = blocks(spark, "5H10M").first()
    assert r.problem and r.block_sizes is None


def test_spliced_filter(spark):
    keep = lambda cigar, mapq=10: alignments.spliced(blocks(spark, cigar, mapq=mapq)).count() == 1
    assert keep("10M100N20M") and keep("10M100N20M5S")
    assert not any([keep("5M100N20M"), keep("10M50N20M"), keep("5S10M100N20M"), keep("10M100N20M", 9)])


def test_flags(spark):
    r = blocks(spark, "10M", flag=83).select(*[alignments.flag(f).alias(f) for f in alignments.FLAGS]).first()
    assert (r.paired, r.proper, r.unmapped, r.mate_unmapped, r.reverse, r.mate_reverse, r.first_read) == (True, True, False, False, True, False, True)


def test_records_split_at_any_white_space(spark):
    """Single tabs are split without a pattern, other white space and runs of it by one."""
    lines = [("q 0\tchr1\t\t5 9\t10M\t*\t0\t0\tA\tI\tNM:i:1\tXT:A:U",), ("q\t0\tchr1\t5\t9\t10M\t*\t0\t0\tA\tI\tNM:i:1\tXT:A:U",)]
    first, second = alignments.parse_sam(spark.createDataFrame(lines, "value string")).collect()
    assert first == second and first.tags == "NM:i:1\tXT:A:U"


def test_lines_are_split_once_whatever_reads_their_fields(spark):
    """Filters on fields must not each carry a copy of the text and its split."""
    rows = alignments.tags(alignments.parse_sam(spark.range(4).selectExpr("concat_ws('\t', id, 64 * id + 1, 'chr1', 5, 9, '10M', '*', 0, 0, 'A', 'I', 'XT:A:U') as value")))
    found = alignments.mates(alignments.select_reads(rows, unique=True)).select("qname", "mate")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 2 and plan.count("concat_ws(") <= 3
    assert {(r.qname, r.mate) for r in found.collect()} == {("0", 2), ("1", 1), ("2", 2), ("3", 1)}
    first, second = alignments.split_mates(alignments.select_reads(rows, unique=True))
    assert {r.qname for r in first.collect()} == {"1", "3"} and {r.qname for r in second.collect()} == {"0", "2"}
