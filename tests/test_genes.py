from intronaut.operators import annotate, genes

EXONS = "chr string, start_pos long, end_pos long, strand string, gene_name string"


def test_clusters_to_genes_three_prime_first(spark):
    exons = spark.createDataFrame([("chr1", 50, 100, "+", "G1"), ("chr1", 300, 350, "+", "G1"), ("chr1", 300, 360, "+", "G2")], EXONS)
    introns = spark.createDataFrame([(1, "chr1", 100, 300)], "clu long, chrom string, a long, b long")
    assert genes.clusters_to_genes(introns, exons).first().genes == "G1,G2"


def test_transcript_introns(spark):
    def of(strand):
        rows = [(i, "chr1", "x", "exon", s, e, ".", strand, ".", 'gene_id "g"; transcript_id "t"; tag "a"; tag "b";') for i, (s, e) in enumerate([(100, 200), (300, 400), (500, 600)])]
        gtf = spark.createDataFrame(rows, "line int, chr string, source string, feature string, start long, end long, score string, strand string, frame string, attributes string")
        assert gtf.select(genes.attribute_map().alias("m")).first().m["tag"] == ["a", "b"]
        return {(r.a, r.b): r.intron_number for r in genes.transcript_introns(genes.gtf_transcripts(gtf)).collect()}

    assert of("+") == {(200, 300): 1, (400, 500): 2}
    assert of("-") == {(200, 300): 2, (400, 500): 1}


def test_verdicts(spark):
    table = [("+", 0, 0, 1, "annotated"), ("+", 0, 0, 0, "novel annotated pair"), ("+", 0, 1, 0, "cryptic_threeprime"), ("-", 1, 0, 0, "cryptic_threeprime"), ("+", 1, 0, 0, "cryptic_fiveprime"), ("-", 0, 1, 0, "cryptic_fiveprime"), ("+", 1, 1, 0, "cryptic_unanchored"), (None, 0, 0, 1, "unknown_strand")]
    rows = spark.createDataFrame([(s, bool(a), bool(b), bool(c), v) for s, a, b, c, v in table], "gene_strand string, u5 boolean, u3 boolean, known_pair boolean, want string")
    assert all(r.got == r.want for r in rows.withColumn("got", annotate.verdict()).collect())


def test_cassette(spark):
    rows = [(1, 100, 200, 0.1, "annotated"), (1, 100, 400, -0.2, "annotated"), (1, 300, 400, 0.1, "annotated")]
    df = spark.createDataFrame(rows, "clu long, a long, b long, deltapsi double, verdict string")
    assert annotate.cassette(df).first().classification == "cassette exon - increased - annotated"
