"""Alignments in SAM text: records, flags, tags, blocks, junctions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The bits of FLAG by name.
FLAGS = {"paired": 0, "proper": 1, "unmapped": 2, "mate_unmapped": 3, "reverse": 4, "mate_reverse": 5, "first_read": 6}
FIELDS = ("qname", "flag", "rname", "pos", "mapq", "cigar", "mrnm", "mpos", "isize", "seq", "qual", "tags")


def parse_sam(lines: DataFrame, column: str = "value") -> DataFrame:
    """Records of SAM lines; header and blank lines are skipped."""
    text = F.trim(column)
    # a split by one character needs no pattern; other white space, and tabs in a row, are left to the pattern
    plain = ~F.contains(F.col("t"), F.lit("\t\t"))
    for c in " \n\r\f\v":
        plain = plain & ~F.contains(F.col("t"), F.lit(c))
    whole = lines.where((text != "") & ~F.col(column).startswith("@")).select(text.alias("t"))
    # a line is split once: Spark copies an expression into each filter on its fields, but none into a generator
    rows = whole.select(F.explode(F.array(F.when(plain, F.split("t", "\t", 12)).otherwise(F.split("t", r"\s+", 12)))).alias("p"))
    number = {"flag": "int", "pos": "long", "mapq": "int", "mpos": "long", "isize": "long"}
    return rows.select(*[F.get("p", F.lit(i)).cast(number.get(f, "string")).alias(f) for i, f in enumerate(FIELDS)])


def flag(name: str, column: str = "flag") -> Column:
    return F.getbit(F.col(column), F.lit(FLAGS[name])) == 1


def tags(rows: DataFrame) -> DataFrame:
    """Strand of the transcript (``+`` for ``.``), edit distance and uniqueness from the optional tags."""
    xs = F.regexp_extract(F.coalesce("tags", F.lit("")), r"XS:\S*?:([+\-.])", 1)
    nm = F.regexp_extract(F.coalesce("tags", F.lit("")), r"NM:\S*?:(\d+)", 1)
    own = F.when(flag("reverse"), "-").otherwise("+")
    return rows.withColumn("read_strand", own).withColumn("rna_strand", F.when(xs == ".", "+").when(xs != "", xs).otherwise(own)).withColumn("score", F.coalesce(F.nullif(nm, F.lit("")).cast("int"), F.lit(0))).withColumn("unique", F.coalesce(F.col("tags").contains("XT:A:U"), F.lit(False)))


def cigar_blocks(rows: DataFrame) -> DataFrame:
    """Blocks of each alignment: ``chrom_start``, ``block_sizes``, ``block_starts`` and ``problem`` for what can't be read.

    A soft clip at one end is cut off. A leading deletion moves the start, a deletion after a
    block lengthens it, and after an insertion or deletion the next match goes to the block before; a
    gap moves on without ending that. Other operations are a problem and give no blocks.
    """
    body = F.when(F.col("cigar").rlike(r"^\d+S"), F.regexp_replace("cigar", r"^\d+S", "")).otherwise(F.regexp_replace("cigar", r"\d+S$", ""))
    # sizes and letters are cut out once, the fold sees numbers
    sizes, letters = F.split("body", "[MIDN]"), F.split(F.regexp_replace("body", r"\d+", ""), "")
    ops = F.zip_with(F.filter(sizes, lambda x: x != ""), F.filter(letters, lambda x: x != ""), lambda n, c: F.struct(n.cast("long").alias("size"), c.alias("letter")))
    kind = "struct<shift:bigint,at:bigint,extend:boolean,sizes:array<bigint>,starts:array<bigint>>"
    start = F.from_json(F.lit('{"shift":0,"at":0,"extend":false,"sizes":[],"starts":[]}'), kind)

    def step(s: Column, op: Column) -> Column:
        size, letter = op["size"], op["letter"]
        n = F.size(s["sizes"])
        longer = F.concat(F.slice(s["sizes"], F.lit(1), n - 1), F.array(F.element_at(s["sizes"], F.lit(-1)) + size))
        into = s["extend"] & (n > 0)
        lead = (letter == "D") & (n == 0)
        return F.struct(
            F.when(lead, s["shift"] + size).otherwise(s["shift"]).alias("shift"),
            F.when(lead | (letter == "I"), s["at"]).otherwise(s["at"] + size).alias("at"),
            F.when(letter == "N", s["extend"]).when(letter.isin("I", "D") & ~lead, F.lit(True)).otherwise(F.lit(False)).alias("extend"),
            F.when((letter == "M") & ~into, F.concat(s["sizes"], F.array(size))).when(((letter == "M") & into) | ((letter == "D") & (n > 0)), longer).otherwise(s["sizes"]).alias("sizes"),
            F.when((letter == "M") & ~into, F.concat(s["starts"], F.array(s["at"]))).otherwise(s["starts"]).alias("starts"),
        )

    folded = rows.withColumn("body", body).withColumn("problem", ~F.col("body").rlike(r"^(\d+[MIDN])+$")).withColumn("f", F.when(~F.col("problem"), F.aggregate(ops, start, step)))
    good = lambda c: F.when(~F.col("problem"), c)
    return folded.withColumn("chrom_start", good(F.col("pos") - 1 + F.col("f.shift"))).withColumn("block_sizes", good(F.col("f.sizes"))).withColumn("block_starts", good(F.col("f.starts"))).drop("body", "f")


def block_junctions(rows: DataFrame) -> DataFrame:
    """A row (rname, start, end, strand) for each pair of neighbouring blocks."""
    pairs = F.when(F.size("block_sizes") > 1, F.transform(F.sequence(F.lit(0), F.size("block_sizes") - 2), lambda i: F.struct((F.col("chrom_start") + F.get("block_starts", i) + F.get("block_sizes", i)).alias("start"), (F.col("chrom_start") + F.get("block_starts", i + 1)).alias("end"))))
    return rows.select("rname", "read_strand", F.explode(pairs).alias("j")).select(F.col("rname").alias("chrom"), "j.start", "j.end", F.col("read_strand").alias("strand"))


def count_junctions(junctions: DataFrame) -> DataFrame:
    return junctions.groupBy("chrom", "start", "end", "strand").agg(F.count("*").alias("n"))


def spliced(rows: DataFrame, min_mapq: int = 10, min_gap: int = 50, min_edge: int = 6) -> DataFrame:
    """Alignments over a gap: the first one longer than ``min_gap``, the outer matches of ``min_edge`` at least.

    The pieces are those of the text: the gap before the first ``N`` back to the ``M`` before it, the text before the
    first ``M``, and the text between the last two ``M`` after its last ``N``. What is no number drops the row.
    """
    pieces = F.split("cigar", "M")
    gap = F.expr("try_cast(element_at(split(split_part(cigar, 'N', 1), 'M'), -1) as int)")
    first = F.expr("try_cast(split_part(cigar, 'M', 1) as int)")
    last = F.expr("try_cast(element_at(split(try_element_at(split(cigar, 'M'), -2), 'N'), -1) as int)")
    return rows.where(F.col("cigar").contains("N") & (F.col("mapq") >= min_mapq)).where((F.size(pieces) > 1) & (gap > min_gap) & (F.least(first, last) >= min_edge) & first.isNotNull() & last.isNotNull())


def select_reads(rows: DataFrame, unique: bool = False) -> DataFrame:
    """Mapped reads, unique ones only if asked for."""
    mapped = rows.where(~flag("unmapped"))
    return mapped.where("unique") if unique else mapped


def mates(rows: DataFrame) -> DataFrame:
    """Reads of pairs with ``mate``, 1 for first and 2 for second ones; a single-end read has no mate and is an error here."""
    paired = rows.where(F.when(flag("paired"), F.lit(True)).otherwise(F.raise_error(F.lit("reads of pairs are split, but a read is single")).cast("boolean")))
    return paired.withColumn("mate", F.when(flag("first_read"), 1).otherwise(2))


def split_mates(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """First and second reads of pairs apart."""
    paired = mates(rows)
    return paired.where("mate = 1").drop("mate"), paired.where("mate = 2").drop("mate")


def bed_lines(rows: DataFrame) -> DataFrame:
    """BED12 lines, half-open."""
    end = F.col("chrom_start") + F.element_at("block_starts", -1) + F.element_at("block_sizes", -1)
    numbers = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    text = lambda c: c.cast("string")
    start = F.col("chrom_start")
    return rows.where("not problem").select(F.concat_ws("\t", "rname", text(start), text(end), "qname", text(F.col("score")), "read_strand", text(start), text(end), F.lit("0"), text(F.size("block_sizes")), numbers("block_sizes"), numbers("block_starts")).alias("value"))
