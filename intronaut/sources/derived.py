"""Junctions, exons, samples and other inputs derived from the star-schema tables.

The tables stand in for sequencing data: line items become junction rows of eight
samples on five chromosomes, parts and suppliers become exons.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

JUNCTIONS = """
select concat('chr', cast(1 + l_suppkey % 5 as varchar(9))) as chrom,
       case when l_linestatus = 'O' then '+' else '-' end as strand,
       concat('S', cast(cast(floor(l_extendedprice) as bigint) % 8 as varchar(9))) as sample,
       cast(base + jit as bigint) as a,
       cast(base + jit + (1 + (l_linenumber * l_linenumber + l_orderkey) % 3) * 1500 - 400 as bigint) as b,
       cast(1 + floor(l_quantity / 5) as bigint) as n
from (select *,
        (l_partkey % 20) * 30000 + (l_orderkey % 5) * 1500
          + (case when l_orderkey % 5 >= 3 then 8000 else 0 end) + 100 as base,
        case when l_orderkey % 31 = 0 then 500 + 3 * (l_partkey % 13)
             when l_orderkey % 7 = 0 then 37 else 0 end as jit
      from {lineitem}) t
"""
EXONS = """
select distinct concat('chr', cast(1 + s_suppkey % 5 as varchar(9))) as chr,
       cast((p_partkey % 20) * 30000 + (p_size % 5) * 1500
            + (case when p_size % 5 >= 3 then 8000 else 0 end) - 300 as bigint) as start_pos,
       cast((p_partkey % 20) * 30000 + (p_size % 5) * 1500
            + (case when p_size % 5 >= 3 then 8000 else 0 end) + 100 as bigint) as end_pos,
       case when (p_partkey % 20) % 2 = 0 then '+' else '-' end as strand,
       concat('G', cast(1 + s_suppkey % 5 as varchar(9)), '_', cast(p_partkey % 20 as varchar(9))) as gene_name
from {sites}
"""
SCATTERED = """
select chrom, strand, sample, a + far as a, b + far as b, n * 10 as n
from (select j.*, cast(a % 97 * 1000000 + n * 100000 as bigint) as far from ({junctions}) j) t
"""
CASSETTES = """
select l_orderkey as clu,
       cast(case when l_linenumber = 3 then 300 + 10 * (l_orderkey % 2) else 100 end as bigint) as a,
       cast(case when l_linenumber = 1 then 200 else 400 + 10 * (l_orderkey % 2) end as bigint) as b,
       case when l_linenumber = 2 then (l_orderkey // 2 % 3 - 1) / -10.0 else (l_orderkey // 2 % 3 - 1) / 10.0 end as deltapsi,
       case when l_orderkey % 5 = 0 then 'annotated' when l_linenumber = 2 and l_orderkey % 5 = 1 then 'annotated' when l_linenumber = 2 then 'novel annotated pair'
            when l_orderkey % 5 = 1 then 'cryptic_fiveprime' else 'annotated' end as verdict
from {lineitem} where l_linenumber <= 3 or l_orderkey % 11 = 0
"""
#: Fixed values of the driver's sample names.
SAMPLES = [f"S{i}" for i in range(8)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def junctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chrom, strand, sample, a, b, n) rows from ``lineitem``."""
    return spark.sql(JUNCTIONS, lineitem=table(spark, sf_dir, "lineitem"))


def scattered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Junctions moved far apart, ten reads for one."""
    return spark.sql(SCATTERED.format(junctions=JUNCTIONS), lineitem=table(spark, sf_dir, "lineitem"))


def cassettes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(clu, a, b, deltapsi, verdict): the first three lines of an order as introns of a cluster, a few orders with all lines."""
    return spark.sql(CASSETTES.replace("//", "div"), lineitem=table(spark, sf_dir, "lineitem"))


def exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chr, start_pos, end_pos, strand, gene_name): both tables enter by their few distinct residues."""
    supplier, part = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "part")
    left = supplier.selectExpr("s_suppkey % 5 as s_suppkey").distinct()
    right = part.selectExpr("p_partkey % 20 as p_partkey", "p_size % 5 as p_size").distinct()
    sites = right.selectExpr("*", "explode(sequence(0L, 4L)) as s_suppkey").join(left, "s_suppkey", "left_semi")
    return spark.sql(EXONS, sites=sites)


GROUPS = """
select concat('S', cast(i as varchar(9))) as sample, case when i < 4 then 'A' else 'B' end as grp,
       cast(i % 3 as double) as age, concat('b', cast(i % 2 as varchar(9))) as batch
from (select distinct s_suppkey % 8 as i from {supplier}) t
"""


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples with their group and a numeric and a categorical covariate, from the suppliers' numbers."""
    return spark.sql(GROUPS, supplier=table(spark, sf_dir, "supplier"))
