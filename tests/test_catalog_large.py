"""Queries against their SQL twins on tables whose sums are as large as those of large inputs."""

from fractions import Fraction

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from intronaut import catalog_files
from intronaut.functions import rounds
from intronaut.operators import phenotype

SF = "/root/testdata/sf0.001"


def _rows(table):
    columns = sorted(table.columns)
    return sorted(repr(tuple(None if v != v else v for v in r)) for r in table[columns].astype(object).itertuples(index=False, name=None))


@pytest.fixture
def both(spark, tmp_path):
    def run(name, lineitem):
        con = duckdb.connect()
        for table, sql in {"lineitem": lineitem, "supplier": f"select * from '{SF}/supplier.parquet'"}.items():
            con.sql(f"copy ({sql}) to '{tmp_path}/{table}.parquet' (format parquet)")
            con.sql(f"create view {table} as select * from '{tmp_path}/{table}.parquet'")
        return _rows(entry.queries()[name](spark, str(tmp_path)).toPandas()), _rows(con.sql(entry.oracle_sql()[name]).df())

    return run


def test_effects_of_equal_groups_are_no_negative_zeros(both):
    """Each sample of one group has the reads of a sample of the other."""
    half = f"select * replace (floor(l_extendedprice / 8) * 8 + floor(l_extendedprice) % 4 as l_extendedprice) from '{SF}/lineitem.parquet'"
    got, want = both("bb_fit", f"select * from ({half}) union all select * replace (l_extendedprice + 4 as l_extendedprice) from ({half})")
    assert got == want and not any("-0.0" in row for row in want) and len(got) > 20


def test_top_clusters_are_those_of_the_values_before_rounding(both):
    """Values below 1e-8 are equal to nine digits."""
    got, want = both("top_clusters", f"select * replace (l_quantity * 4e6 as l_quantity) from '{SF}/lineitem.parquet'")
    assert got == want and len(got) == 30


def test_small_ratios_are_written_as_plain_numbers(both):
    """A sample without reads of an intron has a ratio below 0.001 where it has 500 reads of the cluster."""
    got, want = both("phenotype_summary_files", f"select * replace (l_quantity * 400 as l_quantity) from '{SF}/lineitem.parquet'")
    assert got == want and any(" 0.000" in row for row in got) and any("e-0" in row for row in got)


def test_fits_of_many_reads_are_not_stopped_by_rounding():
    """Sums of terms of 1e9 are rounded by more than what a fit may lose in a step."""
    random, many, samples = np.random.default_rng(1), 300, 16
    x, real = np.ones((many, samples, 2)), np.ones((many, samples))
    x[:, :, 1] = np.arange(samples) % 2
    total = random.integers(20_000_000, 40_000_000, (many, samples))
    first = random.binomial(total, random.beta(600, 1200, (many, samples)))
    y = np.stack([first, total - first], axis=2).astype(float)
    start = np.zeros((many, 5))
    start[:, :2] = np.log((y + 1) / (y.sum(axis=2, keepdims=True) + 2)).mean(axis=1)
    start[:, 4] = np.log(10)
    done = rounds._ends(rounds.Model(2, multi=False), 60, start, np.full(many, 0.01), x, y, real)[4]
    assert done.all()


def test_means_do_not_depend_on_the_order_of_the_rows(spark):
    """Eight ratios of nine digits whose mean is at a tie of the sixth one: added as doubles, a third of them miss it."""
    random, rows, exact = np.random.default_rng(4), [], {}
    for clu in range(300):
        ratios = random.integers(1, 10**8, 8)
        ratios[0] += (4000 - ratios.sum()) % 8000
        rows += [(clu, "chr1", "+", 100, 200, f"S{i}", int(r) / 1e9) for i, r in enumerate(ratios)]
        exact[clu] = float(Fraction(int(ratios.sum()), 8 * 10**9))
    rows += [(300, "chr1", "+", 100, 200, "S0", None), (301, "chr1", "+", 100, 200, "S0", None), (301, "chr1", "+", 100, 200, "S1", 0.25)]
    table = spark.createDataFrame(rows, "clu long, chrom string, strand string, a long, b long, sample string, ratio double")
    for parts in (1, 7):
        assert {r.clu: r.mean_ratio for r in phenotype.summary(table.repartition(parts)).collect()} == exact | {300: None, 301: 0.25}


def test_ties_are_rounded_like_the_sql_rounds_them(spark):
    ties = spark.createDataFrame([(float(f"0.{i:06d}5"),) for i in range(1, 400_000, 137)] + [(None,)], "x double")
    got = [r.x for r in catalog_files._scaled(ties.coalesce(1), 6, "x").collect()]
    given = ties.coalesce(1).toPandas()  # noqa: F841
    assert got[:-1] == [r[0] for r in duckdb.sql("select round(x, 6) from given where x is not null").fetchall()] and got[-1] is None
