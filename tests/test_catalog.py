"""A few catalogue queries against their SQL twins on the smallest tables; the driver compares all of them."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", ["refined_clusters", "perind_counts", "library_qc", "phen_qqnorm", "bh_fdr", "clusters_to_genes", "junction_verdict", "bed_junctions", "bed12_file", "count_file", "gtf_transcripts", "annotation_introns_file", "sam_tags", "gene_plot_labels", "dm_loglik", "pca_products", "cassette_shapes", "fisher_combined"])
def test_query_equals_sql(spark, duck, name):
    mine = entry.queries()[name](spark, SF).toPandas()
    other = duck.sql(entry.oracle_sql()[name]).df()
    assert sorted(mine.columns) == sorted(other.columns)
    columns = sorted(mine.columns)
    rows = lambda df: sorted(repr(tuple(None if v != v else v for v in r)) for r in df[columns].astype(object).itertuples(index=False, name=None))
    assert rows(mine) == rows(other)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
