"""Queries over p-values use every row of lineitem: against SQL of this file, which the twins' subset can't check."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from intronaut.catalog_sql import PVALUES
from intronaut.functions import stats

SF = "/root/testdata/sf0.01"
WHOLE = {
    "fisher_combined": """halves as (select l_suppkey, -sum(ln(p)) as h, count(p) as m from pv group by l_suppkey)
      select l_suppkey, sum(exp(-h + k * ln(h) - lgamma(k + 1))) as p from (select *, unnest(range(m)) as k from halves where m > 0) group by l_suppkey""",
    "outlier_cluster_p": "known as (select * from pv where p is not null) select l_suppkey, 1 - pow(1 - min(p), count(*)) as p from known group by l_suppkey",
}


@pytest.mark.parametrize("name", sorted(WHOLE))
def test_every_p_value_counts(spark, name):
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{SF}/lineitem.parquet'")
    want = {r[0]: r[1] for r in con.sql(f"with {PVALUES}, {WHOLE[name]}").fetchall()}
    got = {r[0]: r[1] for r in entry.queries()[name](spark, SF).collect()}
    assert got.keys() == want.keys() and len(got) == con.sql("select count(distinct l_suppkey) from lineitem").fetchall()[0][0]
    assert all(abs(got[k] - want[k]) <= 1.1e-6 for k in got)


def test_fisher_of_many_p_values(spark):
    rows = [("many", 0.4)] * 2000 + [("ones", 1.0)] * 3 + [("zero", 0.0), ("zero", 0.5), ("two", 0.1), ("two", 0.2), ("none", None)]
    got = dict(map(tuple, stats.fisher_combined(spark.createDataFrame(rows, "g string, p double"), "p", "out", "g").collect()))
    h = -2000 * math.log(0.4)
    want = sum(math.exp(-h + k * math.log(h) - math.lgamma(k + 1)) for k in range(2000))
    assert 0.1 < want < 1 and abs(got["many"] - want) < 1e-8
    assert (got["ones"], got["zero"], got["none"]) == (1.0, 0.0, None) and abs(got["two"] - 0.02 * (1 - math.log(0.02))) < 1e-12
