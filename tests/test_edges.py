"""Edges come from every row, also where there are more than 400,000, and so do the
results that hang on them."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from coppice import queries
from coppice.operators.binning import bin_edges
from coppice.params import Params
from coppice.plans import train as plan

#: Their edges of the price differ if they are taken from every second row.
CHOSEN = ["split_missing_dir", "bin_edges_nearest_rank", "bin_assign_missing", "bin_dataset", "bundle_round_trip", "split_masked", "split_monotone", "train_multiclass_round", "warm_start", "hist_level2", "hist_root", "hist_subtract"]


@pytest.fixture(scope="module")
def grown(tmp_path_factory):
    """sf0.1's orders three times, with shifted keys: 450,000 rows."""
    path = str(tmp_path_factory.mktemp("grown"))
    duckdb.execute(f"copy (select * replace (o_orderkey + r * 150000 as o_orderkey, o_custkey + r * 15000 as o_custkey) from '/root/testdata/sf0.1/orders.parquet', (select range as r from range(0, 3))) to '{path}/orders.parquet' (format parquet)")
    return path


def test_edges_of_every_row(spark):
    df = spark.range(400_000).select(F.col("id").alias("rid"), (F.col("id") % 2).cast("double").alias("x"), F.lit(1.0).alias("label"))
    data = plan.bin_dataset(df, ["x"], "label", Params(max_bin=5), rid="rid")
    assert data.edges == [[0.0, 1.0, 1.0]]


def test_missing_values_in_step_with_rows(spark):
    """Every fifth value is missing, as the price is in every fifth order: a sample of
    every fifth row had no value at all."""
    k = F.col("id")
    df = spark.range(1_000_000).select(k.alias("rid"), F.when(k % 5 != 0, (k % 2).cast("double")).alias("x"), (k % 2).cast("double").alias("label"))
    forest, _ = plan.train(df, ["x"], "label", Params(max_bin=5, n_estimators=1, max_depth=1), rid="rid")
    assert forest.trees[0].feature[0] == 0 and forest.trees[0].threshold[0] == 0.0


def test_ranks_over_several_ranges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(float(i * 37 % 101), [nan, None, -inf, inf, float(i)][i % 5], float(i % 2), None) for i in range(1000)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = bin_edges(df, list("abcd"), Params(max_bin=32, categorical_features=("c",))).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = []
    for f in (0, 1):
        v = sorted(r[f] for r in rows if r[f] is not None and r[f] == r[f])
        want += [(f, k, v[min(len(v) - 1, (k + 1) * len(v) // 31)]) for k in range(30)]
    assert sorted(map(tuple, found)) == want


@pytest.mark.parametrize("name", CHOSEN)
def test_same_as_sql_of_many_rows(spark, grown, tmp_path, name):
    con = duckdb.connect()
    con.execute(f"create view orders as select * from '{grown}/orders.parquet'")
    con.execute(f"create table want as {queries.SQL[name]}")
    columns = ", ".join(d[0] for d in con.execute("from want limit 0").description)
    queries.QUERIES[name](spark, grown).write.parquet(str(tmp_path / "own"))
    con.execute(f"create table own as select {columns} from '{os.path.join(tmp_path, 'own')}/*.parquet'")
    assert con.execute("from own except all from want limit 3").fetchall() == con.execute("from want except all from own limit 3").fetchall() == []
