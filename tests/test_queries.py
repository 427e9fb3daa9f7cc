"""Every query of the trees that has SQL gives the same rows in DuckDB."""

import math
import os

import duckdb
import pytest

from coppice import queries

SF = "/root/testdata/sf0.001"
#: One of each family; tools/compare.py runs them all.
CHOSEN = ["bin_dataset", "grad_tweedie", "grad_multiclass", "base_score_quantile", "hist_subtract", "split_monotone", "best_split_tiebreak", "leaf_values", "leaf_renew_quantile", "train_boosted_3_rounds", "goss_threshold", "bagging_sample", "predict_proba", "metric_auc", "shap_depth2_exact", "shadow_permutation", "binomial_verdict", "number_rows"]


def canon(row):
    return tuple(float(f"{v:.9g}") if isinstance(v, float) and math.isfinite(v) else v for v in row)


@pytest.mark.parametrize("name", CHOSEN)
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"create view {t.removesuffix('.parquet')} as select * from '{SF}/{t}'")
    found = con.execute(queries.SQL[name])
    columns = [d[0] for d in found.description]
    want = sorted(map(canon, found.fetchall()), key=repr)
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(canon, df.select(*columns).collect()), key=repr) == want
