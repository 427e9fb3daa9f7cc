import itertools
from math import factorial

import numpy as np
import pytest

from coppice.cli import run
from coppice.estimator import CoppiceClassifier, CoppiceRegressor
from coppice.export import evaluate_xgboost, xgboost_json
from coppice.functions.hashing import wang, wang_int
from coppice.model import Forest
from coppice.operators import splits
from coppice.operators.histogram import histogram
from coppice.operators.shap import contributions, expected
from coppice.params import CoppiceError, DataError, ParameterError, Params
from coppice.queries import tiny_forest
from coppice.sources.synthetic import mixed
from coppice.sources.tables import read_csv, read_libsvm


def test_four_points(spark):
    df = spark.createDataFrame([(0, 0.0, 0.0), (1, 0.0, 0.0), (2, 1.0, 10.0), (3, 1.0, 10.0)], "rid long, f0 double, label double")
    m = CoppiceRegressor(n_estimators=1, max_depth=1, learning_rate=0.1, reg_lambda=0.0).fit(df, rid="rid")
    assert [round(r.prediction, 9) for r in m.transform(df).orderBy("rid").collect()] == [4.5, 4.5, 5.5, 5.5]


def test_missing_values_choose_a_side(spark):
    rows = [(i, [0.0, 1.0, None][i % 3], [10.0, 0.0, 10.0][i % 3]) for i in range(90)]
    df = spark.createDataFrame(rows, "rid long, f0 double, label double")
    m = CoppiceRegressor(n_estimators=1, max_depth=1, learning_rate=1.0, reg_lambda=0.0).fit(df, rid="rid")
    assert all(abs(r.label - r.prediction) < 1e-9 for r in m.transform(df).collect())


def test_mixed_features_shap_export_and_files(spark, tmp_path):
    df = mixed(spark, 1500).persist()
    m = CoppiceRegressor(n_estimators=3, max_depth=3, learning_rate=0.5, max_bin=32, categorical_features=["cat"]).fit(df, rid="rid")
    assert m.score(df) > 0.6
    x = df.select(*m.forest.features).toArrow().to_pandas().to_numpy(float)[:200]
    raw = m.forest.raw(x)
    assert np.allclose(contributions(m.forest, x).sum(1), raw[:, 0])
    assert np.allclose(evaluate_xgboost(xgboost_json(m.forest), x.astype(np.float32)), m.forest.raw(x.astype(np.float32).astype(float)), atol=1e-6)
    m.save_model(str(tmp_path / "m.json"))
    assert np.array_equal(Forest.load(str(tmp_path / "m.json")).raw(x), raw)


def test_shap_by_subsets():
    forest = tiny_forest()
    x = np.array([[100000.0, 3.0, 1.0], [np.nan, 9.0, 2.0], [200000.0, 2.0, 5.0]])

    def value(tree, row, known):
        def at(n):
            f = tree.feature[n]
            if f < 0:
                return tree.leaf[n]
            kids = 2 * n + 1, 2 * n + 2
            if f in known:
                return at(int(tree.step(np.array([n]), row[None], forest.bins)[0]))
            return sum(at(k) * tree.cover[k] for k in kids) / tree.cover[n]

        return at(0)

    got = contributions(forest, x)
    for r, row in enumerate(x):
        for i in range(3):
            others = [j for j in range(3) if j != i]
            total = 0.0
            for size in range(3):
                for s in itertools.combinations(others, size):
                    w = factorial(size) * factorial(2 - size) / 6
                    total += w * sum(value(t, row, {*s, i}) - value(t, row, set(s)) for t in forest.trees)
            assert abs(got[r, i] - total) < 1e-12
        assert got[r, 3] == expected(forest)[0]


def test_local_search_finds_what_windows_find(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(2)), [int(b) for b in rng.integers(0, 16, 4)], float(rng.integers(-9, 9)), 1.0) for i in range(400)]
    df = spark.createDataFrame(rows, "rid long, node int, bins array<int>, g double, h double")
    p, cats, mono = Params(max_bin=16), [2], {0: 1}
    hist = histogram(df).persist()
    want = {r.node: r for r in splits.best(splits.candidates(hist, p, cats, mono)).collect()}
    cells = np.zeros((2, 4, 16, 3))
    for r in hist.collect():
        cells[r.node, r.f, r.bin] = r.g, r.h, r.c
    for n in (0, 1):
        s = splits.search(cells[n], n, p, cats, mono, (-np.inf, np.inf))
        assert (s.f, s.bin, s.missing_left, s.left_bins, s.cl) == (want[n].f, want[n].bin, want[n].missing_left, want[n].left_bins, want[n].cl)
        assert abs(s.gain - want[n].gain) < 1e-9


def test_classes_leaves_and_early_stop(spark):
    rows = [(i, float(i % 10), float(i % 7), "low" if i % 10 < 3 else "mid" if i % 10 < 7 else "top") for i in range(300)]
    df = spark.createDataFrame(rows, "rid long, f0 double, f1 double, label string")
    m = CoppiceClassifier(n_estimators=2, num_leaves=3, max_depth=3, learning_rate=1.0, early_stopping_rounds=1).fit(df, rid="rid", eval_set=df)
    assert m.score(df) == 1.0 and m.classes_ == ["low", "mid", "top"] and m.n_trees_ == 3 * m.best_iteration_


def test_parameters_are_checked():
    assert Params.make(eta=0.3, num_leaves=8).learning_rate == 0.3
    for bad in ({"eta": 0.1, "learning_rate": 0.2}, {"nonsense": 1}, {"max_bin": 3}, {"max_depth": 13}, {"goss": True, "subsample": 0.5}, {"metric": "auc"}, {"objective": "multiclass", "num_class": 2}):
        with pytest.raises(ParameterError):
            Params.make(**bad)


def test_bad_rows_are_named(spark):
    df = spark.createDataFrame([(0, 1.0, 0.0), (1, 1.0, 2.0)], "rid long, f0 double, label double")
    with pytest.raises(DataError, match="first is 1"):
        CoppiceRegressor(objective="binary", n_estimators=1).fit(df, rid="rid")


def test_files_and_command_line(spark, tmp_path):
    text = "f0,f1,target\n" + "\n".join(f"{i % 5},{'' if i % 4 == 0 else i % 3},{(i % 5) * 2}" for i in range(100)) + "\n"
    (tmp_path / "t.csv").write_text(text)
    (tmp_path / "t.svm").write_text("1 qid:3 1:0.5 3:2 # x\n0 2:1.5\n")
    assert read_csv(spark, str(tmp_path / "t.csv")).where("f1 is null").count() == 25
    assert [tuple(r) for r in read_libsvm(spark, str(tmp_path / "t.svm")).orderBy("label").collect()] == [(0.0, 0.0, 1.5, 0.0), (1.0, 0.5, 0.0, 2.0)]
    (tmp_path / "short.csv").write_text("a,b\n1\n")
    with pytest.raises(CoppiceError):
        read_csv(spark, str(tmp_path / "short.csv"))
    model = str(tmp_path / "m.json")
    assert run(["train", "--data", str(tmp_path / "t.csv"), "--label", "target", "--trees", "2", "--depth", "2", "--output", model], spark) == 0
    assert run(["predict", "--model", model, "--data", str(tmp_path / "t.csv"), "--output", str(tmp_path / "p")], spark) == 0
    assert spark.read.option("header", True).csv(str(tmp_path / "p")).columns == ["prediction"]
    assert run(["importance", "--model", model], spark) == 0


def test_hash(spark):
    from pyspark.sql import functions as F

    xs = [0, 1, 61, 2**31, 2**32 - 1]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x long").select(wang(F.col("x"))).collect()]
    assert got == [wang_int(x) for x in xs]


def test_queries_run_what_training_runs(spark, monkeypatch):
    from coppice import queries
    from coppice.operators import sampling
    from coppice.plans import train as plan

    called = []

    def spy(module, name):
        own = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *a, **b: called.append(name) or own(*a, **b))

    spy(sampling, "goss_rows")
    spy(plan, "best_round")
    queries.QUERIES["goss_sample"](spark, "/root/testdata/sf0.001")
    assert tuple(queries.QUERIES["early_stop"](spark, "/root/testdata/sf0.001").first()) == (2, 3.0)
    assert called == ["goss_rows", "best_round"]
    sampling.goss(spark.createDataFrame([(i, float(i), 1.0) for i in range(50)], "rid long, g double, h double"), plan.Params(), 50, 0)
    df = spark.createDataFrame([(i, float(i % 7), float(i % 7 > 3)) for i in range(300)], "rid long, x double, label double")
    _, history = plan.train(df, ["x"], "label", plan.Params(n_estimators=2, max_depth=1, early_stopping_rounds=1), rid="rid", valid=df)
    assert called[2] == "goss_rows" and called[3:] == ["best_round"] * len(history)
    assert plan.best_round([float("nan"), 1.0], True) == (0, 1) and plan.best_round([1.0, 3.0, 3.0, 2.0], True) == (1, 2)
