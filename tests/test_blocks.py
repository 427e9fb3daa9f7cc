"""Training on packed blocks: gradients, draws, histograms, both ways of finding splits,
and fits whose result is known."""

import random
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from coppice.cli import run
from coppice.functions.hashing import keep, keep_array, permuted
from coppice.functions.objectives import class_gradient, gradient, gradient_arrays
from coppice.model import Forest
from coppice.operators import blocks
from coppice.operators.histogram import histogram
from coppice.operators.predict import predict
from coppice.params import Params
from coppice.plans import train as plan
from coppice.streaming.scoring import score_stream

warnings.simplefilter("ignore")


@pytest.fixture(scope="module")
def friedman(spark):
    rng = np.random.default_rng(4)
    x = rng.random((4000, 5))
    y = 10 * np.sin(np.pi * x[:, 0] * x[:, 1]) + 20 * (x[:, 2] - 0.5) ** 2 + 10 * x[:, 3] + 5 * x[:, 4]
    rows = [(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "rid long, f0 double, f1 double, f2 double, f3 double, f4 double, label double").persist()


NAMES = [f"f{i}" for i in range(5)]


def rmse(df, label="label"):
    return df.agg(F.sqrt(F.avg((F.col("prediction") - F.col(label)) ** 2))).first()[0]


def test_arrays_follow_the_columns(spark):
    df = spark.createDataFrame([((i % 9 - 4) / 2.0, float(i % 2), 1.0 + i % 3) for i in range(60)], "s double, y double, w double")
    s, y, w = (np.array(x) for x in zip(*df.collect()))
    for o in ("regression", "binary", "mae", "huber", "quantile", "poisson", "tweedie"):
        p = Params(objective=o, scale_pos_weight=2.0)
        g, h = gradient(p, F.col("s"), F.col("y"), F.col("w"))
        assert np.allclose(np.array(df.select(g.cast("double"), h.cast("double")).collect()).T, gradient_arrays(p, s[None], y, w)), o
    p = Params(objective="multiclass", num_class=3)
    raw = np.array([s, s / 2, -s])
    for k in range(3):
        g, h = class_gradient(F.array(F.col("s"), F.col("s") / 2, -F.col("s")), F.col("y"), k, F.col("w"))
        assert np.allclose(np.array(df.select(g, h).collect()).T, gradient_arrays(p, raw, y, w, k))
    ids = spark.range(2000)
    assert [r.id for r in ids.where(keep(F.col("id"), 7, 0.3)).orderBy("id").collect()] == np.flatnonzero(keep_array(np.arange(2000), 7, 0.3)).tolist()
    for n in (1, 2, 7, 1000):
        for seed in (1, 99):
            found = [r.p for r in spark.range(n).select(permuted(F.col("id"), n, seed).alias("p")).collect()]
            assert sorted(found) == list(range(n)) and (n < 1000 or abs(np.corrcoef(found, range(n))[0, 1]) < 0.15)


def test_histograms_directly_and_by_shuffle(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, [rng.randrange(8), rng.randrange(8)], float(rng.randrange(-9, 9)), 1.0) for i in range(500)]
    df = spark.createDataFrame(rows, "rid long, bins array<smallint>, g double, h double")
    tree = plan.Tree.empty(1)
    tree.feature[0], tree.bin[0] = 1, 3
    monkeypatch.setattr(blocks, "ROWS", 64)
    packed = blocks.pack(df, 7)
    want = {(1 if b[1] <= 3 else 2, f, b[f]): None for _, b, _, _ in rows for f in (0, 1)}
    for direct in (1 << 30, 0):
        monkeypatch.setattr(blocks, "DIRECT", direct)
        cells = blocks.histograms(packed, tree, [1, 2], [0, 1], 2, 7, tasks=8)
        for n, f, b in want:
            own = [(g, h) for _, bins, g, h in rows if (1 if bins[1] <= 3 else 2) == n and bins[f] == b]
            assert cells[n][f, b].tolist() == [sum(g for g, _ in own), float(len(own)), float(len(own))]
    side = df.withColumn("node", F.when(F.col("bins")[1] <= 3, 1).otherwise(2))
    for r in histogram(side).collect():
        assert cells[r.node][r.f, r.bin].tolist() == [r.g, r.h, r.c]


def test_both_searches_grow_the_same_tree(spark, friedman, monkeypatch):
    p = Params(n_estimators=2, max_depth=3, max_bin=32)
    one, _ = plan.train(friedman, NAMES, "label", p, rid="rid")
    monkeypatch.setattr(plan, "LOCAL_CELLS", 0)
    two, _ = plan.train(friedman, NAMES, "label", p, rid="rid")
    for a, b in zip(one.trees, two.trees):
        assert a.feature.tolist() == b.feature.tolist() and np.allclose(a.leaf, b.leaf) and np.allclose(a.cover, b.cover)


def test_fits_of_several_kinds(spark, friedman, monkeypatch):
    p = Params(n_estimators=12, max_depth=4, max_bin=32, learning_rate=0.3)
    plain, _ = plan.train(friedman, NAMES, "label", p, rid="rid")
    monkeypatch.setattr(plan, "REFRESH", 3)
    again, _ = plan.train(friedman, NAMES, "label", p, rid="rid")
    assert [t.feature.tolist() for t in plain.trees] == [t.feature.tolist() for t in again.trees]
    base = rmse(predict(plain, friedman))
    assert base < 1.5
    assert rmse(predict(plan.train(friedman, NAMES, "label", p.but(goss=True), rid="rid")[0], friedman)) < base + 0.5
    assert rmse(predict(plan.train(friedman, NAMES, "label", p.but(subsample=0.5, colsample_bytree=0.8), rid="rid")[0], friedman)) < base + 0.7
    assert rmse(predict(plan.train(friedman, NAMES, "label", p.but(objective="mae"), rid="rid")[0], friedman)) < base + 1.5
    rising, _ = plan.train(friedman, NAMES, "label", p.but(monotone_constraints=(0, 0, 0, 1, 0)), rid="rid")
    x = np.full((50, 5), 0.4)
    x[:, 3] = np.linspace(0, 1, 50)
    assert (np.diff(rising.raw(x)[:, 0]) >= -1e-9).all()


def test_going_on_from_a_model_with_binned_rows(spark, friedman, tmp_path):
    csv = str(tmp_path / "t.csv")
    rows = friedman.drop("rid").collect()
    with open(csv, "w") as f:
        f.write("\n".join([",".join([*NAMES, "label"]), *[",".join(map(repr, r)) for r in rows]]))
    common = ["--label", "label", "--depth", "3", "--bins", "32"]
    assert run(["dataset", "--data", csv, "--output", str(tmp_path / "b"), *common], spark) == 0
    assert run(["train", "--data", str(tmp_path / "b"), "--output", str(tmp_path / "m1"), "--trees", "3", *common], spark) == 0
    assert run(["train", "--data", str(tmp_path / "b"), "--output", str(tmp_path / "m2"), "--trees", "3", "--init-model", str(tmp_path / "m1"), *common], spark) == 0
    one, two = Forest.load(str(tmp_path / "m1")), Forest.load(str(tmp_path / "m2"))
    assert len(two.trees) == 6 and [t.feature.tolist() for t in two.trees[:3]] == [t.feature.tolist() for t in one.trees]
    assert rmse(predict(two, friedman)) < rmse(predict(one, friedman))


def test_scores_of_a_stream(spark, friedman, tmp_path):
    forest, _ = plan.train(friedman, NAMES, "label", Params(n_estimators=2, max_depth=2, max_bin=16), rid="rid")
    friedman.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(friedman.schema).parquet(str(tmp_path / "in"))
    query = score_stream(forest, stream).writeStream.format("memory").queryName("scored").trigger(availableNow=True).start()
    query.awaitTermination(120)
    want = {r.rid: r.prediction for r in predict(forest, friedman).collect()}
    assert {r.rid: r.prediction for r in spark.table("scored").collect()} == want
