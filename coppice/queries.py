"""Queries over the test tables, one for each operator, with their SQL for DuckDB.

Training rows come from ``orders``: rid is the order key; x0 the price, missing in
every fifth row; x1 the month; x2 a category; labels are whole numbers, so sums of
the squared loss are exact in any order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions import metrics, objectives
from .functions.hashing import permuted
from .model import Forest, Tree
from .operators import binning, blocks, guards, histogram, predict, sampling, selection, splits
from .operators.shap import contribution_column
from .params import Params
from .plans import train as plan
from .sources import bundles, tables
from .store import store

FEATURES = ["x0", "x1", "x2"]
PARAMS = Params(n_estimators=3, max_depth=2, learning_rate=0.5, max_bin=16, categorical_features=("x2",))


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k, price, month = F.col("o_orderkey"), F.col("o_totalprice"), F.month("o_orderdate").cast("double")
    return o.select(
        k.alias("rid"), F.when(k % 5 != 0, price).alias("x0"), month.alias("x1"), (F.col("o_custkey") % 7).cast("double").alias("x2"),
        (F.floor(price / 1000) % 50 + F.month("o_orderdate") + (F.col("o_custkey") % 7) * 3).cast("double").alias("label"),
        F.lit(1.0).alias("weight"), ((k % 11 - 5) / 4.0).cast("double").alias("score"),
        F.when((F.floor(price / 1000) + k) % 3 == 0, 1.0).otherwise(0.0).alias("yb"), (k % 3).cast("double").alias("yc"),
    )


ROWS = """rows as (
  select o_orderkey as rid, case when o_orderkey % 5 <> 0 then o_totalprice end as x0,
         cast(month(o_orderdate) as double) as x1, cast(o_custkey % 7 as double) as x2,
         cast(cast(floor(o_totalprice / 1000) as bigint) % 50 + month(o_orderdate) + (o_custkey % 7) * 3 as double) as label,
         cast(o_orderkey % 11 - 5 as double) / 4.0::double as score,
         cast((cast(floor(o_totalprice / 1000) as bigint) + o_orderkey) % 3 = 0 as integer)::double as yb,
         cast(o_orderkey % 3 as double) as yc
  from orders)"""
EDGES = """sampled as (
  select 0 as f, x0 as v from rows where x0 is not null union all select 1, x1 from rows where x1 is not null
), ranked as (
  select f, v, row_number() over (partition by f order by v) - 1 as i, count(*) over (partition by f) as m from sampled
), edges as (
  select f, k, v as edge from ranked, (select range as k from range(0, 14)) where i = least(m - 1, ((k + 1) * m) // 15)
)"""
BINNED = """binned as (
  select rid, label, f, case when v is null then 15 when f = 2 then cast(v as integer)
         else (select cast(count(*) as integer) from edges e where e.f = l.f and e.edge < l.v) end as bin
  from (select rid, label, 0 as f, x0 as v from rows union all select rid, label, 1, x1 from rows union all select rid, label, 2, x2 from rows) l
)"""
DATA = f"{ROWS}, {EDGES}, {BINNED}"


def edges_of(spark: SparkSession, sf_dir: str, params: Params = PARAMS) -> tuple[DataFrame, list[list[float]], int]:
    df = rows(spark, sf_dir)
    return df, binning.collect_edges(binning.bin_edges(df, FEATURES, params), len(FEATURES)), df.count()


def binned(spark: SparkSession, sf_dir: str) -> plan.Binned:
    df, edges, n = edges_of(spark, sf_dir)
    return plan.Binned(binning.assign_bins(df, FEATURES, edges, PARAMS, ["rid", "label", "weight"]), edges, FEATURES, PARAMS, n)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


@query(f"with {ROWS}, {EDGES} select cast(f as integer) as f, cast(k as integer) as k, edge from edges")
def bin_edges_nearest_rank(spark, sf_dir):
    return binning.bin_edges(rows(spark, sf_dir), FEATURES, PARAMS)


def _assigned(spark, sf_dir, f: int) -> DataFrame:
    df, edges, _ = edges_of(spark, sf_dir)
    return df.select("rid", binning.bin_column(F.col(FEATURES[f]), edges[f], f == 2, PARAMS.bins).alias("bin"))


for _f, _name in ((1, "bin_assign_numeric"), (0, "bin_assign_missing"), (2, "bin_assign_categorical")):
    query(f"with {DATA} select rid, bin from binned where f = {_f}", _name)(lambda spark, sf_dir, f=_f: _assigned(spark, sf_dir, f))


@query(f"with {DATA} select rid, f, bin from binned")
def bin_dataset(spark, sf_dir):
    data = binned(spark, sf_dir).rows
    return data.select("rid", F.posexplode("bins").alias("f", "bin")).select("rid", "f", F.col("bin").cast("int").alias("bin"))


# Gradients, hessians and losses, rounded: exp and log may differ in the last digit.
_S, _Y = "score", "label"
_P = "(1 / (1 + exp(-score)))"
GRADIENTS = {
    "regression": ("label", "score - label", "1.0"),
    "binary": ("yb", f"({_P} - yb) * (case when yb > 0.5 then 2.0 else 1.0 end)", f"greatest({_P} * (1 - {_P}), 1e-6) * (case when yb > 0.5 then 2.0 else 1.0 end)"),
    "mae": ("label", "case when score > label then 1.0 else -1.0 end", "1.0"),
    "huber": ("label", "greatest(-0.9, least(0.9, score - label))", "1.0"),
    "quantile": ("label", "case when score > label then 1 - 0.9 else -0.9 end", "1.0"),
    "poisson": ("label", "exp(score) - label", "greatest(exp(score), 1e-6)"),
    "tweedie": ("label", "exp(0.5 * score) - label * exp(-0.5 * score)", "greatest(0.5 * exp(0.5 * score) + 0.5 * label * exp(-0.5 * score), 1e-6)"),
}


def _gradient(spark, sf_dir, objective, label):
    g, h = objectives.gradient(Params(objective=objective, scale_pos_weight=2.0), F.col("score"), F.col(label))
    return rows(spark, sf_dir).select("rid", F.round(g, 6).alias("g"), F.round(h, 6).alias("h"))


for _o, (_label, _g, _h) in GRADIENTS.items():
    query(f"with {ROWS} select rid, round(cast({_g} as double), 6) as g, round(cast({_h} as double), 6) as h from rows", f"grad_{_o}")(lambda spark, sf_dir, o=_o, y=_label: _gradient(spark, sf_dir, o, y))

_SOFT = "exp(score) + exp(score / 2) + exp(-score)"


@query(f"with {ROWS}, p as (select rid, yc, unnest([0, 1, 2]) as class, unnest([exp(score) / ({_SOFT}), exp(score / 2) / ({_SOFT}), exp(-score) / ({_SOFT})]) as p from rows) select rid, class, round(p - cast(yc = class as integer), 6) as g, round(greatest(2 * p * (1 - p), 1e-6), 6) as h from p")
def grad_multiclass(spark, sf_dir):
    raw = F.array(F.col("score"), F.col("score") / 2, -F.col("score"))
    pairs = [objectives.class_gradient(raw, F.col("yc"), k) for k in range(3)]
    packed = F.array(*[F.struct(F.lit(k).alias("class"), F.round(g, 6).alias("g"), F.round(h, 6).alias("h")) for k, (g, h) in enumerate(pairs)])
    return rows(spark, sf_dir).select("rid", F.explode(packed).alias("x")).select("rid", "x.*")


_BASES = {
    "mean": ("regression", "label", "avg(label)"),
    "logit": ("binary", "yb", "ln(avg(yb) / (1 - avg(yb)))"),
    "median": ("mae", "label", "(select label from rows order by label limit 1 offset (select cast(floor(count(*) * 0.5) as bigint) from rows))"),
    "quantile": ("quantile", "label", "(select label from rows order by label limit 1 offset (select cast(floor(count(*) * 0.9) as bigint) from rows))"),
    "logmean": ("poisson", "label", "ln(avg(label))"),
}
for _n, (_o, _label, _expr) in _BASES.items():

    def _base(spark, sf_dir, o=_o, y=_label):
        df = rows(spark, sf_dir).select("rid", F.col(y).alias("label"), "weight")
        return spark.createDataFrame([(round(objectives.base_scores(df, Params(objective=o), df.count())[0], 6),)], "base double")

    query(f"with {ROWS} select distinct round(cast({_expr} as double), 6) as base from rows" if "select" in _expr else f"with {ROWS} select round(cast({_expr} as double), 6) as base from rows", f"base_score_{_n}")(_base)


@query(f"with {ROWS} select cast(yc as integer) as class, round(ln((count(*) + 1.0) / ((select count(*) from rows) + 3)), 6) as base from rows group by yc")
def base_score_priors(spark, sf_dir):
    df = rows(spark, sf_dir).select("rid", F.col("yc").alias("label"), "weight")
    found = objectives.base_scores(df, Params(objective="multiclass", num_class=3), df.count())
    return spark.createDataFrame([(k, round(b, 6)) for k, b in enumerate(found)], "class int, base double")


# Squared loss at the score 32: gradients are whole numbers.
def graded(spark, sf_dir, node=None) -> DataFrame:
    out = binned(spark, sf_dir).rows.select("rid", "bins", (32.0 - F.col("label")).alias("g"), F.lit(1.0).alias("h"), F.lit(0).alias("node"))
    return out if node is None else out.withColumn("node", F.expr(node))


def _hist_sql(name: str, source: str) -> str:
    return f"{name} as (select node, f, bin, sum(g) as g, sum(h) as h, cast(count(*) as bigint) as c from {source} group by node, f, bin)"


GRADED = "graded as (select rid, f, bin, 32.0::double - label as g, 1.0::double as h, 0 as node from binned)"
SIDES = "sided as (select a.rid, a.f, a.bin, a.g, a.h, case when b.bin <= 5 then 1 else 2 end as node from graded a join binned b on a.rid = b.rid and b.f = 1)"
_SIDE = "case when bins[1] <= 5 then 1 else 2 end"
_HIST = "select cast(node as integer) as node, cast(f as integer) as f, cast(bin as integer) as bin, g, h, c from"


@query(f"with {DATA}, {GRADED}, {_hist_sql('hist', 'graded')} {_HIST} hist")
def hist_root(spark, sf_dir):
    return histogram.histogram(graded(spark, sf_dir), deterministic=True)


@query(f"with {DATA}, {GRADED}, {SIDES}, {_hist_sql('hist', 'sided')} {_HIST} hist")
def hist_level2(spark, sf_dir):
    return histogram.histogram(graded(spark, sf_dir, _SIDE))


@query(f"with {DATA}, {GRADED}, {SIDES}, {_hist_sql('hist', 'sided')} {_HIST} hist where node = 2")
def hist_subtract(spark, sf_dir):
    both = graded(spark, sf_dir, _SIDE)
    small = histogram.histogram(both.where("node = 1"))
    return histogram.subtract(histogram.histogram(graded(spark, sf_dir)), small, 2)


def splits_sql(p: str, hist: str, categorical: bool = True, where: str = "true", sign: int = 0) -> str:
    """CTEs ``{p}cand`` and ``{p}best`` of a histogram: numeric features 0 and 1,
    the categorical feature 2."""
    mono = "" if not sign else " and (f <> 1 or -gr / (hr + 1) >= -gl / (hl + 1))"
    cat = f"""
), {p}order as (
  select node, f, bin as b, row_number() over w - 1 as bin, sum(g) over w as gl, sum(h) over w as hl, sum(c) over w as cl,
         sum(g) over n as ng, sum(h) over n as nh, sum(c) over n as nc, count(*) over n as m
  from {hist} where f = 2 and h > 0 and ({where})
  window w as (partition by node, f order by g / (h + 10.0), bin rows between unbounded preceding and current row), n as (partition by node, f)
), {p}cat as (
  select node, f, bin, false as missing_left, gl, hl, cl, ng, nh, nc,
         (select list_sort(list(o.b)) from {p}order o where o.node = x.node and o.bin <= x.bin) as left_bins
  from {p}order x where bin < m - 1""" if categorical else ""
    union = f" union all select node, f, bin, missing_left, gl, hl, cl, ng, nh, nc, left_bins from {p}cat" if categorical else ""
    return f"""{p}dense as (
  select node, f, bin, sum(g) as g, sum(h) as h, sum(c) as c from (
    select node, f, bin, g, h, c from {hist} where f < 2 and ({where}) union all select distinct node, f, 0, 0.0::double, 0.0::double, 0 from {hist} where f < 2 and ({where})) group by node, f, bin
), {p}known as (
  select *, sum(g) over n as ng, sum(h) over n as nh, sum(c) over n as nc,
         sum(case when bin = 15 then g else 0 end) over n as mg, sum(case when bin = 15 then h else 0 end) over n as mh, sum(case when bin = 15 then c else 0 end) over n as mc
  from {p}dense window n as (partition by node, f)
), {p}run as (
  select *, sum(g) over w as pg, sum(h) over w as ph, sum(c) over w as pc from {p}known where bin < 15
  window w as (partition by node, f order by bin rows between unbounded preceding and current row)
), {p}num as (
  select node, f, bin, ml as missing_left, case when ml then pg + mg else pg end as gl, case when ml then ph + mh else ph end as hl,
         case when ml then pc + mc else pc end as cl, ng, nh, nc
  from {p}run, (select unnest([false, true]) as ml) where bin < 14 and (not ml or mh > 0){cat}
), {p}all as (
  select node, f, bin, missing_left, gl, hl, cl, ng, nh, nc, null::integer[] as left_bins from {p}num{union}
), {p}both as (
  select *, ng - gl as gr, nh - hl as hr, nc - cl as cr from {p}all
), {p}cand as (
  select *, gl * gl / (hl + 1.0::double) + gr * gr / (hr + 1.0::double) - ng * ng / (nh + 1.0::double) as gain from {p}both
  where hl >= 1 and hr >= 1 and cl > 0 and cr > 0{mono}
), {p}best as (
  select * from (select *, row_number() over (partition by node order by gain desc, f, bin, missing_left) as n from {p}cand where gain > 0) where n = 1
)"""


_SPLIT = "select cast(node as integer) as node, cast(f as integer) as f, cast(bin as integer) as bin, missing_left, array_to_string(left_bins, ',') as left_bins, round(gain, 4) as gain, round(gl, 6) as gl, hl, cast(cl as bigint) as cl, cast(cr as bigint) as cr from"


def _shown(df: DataFrame) -> DataFrame:
    return df.select("node", "f", "bin", "missing_left", F.array_join("left_bins", ",").alias("left_bins"), F.round("gain", 4).alias("gain"), F.round("gl", 6).alias("gl"), "hl", "cl", "cr")


def _split(hist: str, name: str, **kw) -> str:
    return f"with {DATA}, {GRADED}, {SIDES}, {_hist_sql('hist', hist)}, {splits_sql('s', 'hist', **kw)} {_SPLIT} {name}"


@query(_split("graded", "scand where f = 1 and gain > 0"))
def split_numeric(spark, sf_dir):
    return _shown(splits.candidates(histogram.histogram(graded(spark, sf_dir), [1]), PARAMS, [2]))


@query(_split("graded", "scand where f = 0 and gain > 0"))
def split_missing_dir(spark, sf_dir):
    return _shown(splits.candidates(histogram.histogram(graded(spark, sf_dir), [0]), PARAMS, [2]))


@query(_split("graded", "scand where f = 2 and gain > 0"))
def split_categorical_fisher(spark, sf_dir):
    return _shown(splits.candidates(histogram.histogram(graded(spark, sf_dir), [2]), PARAMS, [2]))


@query(_split("graded", "scand where gain > 0", sign=1))
def split_monotone(spark, sf_dir):
    return _shown(splits.candidates(histogram.histogram(graded(spark, sf_dir)), PARAMS, [2], {1: 1}))


@query(_split("sided", "sbest", where="f <> 2"))
def split_masked(spark, sf_dir):
    return _shown(splits.best(splits.candidates(histogram.histogram(graded(spark, sf_dir, _SIDE), [0, 1]), PARAMS, [2])))


@query(_split("sided", "sbest"))
def best_split_tiebreak(spark, sf_dir):
    return _shown(splits.best(splits.candidates(histogram.histogram(graded(spark, sf_dir, _SIDE)), PARAMS, [2])))


def _grown(spark, sf_dir, depth: int) -> tuple[DataFrame, Tree]:
    data = binned(spark, sf_dir)
    table = graded(spark, sf_dir)
    return table, plan.Grower(table, data, PARAMS.but(max_depth=depth, learning_rate=1.0), [0, 1, 2]).grow()


def _route_sql(source: str, best: str, out: str) -> str:
    """Rows of ``source`` (rid, f, bin, g, h, node) with the node below."""
    return f"""{out} as (
  select a.rid, a.f, a.bin, a.g, a.h, case when s.f is null then a.node else 2 * a.node + case
         when s.left_bins is not null then case when list_contains(s.left_bins, b.bin) then 1 else 2 end
         when b.bin = 15 then case when s.missing_left then 1 else 2 end when b.bin <= s.bin then 1 else 2 end end as node
  from {source} a left join {best} s on a.node = s.node left join binned b on b.rid = a.rid and b.f = s.f)"""


DEPTH1 = f"{DATA}, {GRADED}, {_hist_sql('h0', 'graded')}, {splits_sql('a', 'h0')}, {_route_sql('graded', 'abest', 'one')}"
DEPTH2 = f"{DEPTH1}, {_hist_sql('h1', 'one')}, {splits_sql('b', 'h1')}, {_route_sql('one', 'bbest', 'two')}"


def _routed(spark, sf_dir, depth):
    table, tree = _grown(spark, sf_dir, depth)
    return blocks.nodes(blocks.pack(table, PARAMS.bins), tree, PARAMS.bins)


query(f"with {DEPTH1} select rid, cast(node as integer) as node from one where f = 0", "route_depth1")(lambda s, d: _routed(s, d, 1))
query(f"with {DEPTH2} select rid, cast(node as integer) as node from two where f = 0", "route_depth2")(lambda s, d: _routed(s, d, 2))


@query(f"with {DEPTH2} select cast(node as integer) as node, round(-sum(g) / (sum(h) + 1), 6) as leaf, cast(count(*) as double) as cover from two where f = 0 group by node")
def leaf_values(spark, sf_dir):
    _, tree = _grown(spark, sf_dir, 2)
    return spark.createDataFrame([(n, round(float(tree.leaf[n]), 6), float(tree.cover[n])) for n in tree.reachable() if tree.feature[n] < 0], "node int, leaf double, cover double")


@query(f"with {DEPTH2} select cast(node as integer) as node, cast(f as integer) as f, round(gain, 4) as gain from abest union all select cast(node as integer), cast(f as integer), round(gain, 4) from bbest")
def train_one_tree_depth2(spark, sf_dir):
    _, tree = _grown(spark, sf_dir, 2)
    return spark.createDataFrame([(n, int(tree.feature[n]), round(float(tree.gain[n]), 4)) for n in tree.reachable() if tree.feature[n] >= 0], "node int, f int, gain double")


def _renewed(q):
    def run(spark, sf_dir):
        table = rows(spark, sf_dir).select("rid", (F.col("label") - F.col("score")).alias("residual"), F.col("x1").cast("int").alias("node"))
        return plan.residual_quantiles(table, q, 1)

    return run


for _q, _n in ((0.5, "median"), (0.9, "quantile")):
    query(f"with {ROWS}, r as (select cast(x1 as integer) as node, label - score as v, row_number() over (partition by x1 order by label - score) - 1 as i, count(*) over (partition by x1) as m from rows) select node, v as value from r where m >= 4 and i = least(m - 1, cast(floor(m * {_q}::double) as bigint))", f"leaf_renew_{_n}")(_renewed(_q))


# Three rounds of stumps on the month and the category, from the base score 32;
# scores are rounded to 2^-20, so sums are exact.
@query(
    "with " + DATA + ", " + ", ".join(
        [f"r0 as (select rid, f, bin, label, 32.0::double as s from binned where f > 0)"]
        + [
            f"g{i} as (select rid, f, bin, round((s - label) * 1048576) / 1048576 as g, 1.0::double as h, 0 as node from r{i}), {_hist_sql(f'q{i}', f'g{i}')}, {splits_sql(f't{i}', f'q{i}')}, {_route_sql(f'g{i}', f't{i}best', f'n{i}')}, l{i} as (select node, 0.5::double * (-sum(g) / (sum(h) + 1)) as v from n{i} where f = 1 group by node), r{i + 1} as (select r.rid, r.f, r.bin, r.label, r.s + l.v as s from r{i} r join n{i} n on r.rid = n.rid and r.f = n.f join l{i} l on l.node = n.node)"
            for i in range(3)
        ]
    ) + " select rid, round(s, 4) as score from r3 where f = 1"
)
def train_boosted_3_rounds(spark, sf_dir):
    data = binned(spark, sf_dir)
    p = PARAMS.but(max_depth=1, allowed_features=("x1", "x2"), deterministic=True)
    init = Forest("regression", 16, [32.0], FEATURES, [2])
    forest, _ = plan.fit(data, p, init=init, start=data.rows.select("rid", F.array(F.lit(32.0)).alias("raw")))
    return rows(spark, sf_dir).select("rid", F.round(predict.raw_expression(forest)[0], 4).alias("score"))


def _internal(forest: Forest, spark: SparkSession, *more: str) -> DataFrame:
    return forest.nodes(spark).where("feature >= 0").select(*more, "node", F.col("feature").alias("f"), F.round("gain", 4).alias("gain"))


_PICK = "select cast(node as integer) as node, cast(f as integer) as f, round(gain, 4) as gain from"


# Best first: the root, the better of its children, then the best of what is open.
@query(f"with {DEPTH1}, {_hist_sql('h1', 'one')}, {splits_sql('b', 'h1')}, first as (select * from bbest order by gain desc, node limit 1), {_route_sql('one', 'first', 'two')}, {_hist_sql('h2', '(select * from two where node > 2)')}, {splits_sql('c', 'h2')}, open as (select node, f, gain from bbest where node not in (select node from first) union all select node, f, gain from cbest), second as (select * from open order by gain desc, node limit 1) {_PICK} abest union all {_PICK} first union all {_PICK} second")
def train_leafwise_4_leaves(spark, sf_dir):
    data, p = binned(spark, sf_dir), PARAMS.but(max_depth=4, num_leaves=4, learning_rate=1.0)
    tree = plan.Grower(graded(spark, sf_dir), data, p, [0, 1, 2]).grow()
    return _internal(Forest("regression", 16, [32.0], FEATURES, [2], [tree]), spark)


def _tree_sql(p: str, source: str) -> str:
    """CTEs of a tree of depth two on ``source`` (rid, f, bin, g, h, node): its splits
    {p}1best and {p}2best, and the rows' leaves in {p}leaf."""
    return f"{_hist_sql(f'{p}h1', source)}, {splits_sql(f'{p}1', f'{p}h1')}, {_route_sql(source, f'{p}1best', f'{p}r1')}, {_hist_sql(f'{p}h2', f'{p}r1')}, {splits_sql(f'{p}2', f'{p}h2')}, {_route_sql(f'{p}r1', f'{p}2best', f'{p}leaf')}"


def _tree_out(p: str, tree: int) -> str:
    return " union all ".join(f"select {tree} as tree, cast(node as integer) as node, cast(f as integer) as f, round(gain, 4) as gain from {p}{d}best" for d in (1, 2))


@query(
    f"with {DATA}, prior as (select yc as k, (count(*) + 1.0) / ((select count(*) from rows) + 3) as p from rows group by yc), "
    + ", ".join(f"k{k} as (select b.rid, f, bin, p - cast(yc = {k} as integer)::double as g, greatest(2 * p * (1 - p), 1e-6) as h, 0 as node from binned b join rows r on b.rid = r.rid, prior where k = {k}), {_tree_sql(f't{k}', f'k{k}')}" for k in range(3))
    + " "
    + " union all ".join(_tree_out(f"t{k}", k) for k in range(3))
)
def train_multiclass_round(spark, sf_dir):
    df = rows(spark, sf_dir).withColumn("label", F.col("yc"))
    forest, _ = plan.train(df, FEATURES, "label", PARAMS.but(objective="multiclass", num_class=3, n_estimators=1), rid="rid")
    return _internal(forest, spark, "tree")


@query(
    f"with {DATA}, base as (select avg(label) as s from rows), w0 as (select rid, f, bin, s - label as g, 1.0::double as h, 0 as node from binned, base), {_tree_sql('t0', 'w0')}, "
    f"v0 as (select node, 0.5::double * (-sum(g) / (sum(h) + 1)) as v from t0leaf where f = 0 group by node), w1 as (select l.rid, l.f, l.bin, l.g + v as g, 1.0::double as h, 0 as node from t0leaf l join v0 using (node)), {_tree_sql('t1', 'w1')} {_tree_out('t0', 0)} union all {_tree_out('t1', 1)}"
)
def warm_start(spark, sf_dir):
    data = rows(spark, sf_dir)
    first, _ = plan.train(data, FEATURES, "label", PARAMS.but(n_estimators=1), rid="rid")
    forest, _ = plan.train(data, FEATURES, "label", PARAMS.but(n_estimators=1), rid="rid", init=first)
    return _internal(forest, spark, "tree")


# Stumps on the month and the category; the metric is taken on every fourth row, whose
# labels count backwards, so that it gets worse from the first round on.
_STUMPS = ", ".join(
    ["r0 as (select rid, f, bin, label, 32.0::double as s from binned where f > 0)"]
    + [f"g{i} as (select rid, f, bin, s - label as g, 1.0::double as h, 0 as node from r{i}), {_hist_sql(f'q{i}', f'g{i}')}, {splits_sql(f't{i}', f'q{i}')}, {_route_sql(f'g{i}', f't{i}best', f'n{i}')}, l{i} as (select node, 0.5::double * (-sum(g) / (sum(h) + 1)) as v from n{i} where f = 1 group by node), r{i + 1} as (select r.rid, r.f, r.bin, r.label, r.s + l.v as s from r{i} r join n{i} n on r.rid = n.rid and r.f = n.f join l{i} l on l.node = n.node)" for i in range(3)]
)


@query(f"with {DATA}, {_STUMPS}, m as (" + " union all ".join(f"select {i} as round, sqrt(avg((s - (64 - label)) * (s - (64 - label)))) as metric from r{i} where f = 1 and rid % 4 = 0" for i in (1, 2, 3)) + ") select cast(round as integer) as round, round(metric, 4) as metric, round <= (select min(round) from m where metric = (select min(metric) from m)) as kept from m")
def early_stop(spark, sf_dir):
    data = binned(spark, sf_dir)
    p = PARAMS.but(n_estimators=9, max_depth=1, allowed_features=("x1", "x2"), early_stopping_rounds=2)
    init, start = Forest("regression", 16, [32.0], FEATURES, [2]), data.rows.select("rid", F.array(F.lit(32.0)).alias("raw"))
    valid = data.rows.where("rid % 4 = 0").withColumn("label", 64 - F.col("label"))
    forest, history = plan.fit(data, p, valid, init, start, start)
    return spark.createDataFrame([(i + 1, round(m, 4), i < len(forest.trees)) for i, m in enumerate(history)], "round int, metric double, kept boolean")


_BUCKET = "least(1023, cast(floor(abs(32.0 - label) / (select max(abs(32.0 - label)) from rows) * 1024) as integer))"


@query(f"with {ROWS}, b as (select {_BUCKET} as bucket, count(*) as n from rows group by 1), c as (select bucket, sum(n) over (order by bucket desc rows between unbounded preceding and current row) as cum from b) select cast(max(bucket) as double) / 1024 * (select max(abs(32.0 - label)) from rows) as threshold from c where cum >= cast(floor((select count(*) from rows) * 0.2::double) as bigint)")
def goss_threshold(spark, sf_dir):
    df = rows(spark, sf_dir).select("rid", (32.0 - F.col("label")).alias("g"))
    return sampling.goss_threshold(df, 0.2, df.count())


def _wang_sql(x: str) -> str:
    m = "4294967295"
    a = f"xor(xor({x}, 61), {x} >> 16)"
    return f"(with a as (select {a} as v), b as (select (v * 9) & {m} as v from a), c as (select xor(v, v >> 4) as v from b), d as (select (v * 668265261) & {m} as v from c) select xor(v, v >> 15) from d)"


def _keep_sql(seed: int, rate: float) -> str:
    from .functions.hashing import wang_int

    return f"cast({_wang_sql(f'xor(cast(rid as bigint) & 4294967295, {wang_int(seed)})')} >> 8 as double) / 16777216 < {rate}::double"


@query(f"with {ROWS} select rid from rows where {_keep_sql(1, 0.5)}")
def bagging_sample(spark, sf_dir):
    return sampling.bagged(rows(spark, sf_dir), 0.5, 0).select("rid")


_CUT = f"b as (select {_BUCKET} as bucket, count(*) as n from rows group by 1), c as (select bucket, sum(n) over (order by bucket desc rows between unbounded preceding and current row) as cum from b), t as (select rid, 32.0::double - label as g, (select cast(max(bucket) as double) / 1024 * (select max(abs(32.0 - label)) from rows) from c where cum >= cast(floor((select count(*) from rows) * 0.2::double) as bigint)) as cut from rows)"


@query(f"with {ROWS}, {_CUT} select rid, case when abs(g) >= cut then g else g * 8.0 end as g from t where abs(g) >= cut or {_keep_sql(1, 0.125)}")
def goss_sample(spark, sf_dir):
    df = rows(spark, sf_dir).select("rid", (32.0 - F.col("label")).alias("g"), F.lit(1.0).alias("h"))
    return sampling.goss(df, Params(goss=True, goss_top_rate=0.2, goss_other_rate=0.1), df.count(), 0).select("rid", F.round("g", 9).alias("g"))


# The same draw as blocks take it, into the root's histogram of the month.
@query(f"with {DATA}, {_CUT}, s as (select rid, case when abs(g) >= cut then g else g * 8.0 end as g, case when abs(g) >= cut then 1.0 else 8.0 end as h from t where abs(g) >= cut or {_keep_sql(1, 0.125)}) select cast(bin as integer) as bin, round(sum(s.g), 6) as g, round(cast(sum(s.h) as double), 6) as h, count(*) as c from s join binned b on b.rid = s.rid and b.f = 1 group by bin")
def goss_histogram(spark, sf_dir):
    df = graded(spark, sf_dir)
    n = df.count()
    cut = float(sampling.goss_threshold(df, 0.2, n).first()[0])
    drawn = blocks.changed(blocks.pack(df, PARAMS.bins), PARAMS.bins, lambda b: blocks.one_side(b, cut, 0.2, 0.1, 1))
    hist = blocks.cells_table(blocks.summed(blocks.partials(drawn, Tree.empty(1), [0], [1], PARAMS.bins, False)))
    return hist.select("bin", F.round("g", 6).alias("g"), F.round("h", 6).alias("h"), "c")


_HASH = _wang_sql("xor(seed, f)") + " >> 8"


@query(f"with d as (select tree, f, {_HASH} as v from (select t.range as tree, {_wang_sql('(t.range + 1)')} as seed, f.range as f from range(0, 8) t, range(0, 6) f)) select cast(tree as integer) as tree, cast(f as integer) as f from d where v < 8388608 or (v = (select min(v) from d e where e.tree = d.tree) and not exists (select 1 from d e where e.tree = d.tree and v < 8388608))")
def colsample_mask(spark, sf_dir):
    return spark.createDataFrame([(t, f) for t in range(8) for f in sampling.sampled_features(list(range(6)), 0.5, t)], "tree int, f int")


def tiny_forest(objective: str = "regression") -> Forest:
    """Two fixed trees: one numeric with a missing direction, one categorical."""
    import numpy as np

    a, b = Tree.empty(2), Tree.empty(1)
    a.feature[[0, 1]] = [1, 0]
    a.threshold[[0, 1]] = [6.0, 150000.0]
    a.flags[1] = 1
    a.leaf[[2, 3, 4]] = [0.5, -0.25, 0.75]
    a.cover[:5] = [100, 60, 40, 24, 36]
    a.gain[:2] = [8.0, 4.0]
    b.feature[0], b.flags[0], b.left[0] = 2, 2, [1, 3, 5]
    b.leaf[1:] = [1.0, -1.0]
    b.cover[:] = [100, 50, 50]
    b.gain[0] = 2.0
    return Forest(objective, 16, [0.125], FEATURES, [2], [a, b])


_RAW = "0.125::double + (case when x1 <= 6 then case when x0 is null or x0 <= 150000 then -0.25 else 0.75 end else 0.5 end) + (case when cast(x2 as integer) in (1, 3, 5) then 1.0 else -1.0 end)"


@query(f"with {ROWS} select rid, cast({_RAW} as double) as prediction from rows")
def predict_forest(spark, sf_dir):
    return predict.predict(tiny_forest(), rows(spark, sf_dir)).select("rid", "prediction")


@query(f"with {ROWS} select rid, cast({_RAW} as double) as raw from rows where x0 is null")
def predict_missing(spark, sf_dir):
    return rows(spark, sf_dir).where("x0 is null").select("rid", predict.raw_expression(tiny_forest())[0].alias("raw"))


@query(f"with {ROWS} select rid, cast({_RAW.replace('cast(x2 as integer) in (1, 3, 5)', '(x2 + 12 < 15 and cast(x2 as integer) + 12 in (1, 3, 5))')} as double) as prediction from rows")
def predict_category_out_of_range(spark, sf_dir):
    df = rows(spark, sf_dir).withColumn("x2", F.col("x2") + 12)
    return predict.predict(tiny_forest(), df).select("rid", "prediction")


@query(f"with {ROWS} select rid, cast({_RAW} > 0 as integer) as prediction, round(1 / (1 + exp(-({_RAW}))), 6) as p from rows")
def predict_proba(spark, sf_dir):
    return predict.predict(tiny_forest("binary"), rows(spark, sf_dir)).select("rid", F.col("prediction"), F.round(F.col("probability")[1], 6).alias("p"))


@query(f"with {ROWS} select rid, case when x1 <= 6 then case when x0 is null or x0 <= 150000 then 3 else 4 end else 2 end as leaf0, case when cast(x2 as integer) in (1, 3, 5) then 1 else 2 end as leaf1 from rows")
def assign_leaves(spark, sf_dir):
    df = rows(spark, sf_dir)
    leaves = predict.leaf_ids(tiny_forest(), df)
    return df.select("rid", leaves.alias("l")).select("rid", F.col("l")[0].alias("leaf0"), F.col("l")[1].alias("leaf1"))


_LOSSES = {
    "rmse": ("label", "sqrt(avg((score - label) * (score - label)))"),
    "mae": ("label", "avg(abs(score - label))"),
    "pinball": ("label", "avg(case when label >= score then 0.9 * (label - score) else -(1 - 0.9) * (label - score) end)"),
    "logloss": ("yb", f"avg(case when yb > 0.5 then -ln({_P}) else -ln(1 - {_P}) end)"),
    "poisson": ("label", "avg(2 * (case when label > 0 then label * ln(label / exp(score)) else 0 end - (label - exp(score))))"),
    "tweedie": ("label", "avg(2 * (pow(label, 0.5) / -0.25 + label * pow(exp(score), -0.5) / 0.5 + pow(exp(score), 0.5) / 0.5))"),
    "auc": ("yb", "(select (sum(r) - count(*) * (count(*) + 1) / 2.0) / (count(*) * ((select count(*) from rows) - count(*))) from (select yb, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0 as r from rows) where yb > 0.5)"),
}
for _m, (_label, _expr) in _LOSSES.items():

    def _metric(spark, sf_dir, m=_m, y=_label):
        return metrics.evaluate(rows(spark, sf_dir).select("score", F.col(y).alias("label")), m).select(F.round("value", 5).alias("value"))

    query(f"with {ROWS} select distinct round(cast({_expr} as double), 5) as value from rows" if _m == "auc" else f"with {ROWS} select round(cast({_expr} as double), 5) as value from rows", f"metric_{_m}")(_metric)


@query(f"with {ROWS} select round(avg(-ln(case when yc = 0 then exp(score) when yc = 1 then exp(score / 2) else exp(-score) end / ({_SOFT}))), 5) as value from rows")
def metric_multilogloss(spark, sf_dir):
    raw = F.array(F.col("score"), F.col("score") / 2, -F.col("score"))
    return metrics.evaluate(rows(spark, sf_dir).select(raw.alias("score"), F.col("yc").alias("label")), "multi_logloss").select(F.round("value", 5).alias("value"))


def _importance(kind):
    def run(spark, sf_dir):
        _, tree = _grown(spark, sf_dir, 2)
        found = Forest("regression", 16, [32.0], FEATURES, [2], [tree]).importance(kind)
        return spark.createDataFrame([(f, round(x, 4)) for f, x in enumerate(found)], "feature int, importance double")

    return run


for _kind, _agg in (("gain", "sum(gain)"), ("split", "count(*)")):
    query(f"with {DEPTH2}, s as (select f, gain from abest union all select f, gain from bbest) select cast(k.range as integer) as feature, round(cast(coalesce((select {_agg} from s where s.f = k.range), 0) as double), 4) as importance from range(0, 3) k", f"importance_{_kind}")(_importance(_kind))


@query(f"with {ROWS} select rid, round(cast({_RAW} as double), 6) as total from rows")
def shap_additivity(spark, sf_dir):
    df = rows(spark, sf_dir)
    phi = contribution_column(tiny_forest(), df)
    return df.select("rid", phi.alias("phi")).select("rid", F.round(F.aggregate("phi", F.lit(0.0), lambda a, b: a + b), 6).alias("total"))


# Depth-two tree: with a = [x1 <= 6], b = [x0 goes left], v the expected leaf
# given a set of known features; Shapley values by the definition.
_A, _B = "(x1 <= 6)", "(x0 is null or x0 <= 150000)"
_INNER = f"(case when {_B} then -0.25 else 0.75 end)"
_V = {"": "(0.6 * (0.4 * -0.25 + 0.6 * 0.75) + 0.4 * 0.5)", "a": f"(case when {_A} then 0.4 * -0.25 + 0.6 * 0.75 else 0.5 end)", "b": f"(0.6 * {_INNER} + 0.4 * 0.5)", "ab": f"(case when {_A} then {_INNER} else 0.5 end)"}


@query(f"with {ROWS} select rid, round(cast(0.5 * ({_V['b']} - {_V['']}) + 0.5 * ({_V['ab']} - {_V['a']}) as double), 6) as phi0, round(cast(0.5 * ({_V['a']} - {_V['']}) + 0.5 * ({_V['ab']} - {_V['b']}) as double), 6) as phi1, case when cast(x2 as integer) in (1, 3, 5) then 1.0::double else -1.0::double end as phi2, round(cast(0.125 + {_V['']} as double), 6) as bias from rows")
def shap_depth2_exact(spark, sf_dir):
    df = rows(spark, sf_dir)
    return df.select("rid", contribution_column(tiny_forest(), df).alias("phi")).select("rid", *[F.round(F.col("phi")[i], 6).alias(n) for i, n in enumerate(["phi0", "phi1", "phi2", "bias"])])


@query(f"with {ROWS} select count(*) as n, count(distinct rid) as distinct_n, min(rid) as low, max(rid) as high, cast(sum(rid) as bigint) as total from rows")
def shadow_permutation(spark, sf_dir):
    df = rows(spark, sf_dir)
    p = df.select(permuted(F.col("rid"), df.count(), 12345).alias("p"))
    return p.agg(F.count("*").alias("n"), F.count_distinct("p").alias("distinct_n"), F.min("p").alias("low"), F.max("p").alias("high"), F.sum("p").alias("total"))


@query("with recursive c(k, v) as (select 0, 1.0::double union all select k + 1, v * (20 - k) / (k + 1) from c where k < 20) select cast(h.range as integer) as hits, round((select sum(v) from c where k >= h.range) / pow(2, 20), 9) as tail, case when (select sum(v) from c where k >= h.range) / pow(2, 20) < 0.05 / 21 then 'confirmed' when (select sum(v) from c where k >= 20 - h.range) / pow(2, 20) < 0.05 / 21 then 'rejected' else 'tentative' end as verdict from range(0, 21) h")
def binomial_verdict(spark, sf_dir):
    said = selection.verdicts(list(range(21)), 20, 0.05)
    return spark.createDataFrame([(h, round(selection.tail(20, h), 9), v) for h, v in enumerate(said)], "hits int, tail double, verdict string")


@query()
def boruta_hits(spark, sf_dir):
    p = PARAMS.but(selection_rounds=5, selection_estimators=1, max_depth=1)
    data = binned(spark, sf_dir)
    found = selection.select_features(data, p)
    return spark.createDataFrame(list(zip(FEATURES, found.hits)), "feature string, hits int")


@query(f"with {ROWS}, s as (select * from rows where rid % greatest(1, (select count(*) from rows) // 4096) = 0), l as (select 0 as f, x0 as x, label as y from s union all select 1, x1, label from s union all select 2, x2, label from s), m as (select f, avg(x) as xm, avg(y) as ym from l group by f) select cast(f as integer) as f, round(sum((x - xm) * (y - ym)) / (sqrt(sum((x - xm) * (x - xm))) * sqrt(sum((y - ym) * (y - ym)))), 5) as r from l join m using (f) where x is not null group by f")
def leakage_corr(spark, sf_dir):
    df = rows(spark, sf_dir)
    return guards.leakage(df, FEATURES, df.count()).select("f", F.round("r", 5).alias("r"))


@query(f"with {ROWS} select 'label is neither 0 nor 1' as rule, count(*) as n, min(rid) as first_row from rows where label not in (0, 1)")
def validate_labels(spark, sf_dir):
    return guards.violations(rows(spark, sf_dir), guards.label_rules(Params(objective="binary")))


@query(f"with {ROWS} select cast(max_bin as integer) as max_bin, max_bin > 64 and (select count(*) from rows) / cast(max_bin as double) < 64 as few from (values (32), (128), (256)) t(max_bin)")
def rows_per_bin_hint(spark, sf_dir):
    import warnings

    df = rows(spark, sf_dir)
    n, out = df.count(), []
    for b in (32, 128, 256):
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            out.append((b, any("few" in w for w in guards.warn(df, FEATURES, Params(max_bin=b), n))))
    return spark.createDataFrame(out, "max_bin int, few boolean")


@query("select event_id, cast(dense_rank() over (order by event_type) - 1 as integer) as code from events")
def label_encode(spark, sf_dir):
    from .estimator import CoppiceClassifier

    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type")
    coded, _ = CoppiceClassifier()._prepare(events, "event_type", Params(objective="binary"))
    return coded.select("event_id", F.col("event_type").cast("int").alias("code"))


def _written(df: DataFrame, name: str) -> str:
    """Lines of text in the shared scratch folder."""
    return f"{store(df, name, 'text')._stored}/{name}"


@query("select s_suppkey::double as s_suppkey, case when s_suppkey % 3 = 0 then null else s_acctbal end as acctbal, s_name as name from supplier")
def csv_parse(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    head = spark.createDataFrame([("s_suppkey, acctbal,name",)], "value string")
    field = F.when(F.col("s_suppkey") % 3 == 0, F.array(F.lit(""), F.lit("n/a"), F.lit(" NaN "))[(F.col("s_suppkey") % 9 / 3).cast("int")]).otherwise(F.concat(F.lit(" "), F.col("s_acctbal").cast("string"), F.lit(" EUR")))
    lines = s.coalesce(1).select(F.concat_ws(",", F.col("s_suppkey").cast("string"), field, "s_name", F.lit("more")).alias("value"))
    return tables.read_table(spark, _written(head.coalesce(1).union(lines).coalesce(1), "lines"), "csv", ["name"])


@query("select s_suppkey::double as label, s_nationkey::double as f0, 0.0::double as f1, case when s_suppkey % 2 = 0 then s_acctbal else 0.0 end as f2 from supplier")
def libsvm_parse(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    lines = s.select(F.concat(F.col("s_suppkey").cast("string"), F.lit(" qid:3 1:"), F.col("s_nationkey").cast("string"), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("  3:"), F.col("s_acctbal").cast("string"))).otherwise(""), F.lit(" # note 9:9")).alias("value"))
    return tables.read_table(spark, _written(lines, "lines"), "libsvm")


@query(f"with {ROWS} select rid, cast({_RAW} as double) as prediction from rows")
def name_mapping(spark, sf_dir):
    moved = rows(spark, sf_dir).select("yb", "x2", F.lit("other").alias("x9"), "x0", "rid", "x1")
    return predict.predict(tiny_forest(), moved).select("rid", "prediction")


@query(f"select cast(0.125 + {_V['']} + (0.5 * 1.0 + 0.5 * -1.0) as double) as bias")
def shap_bias(spark, sf_dir):
    from .operators.shap import expected

    return spark.createDataFrame([(float(expected(tiny_forest())[0]),)], "bias double").select(F.round("bias", 9).alias("bias"))


@query(f"with {ROWS} select rid, cast({_RAW} as double) as prediction from rows")
def model_round_trip(spark, sf_dir):
    import json

    again = Forest.from_json(json.loads(json.dumps(tiny_forest().as_json())))
    return predict.predict(again, rows(spark, sf_dir)).select("rid", "prediction")


@query(f"with {DATA} select rid, f, bin from binned")
def bundle_round_trip(spark, sf_dir):
    data = binned(spark, sf_dir)
    path = store(data.rows.limit(0), "none")._stored + "/bundle"
    bundles.save(data, path)
    again = bundles.load(spark, path).rows
    return again.select("rid", F.posexplode("bins").alias("f", "bin")).select("rid", "f", F.col("bin").cast("int").alias("bin"))


@query(f"with {ROWS} select cast(round(cast({_RAW} as double), 6) as varchar) as prediction, count(*) as n from rows group by 1")
def predictions_csv(spark, sf_dir):
    df = predict.predict(tiny_forest(), rows(spark, sf_dir)).select("rid", "prediction")
    path = store(df.limit(0), "none")._stored + "/predictions"
    tables.write_predictions(df, path)
    back = spark.read.option("header", True).csv(path)
    return back.groupBy(F.round(F.col("prediction").cast("double"), 6).cast("string").alias("prediction")).agg(F.count("*").alias("n"))


@query(f"with {ROWS}, p as (select rid, exp(a) / (exp(a) + exp(b) + exp(c)) as p0, exp(b) / (exp(a) + exp(b) + exp(c)) as p1 from (select rid, cast({_RAW} as double) as a, case when x1 <= 6 then -0.5::double else 0.5::double end as b, 0.25::double as c from rows)) select rid, round(p0, 6) as p0, round(p1, 6) as p1 from p")
def predict_multiclass(spark, sf_dir):
    """Three classes: the tiny forest's two trees both in class 0, one stump in class 1."""
    import numpy as np

    a, b = tiny_forest().trees
    stump, none = Tree.empty(1), Tree.empty(0)
    stump.feature[0], stump.threshold[0], stump.leaf[1:] = 1, 6.0, [-0.5, 0.5]
    zero = lambda: Tree(*(np.array(x) if not isinstance(x, dict) else {} for x in vars(none).values()))
    forest = Forest("multiclass", 16, [0.125, 0.0, 0.25], FEATURES, [2], [a, stump, zero(), b, zero(), zero()])
    found = predict.predict(forest, rows(spark, sf_dir))
    return found.select("rid", *[F.round(F.col("probability")[i], 6).alias(f"p{i}") for i in (0, 1)])


@query("select cast(row_number() over (order by s_suppkey) - 1 as bigint) as rid, s_suppkey from supplier")
def number_rows(spark, sf_dir):
    return binning.number_rows(spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey")).select("rid", "s_suppkey")


@query()
def stump_on_lineitem(spark, sf_dir):
    """Bins, squared loss, root histogram, best split, one tree and scored rows."""
    item = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    names = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]
    table = item.select("l_orderkey", *names, (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("label"))
    numbered = binning.number_rows(table)
    forest, _ = plan.train(numbered, names, "label", Params(n_estimators=1, max_depth=1, learning_rate=1.0), rid="rid")
    return predict.predict(forest, numbered).select("l_orderkey", "label", "prediction")


# Ids and their sides, joined to runs of equal sides; ids that are invalid go with the
# missing bin, which is not in the set.
@query("with s as (select -1 as i, false as side union all select range, range in (1, 2, 5) from range(0, 8) union all select 8, false), e as (select i, side, lead(side) over (order by i) is distinct from side or i in (-1, 7) as last from s) select cast(row_number() over (order by i) - 1 as integer) as step, case when i = 8 then 'infinity'::double else i + 0.5::double end as upper, side as is_left from e where last")
def export_interval_chain(spark, sf_dir):
    from .export import interval_chain

    return spark.createDataFrame([(i, e, s) for i, (e, s) in enumerate(interval_chain([1, 2, 5], 8))], "step int, upper double, is_left boolean")
