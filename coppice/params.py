"""Training parameters: names, defaults, aliases and their validation."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, fields, replace


class CoppiceError(ValueError):
    """Base of the errors that bad parameters, data or files raise."""


class ParameterError(CoppiceError):
    pass


class DataError(CoppiceError):
    pass


class ModelError(CoppiceError):
    pass


# Objective names in the order of their codes in model files.
OBJECTIVES = ["regression", "binary", "mae", "huber", "quantile", "poisson", "tweedie", "multiclass"]
# Other spellings of objectives.
OBJECTIVE_ALIASES = {"l2": "regression", "mse": "regression", "squared_error": "regression", "logistic": "binary", "binary_logistic": "binary", "l1": "mae", "softmax": "multiclass"}
METRICS = ["rmse", "mae", "pinball", "logloss", "auc", "poisson", "tweedie", "multi_logloss"]
# Other spellings of parameters.
ALIASES = {
    "num_trees": "n_estimators",
    "num_iterations": "n_estimators",
    "num_boost_round": "n_estimators",
    "num_round": "n_estimators",
    "eta": "learning_rate",
    "shrinkage_rate": "learning_rate",
    "lambda_l2": "reg_lambda",
    "reg_lambda_l2": "reg_lambda",
    "lambda": "reg_lambda",
    "gamma": "min_split_gain",
    "min_split_loss": "min_split_gain",
    "min_gain_to_split": "min_split_gain",
    "min_sum_hessian_in_leaf": "min_child_weight",
    "max_bins": "max_bin",
    "num_bins": "max_bin",
    "max_leaves": "num_leaves",
    "categorical_feature": "categorical_features",
    "top_rate": "goss_top_rate",
    "other_rate": "goss_other_rate",
    "bagging_fraction": "subsample",
    "feature_fraction": "colsample_bytree",
    "colsample": "colsample_bytree",
    "eval_metric": "metric",
}


@dataclass(frozen=True)
class Params:
    """Parameters of one fit. ``max_bin`` counts the bin of missing values."""

    n_estimators: int = 100
    max_depth: int = 6
    learning_rate: float = 0.1
    num_leaves: int | None = None
    reg_lambda: float = 1.0
    min_child_weight: float = 1.0
    min_split_gain: float = 0.0
    max_bin: int = 256
    categorical_features: tuple[str, ...] = ()
    cat_smooth: float = 10.0
    early_stopping_rounds: int = 0
    verbose: bool = False
    goss: bool = False
    goss_top_rate: float = 0.2
    goss_other_rate: float = 0.1
    objective: str = "regression"
    num_class: int = 1
    alpha: float = 0.9
    tweedie_variance_power: float = 1.5
    scale_pos_weight: float = 1.0
    subsample: float = 1.0
    colsample_bytree: float = 1.0
    monotone_constraints: tuple[int, ...] = ()
    metric: str | None = None
    importance_type: str = "gain"
    feature_selection: bool = False
    selection_rounds: int = 20
    selection_estimators: int | None = None
    selection_alpha: float = 0.05
    allowed_features: tuple[str, ...] | None = None
    deterministic: bool = False

    @staticmethod
    def make(**given) -> "Params":
        """From keyword arguments in any known spelling; unknown ones are an error,
        as is the same parameter given twice."""
        names, found = {f.name for f in fields(Params)}, {}
        for key, value in given.items():
            name = ALIASES.get(key, key)
            if name not in names:
                raise ParameterError(f"unknown parameter {key!r}")
            if name in found:
                raise ParameterError(f"{name!r} is given twice")
            found[name] = tuple(value) if isinstance(value, list) else value
        if isinstance(o := found.get("objective"), str):
            found["objective"] = OBJECTIVE_ALIASES.get(o, o)
        out = Params(**found)
        out.check()
        return out

    def but(self, **changes) -> "Params":
        return replace(self, **changes)

    def as_dict(self) -> dict:
        return asdict(self)

    @property
    def bins(self) -> int:
        """Bins of values, without the one of missing values, which comes last."""
        return self.max_bin - 1

    @property
    def classes(self) -> int:
        return self.num_class if self.objective == "multiclass" else 1

    @property
    def shown_metric(self) -> str:
        return self.metric or {"regression": "rmse", "huber": "rmse", "binary": "logloss", "mae": "mae", "quantile": "pinball", "poisson": "poisson", "tweedie": "tweedie", "multiclass": "multi_logloss"}[self.objective]

    def check(self) -> None:
        def need(ok: bool, what: str) -> None:
            if not ok:
                raise ParameterError(what)

        need(4 <= self.max_bin <= 256, "max_bin must be from 4 to 256")
        need(1 <= self.max_depth <= 12, "max_depth must be from 1 to 12")
        need(self.n_estimators >= 1, "n_estimators must be 1 at least")
        need(math.isfinite(self.learning_rate) and self.learning_rate > 0, "learning_rate must be a positive number")
        need(self.objective in OBJECTIVES, f"unknown objective {self.objective!r}")
        need(self.metric is None or self.metric in METRICS, f"unknown metric {self.metric!r}")
        if self.goss:
            need(self.goss_top_rate > 0 and self.goss_other_rate > 0, "GOSS rates must be positive")
            need(self.goss_top_rate + self.goss_other_rate <= 1, "GOSS rates must not exceed 1 together")
            need(self.subsample == 1, "GOSS and subsample exclude each other")
        need(0 < self.alpha and (self.objective != "quantile" or self.alpha < 1), "alpha must be between 0 and 1 for quantile, positive for huber")
        need(1 < self.tweedie_variance_power < 2, "tweedie_variance_power must be between 1 and 2")
        need(0 < self.subsample <= 1, "subsample must be in (0, 1]")
        need(0 < self.colsample_bytree <= 1, "colsample_bytree must be in (0, 1]")
        need(self.scale_pos_weight > 0, "scale_pos_weight must be positive")
        need(all(c in (-1, 0, 1) for c in self.monotone_constraints), "monotone constraints must be -1, 0 or 1")
        if self.num_leaves is not None:
            need(2 <= self.num_leaves <= 2**self.max_depth, "num_leaves must be from 2 to 2^max_depth")
        need(self.metric != "auc" or self.objective == "binary", "auc needs the binary objective")
        need((self.metric == "multi_logloss") <= (self.objective == "multiclass"), "multi_logloss needs the multiclass objective")
        if self.objective == "multiclass":
            need(3 <= self.num_class <= 128, "multiclass needs 3 to 128 classes")
            need(not self.goss, "multiclass excludes GOSS")
            need(self.metric in (None, "multi_logloss"), "multiclass takes multi_logloss only")
        need(self.selection_rounds >= 5, "selection_rounds must be 5 at least")
        need(0 < self.selection_alpha < 1, "selection_alpha must be between 0 and 1")
        need(self.selection_estimators is None or self.selection_estimators >= 1, "selection_estimators must be 1 at least")
        need(self.importance_type in ("gain", "split"), "importance_type must be gain or split")
