"""Estimators over DataFrames (arrays are taken too)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import export
from .model import Forest
from .operators.predict import leaf_ids, predict
from .operators.selection import Selection, chosen, select_features
from .operators.shap import contribution_column
from .params import DataError, ModelError, Params
from .plans.train import bin_dataset, train
from .sources.tables import from_arrays


class _Base:
    objective = "regression"

    def __init__(self, **params):
        self._given = dict(params)
        Params.make(**{"objective": self.objective, **self._given})
        self.forest: Forest | None = None
        self.selection_result_: Selection | None = None
        self.selected_features_: list[str] | None = None
        self.history_: list[float] = []

    def get_params(self, deep: bool = True) -> dict:
        return self.params.as_dict()

    def set_params(self, **params):
        given = self._given | params
        Params.make(**{"objective": self.objective, **given})
        self._given = given
        return self

    @property
    def params(self) -> Params:
        return Params.make(**{"objective": self.objective, **self._given})

    def _frame(self, x, y=None, names=None) -> tuple[DataFrame, str | None]:
        if isinstance(x, DataFrame):
            return x, None
        spark = SparkSession.getActiveSession()
        if spark is None:
            raise DataError("arrays need an active Spark session")
        return from_arrays(spark, x, y, names), "rid"

    def _prepare(self, df: DataFrame, label: str, params: Params) -> tuple[DataFrame, Params]:
        return df, params

    def fit(self, x, y=None, label: str = "label", features: list[str] | None = None, weight: str | None = None, rid: str | None = None, eval_set=None, init_model: "_Base | Forest | None" = None):
        """Fit on a DataFrame with a label column, or on arrays. ``rid``: a column of
        dense row numbers; without it rows are numbered in the order of their values."""
        df, own = self._frame(x, y)
        rid = rid or own
        names = features or [c for c in df.columns if c not in (label, weight, rid)]
        df, params = self._prepare(df, label, self.params)
        if params.early_stopping_rounds and eval_set is None:
            raise DataError("early stopping needs an eval_set")
        valid = None
        if eval_set is not None:
            if isinstance(eval_set, list):
                if len(eval_set) != 1:
                    raise DataError("only one eval_set is supported")
                eval_set = eval_set[0]
            valid, _ = self._frame(*(eval_set if isinstance(eval_set, tuple) else (eval_set,)))
            valid, _ = self._prepare(valid, label, params)
        if params.feature_selection:
            self.selection_result_ = select_features(bin_dataset(df, names, label, params, weight, rid), params)
            self.selected_features_ = chosen(self.selection_result_)
            params = params.but(allowed_features=tuple(self.selected_features_))
        init = init_model.forest if isinstance(init_model, _Base) else init_model
        self.forest, self.history_ = train(df, names, label, params, weight, rid, valid, init)
        self.forest.labels = getattr(self, "classes_", None)
        return self

    def select_features(self, x, y=None, label: str = "label", features: list[str] | None = None, rid: str | None = None) -> Selection:
        df, own = self._frame(x, y)
        rid = rid or own
        df, params = self._prepare(df, label, self.params)
        names = features or [c for c in df.columns if c not in (label, rid)]
        self.selection_result_ = select_features(bin_dataset(df, names, label, params, None, rid), params)
        return self.selection_result_

    def _need(self) -> Forest:
        if self.forest is None:
            raise ModelError("the estimator is not fitted")
        return self.forest

    def transform(self, df: DataFrame, raw: bool = False) -> DataFrame:
        return predict(self._need(), df, raw)

    def predict(self, x):
        """A DataFrame with ``prediction``; for arrays, an array of predictions."""
        df, rid = self._frame(x, names=self._need().features if not isinstance(x, DataFrame) else None)
        out = predict(self._need(), df)
        return out if rid is None else [r.prediction for r in out.select("rid", "prediction").orderBy("rid").collect()]

    def predict_contrib(self, df: DataFrame) -> DataFrame:
        return df.withColumn("contributions", contribution_column(self._need(), df))

    def predict_leaf(self, df: DataFrame) -> DataFrame:
        return df.withColumn("leaves", leaf_ids(self._need(), df))

    def feature_importance(self, kind: str | None = None) -> list[float]:
        return self._need().importance(kind or self.params.importance_type)

    @property
    def feature_importances_(self) -> list[float]:
        return self.feature_importance()

    @property
    def n_trees_(self) -> int:
        return len(self._need().trees)

    @property
    def n_features_in_(self) -> int:
        return len(self._need().features)

    @property
    def best_iteration_(self) -> int | None:
        return self._need().extra.get("bestIteration")

    def save_model(self, path: str) -> None:
        self._need().save(path)

    def load_model(self, path: str):
        self.forest = Forest.load(path)
        if self.forest.labels is not None:
            self.classes_ = self.forest.labels
        return self

    def save_xgboost(self, path: str) -> None:
        export.save_xgboost(self._need(), path)

    def save_onnx(self, path: str) -> None:
        export.save_onnx(self._need(), path)


class CoppiceRegressor(_Base):
    """Boosted trees for numbers; ``objective`` chooses the loss."""

    def __init__(self, **params):
        self.objective = params.pop("objective", "regression")
        super().__init__(**params)

    def score(self, df: DataFrame, label: str = "label") -> float:
        """R squared."""
        y, p = F.col(label).cast("double"), F.col("prediction")
        mean = df.agg(F.avg(y)).first()[0]
        a, b = predict(self._need(), df).agg(F.sum((y - p) * (y - p)), F.sum((y - mean) * (y - mean))).first()
        return 1 - a / b if b else 0.0


class CoppiceClassifier(_Base):
    """Boosted trees for 2 to 128 classes of any label type."""

    objective = "binary"

    def _prepare(self, df: DataFrame, label: str, params: Params) -> tuple[DataFrame, Params]:
        """Labels as codes by their sorted values."""
        if not getattr(self, "classes_", None) or self.forest is None:
            self.classes_ = [r[0] for r in df.select(label).where(F.col(label).isNotNull()).distinct().orderBy(label).limit(129).collect()]
        k = len(self.classes_)
        if not 2 <= k <= 128:
            raise DataError(f"a classifier needs 2 to 128 classes, there are {k if k < 129 else 'more'}")
        code = F.array_position(F.array(*[F.lit(c) for c in self.classes_]), F.col(label))
        own = df.withColumn(label, F.when(code > 0, code - 1).cast("double"))
        return own, params if k == 2 else params.but(objective="multiclass", num_class=k)

    def predict_proba(self, df: DataFrame) -> DataFrame:
        return predict(self._need(), df).drop("prediction")

    def score(self, df: DataFrame, label: str = "label") -> float:
        """Accuracy."""
        return predict(self._need(), df).agg(F.avg((F.col("prediction") == F.col(label)).cast("double"))).first()[0]
