"""Classifiers behind one protocol: fit on a table, add a prediction ``p``, name the features that matter."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col
from .summary import top_features


@dataclass
class FittedModel:
    model: Any
    features: list[str]

    def _assembled(self, df: DataFrame) -> DataFrame:
        names = [f"_f{i}" for i in range(len(self.features))]
        df = df.withColumns({n: col(f).cast("double") for n, f in zip(names, self.features, strict=True)})
        return VectorAssembler(inputCols=names, outputCol="_features").transform(df).drop(*names)

    def predict(self, df: DataFrame, name: str = "p") -> DataFrame:
        """``df`` with the probability of class 1."""
        columns = df.columns
        out = self.model.transform(self._assembled(df))
        return out.select(*[col(c) for c in columns], vector_to_array("probability")[1].alias(name))

    def important(self, spark, top: int = 20) -> DataFrame:
        """``feature, coefficient`` of the largest coefficients or importances."""
        inner = self.model.stages[-1] if isinstance(self.model, PipelineModel) else getattr(self.model, "bestModel", self.model)
        values = inner.coefficients if hasattr(inner, "coefficients") else inner.featureImportances
        rows = [(f, float(v)) for f, v in zip(self.features, values.toArray(), strict=True)]
        return top_features(spark.createDataFrame(rows, "feature string, coefficient double"), top)


    def save(self, path: str) -> None:
        """Write the inner model; ``load_model`` reads it with the features' names."""
        getattr(self.model, "bestModel", self.model).write().overwrite().save(path)


def load_model(model_class, path: str, features: list[str]) -> FittedModel:
    """Read a saved model of a class such as ``LogisticRegressionModel``."""
    return FittedModel(model_class.load(path), features)


def _fit(estimator, df: DataFrame, outcome: str, features: list[str], weight: str | None) -> FittedModel:
    shell = FittedModel(None, features)
    data = shell._assembled(df.withColumn("_label", col(outcome).cast("double")))
    kept = ["_features", "_label", *([weight] if weight else [])]
    shell.model = estimator.fit(data.select(*kept))
    return shell


def _common(weight: str | None) -> dict:
    return {"featuresCol": "_features", "labelCol": "_label"} | ({"weightCol": weight} if weight else {})


def _tuned(estimator, grid, folds: int, seed: int, parallelism: int = 4) -> CrossValidator:
    auc = BinaryClassificationEvaluator(labelCol="_label", rawPredictionCol="rawPrediction")
    return CrossValidator(estimator=estimator, estimatorParamMaps=grid, evaluator=auc, numFolds=folds, seed=seed, parallelism=parallelism)


def elastic_net(df: DataFrame, outcome: str, features: list[str], weight: str | None = None, alpha: float = 0.5, lambdas: tuple[float, ...] = (0.001, 0.003, 0.01, 0.03, 0.1), folds: int = 5, seed: int = 1) -> FittedModel:
    """Logistic regression with an elastic net, its strength chosen by cross-validated AUC."""
    lr = LogisticRegression(elasticNetParam=alpha, standardization=True, **_common(weight))
    return _fit(_tuned(lr, ParamGridBuilder().addGrid(lr.regParam, list(lambdas)).build(), folds, seed), df, outcome, features, weight)


def logistic(df: DataFrame, outcome: str, features: list[str], weight: str | None = None) -> FittedModel:
    return _fit(LogisticRegression(**_common(weight)), df, outcome, features, weight)


def tree(df: DataFrame, outcome: str, features: list[str], weight: str | None = None, depth: int = 3) -> FittedModel:
    return _fit(DecisionTreeClassifier(maxDepth=depth, **_common(weight)), df, outcome, features, weight)


def boosted(df: DataFrame, outcome: str, features: list[str], weight: str | None = None, trials: int = 4, folds: int = 3, seed: int = 1) -> FittedModel:
    """Gradient boosting with a random search over depth, step and subsample."""
    import random

    rng, gbt = random.Random(seed), GBTClassifier(seed=seed, maxIter=20, **_common(weight))
    grid = [{gbt.maxDepth: rng.choice([2, 3, 4, 5]), gbt.stepSize: rng.choice([0.05, 0.1, 0.3]), gbt.subsamplingRate: rng.choice([0.5, 0.8, 1.0])} for _ in range(trials)]
    return _fit(_tuned(gbt, grid, folds, seed), df, outcome, features, weight)


def network(df: DataFrame, outcome: str, features: list[str], hidden: int = 64, seed: int = 1) -> FittedModel:
    """One hidden layer; Spark's perceptron takes no weights."""
    return _fit(MultilayerPerceptronClassifier(layers=[len(features), hidden, 2], seed=seed, **_common(None)), df, outcome, features, None)


def auc(model: FittedModel, df: DataFrame, outcome: str) -> float:
    from .measures import auroc

    return auroc(model.predict(df, "_p_model"), col(outcome), F.col("_p_model")).first()["auroc"]
