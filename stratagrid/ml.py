"""Gradient-boosted trees over feature tables, in two stages, with Spark's own learners."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplit, TrainValidationSplitModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _features(features: list[str]) -> list:
    filled = [f"_f_{f}" for f in features]
    return [Imputer(inputCols=features, outputCols=filled, strategy="median"), VectorAssembler(inputCols=filled, outputCol="features")]


def soft_rows(df: DataFrame, label: str, weight: str | None = None) -> DataFrame:
    """Two weighted rows for each soft label p: class 1 with weight p and class 0 with weight 1 - p."""
    w = F.col(weight) if weight else F.lit(1.0)
    parts = F.array(F.struct(F.lit(1.0).alias("y"), (w * F.col(label)).alias("w")), F.struct(F.lit(0.0).alias("y"), (w * (1 - F.col(label))).alias("w")))
    return df.withColumn("_p", F.explode(parts)).where("_p.w > 0").withColumns({"_label": F.col("_p.y"), "_weight": F.col("_p.w")}).drop("_p")


def fit_classifier(df: DataFrame, features: list[str], label: str, weight: str | None = None, soft: bool = False, positive_weight: float = 1.0, **params) -> PipelineModel:
    """Binary classifier; soft labels in [0, 1] if soft. positive_weight multiplies the weight of class 1."""
    rows = soft_rows(df, label, weight) if soft else df.withColumns({"_label": F.col(label).cast("double"), "_weight": F.col(weight).cast("double") if weight else F.lit(1.0)})
    rows = rows.withColumn("_weight", F.when(F.col("_label") == 1, F.col("_weight") * positive_weight).otherwise(F.col("_weight")))
    return Pipeline(stages=[*_features(features), GBTClassifier(labelCol="_label", weightCol="_weight", **params)]).fit(rows)


def fit_regressor(df: DataFrame, features: list[str], label: str, weight: str | None = None, **params) -> PipelineModel:
    rows = df.withColumns({"_label": F.col(label).cast("double"), "_weight": F.col(weight).cast("double") if weight else F.lit(1.0)}).where("_label IS NOT NULL")
    return Pipeline(stages=[*_features(features), GBTRegressor(labelCol="_label", weightCol="_weight", **params)]).fit(rows)


def predict(model: PipelineModel, df: DataFrame, name: str = "prediction", threshold: float = 0.5) -> DataFrame:
    """df with `probability` and a 0/1 column of that name, or with the regression's value."""
    made = model.transform(df)
    if "probability" in made.columns:
        p = vector_to_array("probability")[1]
        return made.select(*(made[c] for c in df.columns), p.alias("probability"), (p >= threshold).cast("int").alias(name))
    return made.select(*(made[c] for c in df.columns), F.col("prediction").alias(name))


def importance(model: PipelineModel, features: list[str]) -> DataFrame:
    """(feature, importance), the highest first."""
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    rows = list(zip(features, model.stages[-1].featureImportances.toArray().tolist(), strict=True))
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.col("importance").desc(), "feature")


def tune_classifier(df: DataFrame, features: list[str], label: str, grid: dict[str, list], metric: str = "areaUnderPR", train_ratio: float = 0.8, seed: int = 42) -> TrainValidationSplitModel:
    """Best of a grid of settings by a validation split; features are assembled once."""
    gbt = GBTClassifier(labelCol="_label", seed=seed)
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(getattr(gbt, name), values)
    rows = Pipeline(stages=_features(features)).fit(df).transform(df).withColumn("_label", F.col(label).cast("double")).select("features", "_label").persist()
    try:
        return TrainValidationSplit(estimator=gbt, estimatorParamMaps=builder.build(), evaluator=BinaryClassificationEvaluator(labelCol="_label", metricName=metric), trainRatio=train_ratio, seed=seed).fit(rows)
    finally:
        rows.unpersist()
