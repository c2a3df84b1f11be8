"""Classifiers over flow features with MLlib, and exact attributions of linear ones."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, LogisticRegressionModel, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """``df`` with ``weight``: rows over (classes x rows of the class), so that classes weigh the same."""
    counts = df.groupBy(label).agg(F.count("*").alias("_n"))
    totals = counts.agg(F.sum("_n").alias("_all"), F.count("*").alias("_k"))
    per = counts.crossJoin(totals).select(label, (F.col("_all") / (F.col("_k") * F.col("_n"))).alias("weight"))
    return df.join(F.broadcast(per), label)


def positive_weight(df: DataFrame, label: str) -> DataFrame:
    """One row: negatives over positives, null without positives."""
    return df.agg(F.try_divide(F.count_if(F.col(label) == 0).cast("double"), F.count_if(F.col(label) == 1).cast("double")).alias("scale_pos_weight"))


def train(df: DataFrame, features: list[str], label: str, kind: str = "forest", seed: int = 42, **params) -> PipelineModel:
    """A fitted pipeline of ``kind`` forest, boosted or linear; rows weigh by class."""
    assembler = VectorAssembler(inputCols=features, outputCol="raw_features" if kind == "linear" else "features", handleInvalid="skip")
    common = {"featuresCol": "features", "labelCol": label, "weightCol": "weight"}
    if kind == "forest":
        stages = [assembler, RandomForestClassifier(**common, seed=seed, **({"numTrees": 100, "maxDepth": 10} | params))]
    elif kind == "boosted":
        stages = [assembler, GBTClassifier(**common, seed=seed, **({"maxIter": 50, "maxDepth": 5} | params))]
    elif kind == "linear":
        stages = [assembler, StandardScaler(inputCol="raw_features", outputCol="features", withMean=True), LogisticRegression(**common, **params)]
    else:
        raise ValueError(f"unknown kind {kind}")
    return Pipeline(stages=stages).fit(class_weights(df, label))


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """``df`` with prediction, score (of class 1) and confidence (of the predicted class)."""
    out = model.transform(df).withColumn("score", vector_to_array("probability")[1])
    return out.withColumn("confidence", F.when(F.col("prediction") == 1, F.col("score")).otherwise(1 - F.col("score"))).withColumn("prediction", F.col("prediction").cast("int"))


def linear_attributions(model: PipelineModel, df: DataFrame, features: list[str], top: int = 10) -> DataFrame:
    """``df`` with ``top_features``: (feature, value, contribution) with the greatest contributions to the margin.

    The contribution of a feature is its coefficient times its standardised value: exact for a linear model, and
    the sum over all features is the margin without the intercept.
    """
    lr: LogisticRegressionModel = model.stages[-1]
    scaler = model.stages[-2]
    parts = []
    for name, c, m, s in zip(features, lr.coefficients.toArray(), scaler.mean.toArray(), scaler.std.toArray()):
        col = F.col("`" + name + "`")
        parts.append(F.struct(F.lit(name).alias("feature"), col.cast("double").alias("value"), ((col - float(m)) * (float(c / s) if s else 0.0)).alias("contribution")))
    order = lambda a, b: F.when(F.abs(a["contribution"]) > F.abs(b["contribution"]), -1).when(F.abs(a["contribution"]) < F.abs(b["contribution"]), 1).when(a["feature"] < b["feature"], -1).otherwise(1)
    return df.withColumn("top_features", F.slice(F.array_sort(F.array(*parts), order), 1, top))


def mean_attributions(df: DataFrame, k: int = 20) -> DataFrame:
    """(feature, mean_abs, rank): the features with the greatest mean absolute contribution."""
    per = df.select(F.explode("top_features").alias("f")).groupBy(F.col("f.feature").alias("feature")).agg(F.avg(F.abs("f.contribution")).alias("mean_abs"))
    return per.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean_abs"), "feature"))).where(F.col("rank") <= k)


def explained_samples(df: DataFrame, truth: str, key: str, n: int = 10) -> DataFrame:
    """``n`` rightly predicted rows of each class, by key."""
    w = Window.partitionBy(truth).orderBy(key)
    return df.where(F.col(truth) == F.col("prediction")).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")
