"""Scoring and training pipelines (ML15-17, UDF1-5, SNK1).

User models run through ``predict_batch_udf`` (Arrow batches of a fixed
size, the model built once per Python worker); softmax / arg-max / label
lookup / confidence are JVM higher-order functions on the returned arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statfold.functions import arrays


def weighted_multiclass(train: DataFrame, vec: str, label: str, weights: DataFrame | None = None,
                        reg: float = 0.0):
    """ML15 (re-aimed): multinomial logistic regression on numeric vectors with class weights
    (``weights`` = (label, weight) table, joined on the label)."""
    data = train
    if weights is not None:
        data = data.join(F.broadcast(weights.select(label, "weight")), label, "left").fillna(1.0, ["weight"])
    data = data.withColumn("_features", array_to_vector(F.col(vec).cast("array<double>")))
    lr = LogisticRegression(featuresCol="_features", labelCol=label, family="multinomial", regParam=reg, maxIter=200)
    if weights is not None:
        lr = lr.setWeightCol("weight")
    return lr.fit(data)


def linear_softmax_udf(coef: np.ndarray, intercept: np.ndarray, batch_size: int = 1024):
    """UDF3 / ML16: a user model as a batch predictor returning class logits."""
    w, b = np.asarray(coef, dtype=np.float64), np.asarray(intercept, dtype=np.float64)

    def make_predict_fn():
        def predict(x: np.ndarray) -> np.ndarray:
            return x @ w.T + b
        return predict

    return predict_batch_udf(make_predict_fn, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size,
                             input_tensor_shapes=[[w.shape[1]]])


def score_batches(df: DataFrame, vec: str, predictor, labels: dict) -> DataFrame:
    """ML16: logits -> softmax -> arg-max -> label name and confidence."""
    scored = df.withColumn("_logits", predictor(F.col(vec).cast("array<double>")))
    scored = arrays.with_softmax(scored, "_logits", "probabilities").drop("_logits")
    pairs: list[Column] = []
    for k, v in labels.items():
        pairs += [F.lit(k), F.lit(v)]
    cls = arrays.argmax("probabilities")
    return (scored.withColumn("predicted_class", cls)
            .withColumn("predicted_label", F.try_element_at(F.create_map(*pairs), cls))
            .withColumn("confidence", F.array_max("probabilities")))


def text_classifier(train: DataFrame, text: str, label: str, features: int = 1 << 18, reg: float = 0.0) -> PipelineModel:
    """ML17 (re-aimed): tokenise -> hashed term counts -> IDF -> logistic regression."""
    stages = [RegexTokenizer(inputCol=text, outputCol="_tok", pattern=r"[^\p{L}\p{N}]+", toLowercase=True),
              HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=features),
              IDF(inputCol="_tf", outputCol="_features"),
              LogisticRegression(featuresCol="_features", labelCol=label, regParam=reg, maxIter=100)]
    return Pipeline(stages=stages).fit(train)


def save_model(model, path: str) -> None:
    """SNK1."""
    model.write().overwrite().save(path)


def load_pipeline(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def batched_map(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """UDF1: ``dataset.map(fn, batched=True)`` = ``mapInPandas`` over Arrow batches."""
    def run(it):
        for pdf in it:
            yield fn(pdf)
    return df.mapInPandas(run, schema)


def pie_labels(counts: DataFrame, n: str = "n", share: str = "share") -> DataFrame:
    """UDF5: ``'<n> (<pct>%)'`` labels from a share table."""
    return counts.withColumn("pie_label", F.format_string("%d (%.1f%%)", F.col(n), F.col(share) * 100))


def assembled(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol="features").transform(df)


def probabilities(df: DataFrame, col: str = "probability") -> Column:
    return vector_to_array(col)
