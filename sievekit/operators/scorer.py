"""Pluggable batch scorers (M1).

A scorer turns texts into a long score table ``(content_id, label_idx, label,
logit)``. Two implementations:

* ``SparkMLScorer``: a Spark ML pipeline (tokenizer -> hashing TF -> logistic
  regression) trained on the ``labels`` table; training and scoring are
  distributed Spark jobs, the whole text is featurised (no truncation).
* ``OnnxScorer``: any ONNX sequence classifier run per Arrow batch in
  ``mapInPandas``; the session is created once per Python worker. Optional:
  it needs a model file readable by executors and a tokenizer callable.
"""

from __future__ import annotations

from typing import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T



class SparkMLScorer:
    def __init__(self, labels: list[str], num_features: int = 1 << 18, reg_param: float = 0.01, max_iter: int = 50):
        self.labels = labels
        self.num_features = num_features
        self.reg_param = reg_param
        self.max_iter = max_iter
        self.model = None

    def _pipeline(self):
        from pyspark.ml import Pipeline
        from pyspark.ml.classification import LogisticRegression
        from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer

        return Pipeline(
            stages=[
                RegexTokenizer(inputCol="text", outputCol="tokens", pattern="\\W+", toLowercase=True),
                HashingTF(inputCol="tokens", outputCol="tf", numFeatures=self.num_features),
                IDF(inputCol="tf", outputCol="features"),
                LogisticRegression(featuresCol="features", labelCol="label", regParam=self.reg_param, maxIter=self.max_iter),
            ]
        )

    def fit(self, texts: DataFrame, labelled: DataFrame, id_col: str, label_col: str) -> "SparkMLScorer":
        """Train on texts joined to their labels; Spark picks the join by the tables' sizes."""
        train = texts.select(F.col(id_col), "text").join(labelled.select(F.col(id_col), F.col(label_col).cast("double").alias("label")), id_col)
        self.model = self._pipeline().fit(train)
        return self

    def score(self, texts: DataFrame, id_col: str) -> DataFrame:
        """(content_id, label_idx, label, logit): log-odds per class from the fitted model."""
        if self.model is None:
            raise RuntimeError("fit() first")
        from pyspark.ml.functions import vector_to_array

        pred = self.model.transform(texts.select(F.col(id_col).alias("content_id"), "text"))
        raw = pred.select("content_id", vector_to_array("rawPrediction").alias("raw"))
        ex = raw.select("content_id", F.posexplode("raw").alias("label_idx", "logit"))
        names = F.array(*[F.lit(x) for x in self.labels])
        return ex.select("content_id", F.col("label_idx").cast("int").alias("label_idx"), F.element_at(names, F.col("label_idx") + 1).alias("label"), "logit")


class OnnxScorer:
    """Sequence classifier in ONNX, one session per Python worker, Arrow batches in and out."""

    def __init__(self, model_path: str, labels: list[str], encode: Callable[[list[str]], dict], output_name: str | None = None):
        self.model_path = model_path
        self.labels = labels
        self.encode = encode  # texts -> dict of numpy inputs for the session
        self.output_name = output_name

    def score(self, texts: DataFrame, id_col: str) -> DataFrame:
        model_path, labels, encode, out_name = self.model_path, self.labels, self.encode, self.output_name
        schema = T.StructType([T.StructField("content_id", texts.schema[id_col].dataType), T.StructField("logits", T.ArrayType(T.DoubleType()))])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            import onnxruntime as ort  # imported on the worker

            sess = ort.InferenceSession(model_path)
            name = out_name or sess.get_outputs()[0].name
            for b in batches:
                out = sess.run([name], encode(list(b["text"])))[0]
                yield pd.DataFrame({"content_id": b[id_col].values, "logits": [list(map(float, r)) for r in out]})

        scored = texts.select(id_col, "text").mapInPandas(run, schema)
        ex = scored.select("content_id", F.posexplode("logits").alias("label_idx", "logit"))
        names = F.array(*[F.lit(x) for x in labels])
        return ex.select("content_id", F.col("label_idx").cast("int").alias("label_idx"), F.element_at(names, F.col("label_idx") + 1).alias("label"), "logit")
