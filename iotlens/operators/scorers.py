"""Score extension point: anything that adds ``model_score`` to rows with features."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Protocol

from pyspark.ml import PipelineModel
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from iotlens.functions.numeric import score_from_outputs
from iotlens.operators import detect, models
from iotlens.schemas import FEATURES


class Scorer(Protocol):
    def score(self, rows: DataFrame) -> DataFrame: ...


class HeuristicScorer:
    def score(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("model_score", detect.heuristic_score())


class ModelScorer:
    def __init__(self, fitted: PipelineModel, mode: str = "not_benign"):
        self.fitted, self.mode = fitted, mode

    def score(self, rows: DataFrame) -> DataFrame:
        return models.score(self.fitted, rows, self.mode)


class BatchScorer:
    """An external model: ``make`` returns a function from a (rows x features) array to outputs."""

    def __init__(self, make: Callable, features: Sequence[str] = FEATURES, batch_size: int = 4096):
        self.make, self.features, self.batch_size = make, list(features), batch_size

    def score(self, rows: DataFrame) -> DataFrame:
        outputs = predict_batch_udf(
            self.make, return_type=T.ArrayType(T.DoubleType()), batch_size=self.batch_size, input_tensor_shapes=[[len(self.features)]]
        )
        vector = F.array(*[F.col(f) for f in self.features])
        return rows.withColumn("model_score", score_from_outputs(outputs(vector)))
