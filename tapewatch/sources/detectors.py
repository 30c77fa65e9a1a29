"""Stored detectors: a fitted pipeline with its scaler stages, its threshold and what it reads."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.models import score_model

DEFAULT_THRESHOLD = 0.5


@dataclass(frozen=True)
class Detector:
    name: str
    pipeline: PipelineModel
    saved_threshold: float | None

    def score(self, win: DataFrame) -> DataFrame:
        """Adds ``score`` to window measures, of a table or of a micro-batch."""
        return score_model(self.pipeline, win)

    def threshold(self, configured: float | None = None) -> float:
        """The configured threshold, else the one saved with the model, else 0.5."""
        for t in (configured, self.saved_threshold):
            if t is not None:
                return float(t)
        return DEFAULT_THRESHOLD


def save_detector(root: str, name: str, pipeline: PipelineModel, threshold: float | None, spark: SparkSession) -> None:
    """Replace what is stored under ``root/name``; the facts are written last, so a half-written model is never read."""
    pipeline.write().overwrite().save(f"{root}/{name}/pipeline")
    facts = spark.createDataFrame([(name, threshold)], "name string, threshold double")
    facts.coalesce(1).write.mode("overwrite").json(f"{root}/{name}/facts")


def load_detector(spark: SparkSession, root: str, name: str) -> Detector:
    facts = spark.read.schema("name string, threshold double").json(f"{root}/{name}/facts").first()
    return Detector(facts["name"], PipelineModel.load(f"{root}/{name}/pipeline"), facts["threshold"])


def stored_detectors(spark: SparkSession, root: str) -> DataFrame:
    """(name, threshold) of every stored detector."""
    return spark.read.schema("name string, threshold double").json(f"{root}/*/facts").select("name", F.col("threshold"))
