"""Classifiers and the reconstruction detector, on Spark MLlib."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from .measures import MICRO, STATS
from .scoring import with_weight

PART_ROWS = 50_000


def _prepare(win: DataFrame) -> DataFrame:
    return with_weight(win).withColumn("label", F.col("y").cast("double"))


def _even(win: DataFrame) -> DataFrame:
    """Training rows in parts of about ``PART_ROWS``: every level of every tree is a job over all parts."""
    return _prepare(win).repartition(max(1, -(-win.count() // PART_ROWS)))


def _front(columns: list[str], scale: bool) -> list:
    stages = [VectorAssembler(inputCols=columns, outputCol="raw" if scale else "features")]
    if scale:
        stages.append(StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True))
    return stages


def fit_logistic(win: DataFrame, columns: list[str], max_iter: int = 2000) -> PipelineModel:
    """Balanced logistic regression on standardised measures.

    Strength C = 1 is a penalty of 1/(2n) per unit of weight here; balanced
    weights sum to n.
    """
    data = _prepare(win)
    n = win.count()
    lr = LogisticRegression(weightCol="weight", maxIter=max_iter, regParam=1.0 / max(n, 1), standardization=False)
    return Pipeline(stages=[*_front(columns, True), lr]).fit(data)


def fit_microstructure(win: DataFrame) -> PipelineModel:
    return fit_logistic(win, MICRO, 2000)


def fit_stat_logistic(win: DataFrame) -> PipelineModel:
    return fit_logistic(win, STATS, 3000)


def fit_forest(win: DataFrame, trees: int = 300, depth: int = 30, seed: int = 42) -> PipelineModel:
    """Balanced random forest on the window statistics; 30 levels are the most that MLlib grows."""
    rf = RandomForestClassifier(weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed, maxMemoryInMB=1024)
    return Pipeline(stages=[*_front(STATS, False), rf]).fit(_even(win))


def fit_boosted(win: DataFrame, rounds: int = 400, depth: int = 6, rate: float = 0.05, seed: int = 42) -> PipelineModel:
    """Boosted trees with row and column sampling; positives weigh n_neg / n_pos.

    Balanced weights have the same ratio. Lineage is cut every ten rounds
    when a checkpoint folder is set.
    """
    gbt = GBTClassifier(
        weightCol="weight", maxIter=rounds, maxDepth=depth, stepSize=rate,
        subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=seed,
    )
    return Pipeline(stages=[*_front(STATS, False), gbt]).fit(_even(win))


def score_model(model: PipelineModel, win: DataFrame) -> DataFrame:
    """Adds ``score``, the probability of an event."""
    out = model.transform(win).withColumn("score", vector_to_array("probability")[1])
    return out.select(*win.columns, "score")


def fit_reconstruction(pool: DataFrame, components: int = 10) -> PipelineModel:
    """A linear basis of unlabelled windows' statistics."""
    pca = PCA(k=components, inputCol="features", outputCol="projected")
    return Pipeline(stages=[*_front(STATS, True), pca]).fit(pool)


def score_reconstruction(model: PipelineModel, win: DataFrame) -> DataFrame:
    """Adds ``score``: mean squared error of rebuilding the window from the basis.

    The basis is orthonormal, so the squared error is |x|^2 - |projection|^2;
    nothing is projected back.
    """
    out = model.transform(win)
    sq = lambda c: F.aggregate(vector_to_array(c), F.lit(0.0), lambda s, v: s + v * v)
    err = F.greatest(sq("features") - sq("projected"), F.lit(0.0)) / F.lit(float(len(STATS)))
    return out.withColumn("score", err).select(*win.columns, "score")
