"""A binary classifier for imbalanced data: features, training, evaluation, scoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import resample

# Fixed values of the model: width of its dense layer, training rounds, decision threshold,
# and the minority / majority ratios that the two resampling steps aim at.
HIDDEN = 128
ROUNDS = 15
THRESHOLD = 0.28
OVER, UNDER = 0.4, 0.6
# End of the fixed values.
LARGE_PART = 50_000  # training rows of a partition above which an uneven share counts


def feature_columns(columns: Sequence[str], identity: str, label: str | None = None) -> list[str]:
    """Every column but the identity and the label, in order."""
    return [c for c in columns if c not in (identity, label)]


def with_features(df: DataFrame, columns: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """The kept columns and a vector ``features`` of the given numeric columns."""
    assembler = VectorAssembler(inputCols=list(columns), outputCol="features",
                                handleInvalid="error")
    return assembler.transform(df).select(*keep, "features")


def with_array_features(df: DataFrame, column: str, keep: Sequence[str]) -> DataFrame:
    values = F.col(column).cast("array<double>")
    return df.select(*keep, array_to_vector(values).alias("features"))


def rebalance_classes(train: DataFrame, identity: str, label: str, seed: str = "42") -> DataFrame:
    """Oversample the minority, then undersample the majority. Only ever for training rows:
    resampling ahead of the split would put copies of test rows into training."""
    return resample(train, identity, label, OVER, UNDER, seed)


def train(rows: DataFrame, label: str, hidden: int = HIDDEN, rounds: int = ROUNDS,
          seed: int = 42) -> PipelineModel:
    """Fit scaler and network on ``features`` and a 0/1 ``label``.

    Gradients are summed over the partitions in a tree; the driver holds the weights only. A round
    costs the same for every row, but the partitions of drawn copies and of files have been cut by
    bytes; where one of them would hold up the others, rows are dealt evenly.
    """
    tasks = 2 * rows.sparkSession.sparkContext.defaultParallelism
    rows = given = rows.select("features", F.col(label).cast("double").alias("_label")).persist()
    largest, total = rows.groupBy(F.spark_partition_id().alias("part")).agg(
        F.count(F.lit(1)).alias("rows")).agg(F.max("rows"), F.sum("rows")).first()
    if (largest or 0) > max(LARGE_PART, (total or 0) / tasks):
        rows = given.repartition(tasks).persist()
    width = rows.select("features").head()[0].size
    scaler = StandardScaler(inputCol="features", outputCol="_scaled", withMean=True)
    network = MultilayerPerceptronClassifier(
        featuresCol="_scaled", labelCol="_label", layers=[width, hidden, 2],
        maxIter=rounds, seed=seed)
    try:
        return Pipeline(stages=[scaler, network]).fit(rows)
    finally:
        rows.unpersist()
        given.unpersist()


def score(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """``rows`` with ``score``, the probability of class 1."""
    scored = model.transform(rows)
    return scored.select(*rows.columns, vector_to_array("probability")[1].alias("score"))


def decide(scored: DataFrame, identity: str, output: str, threshold: float = THRESHOLD,
           column: str = "score") -> DataFrame:
    """Identity and 1 where the score reaches the threshold, else 0."""
    return scored.select(
        identity, F.when(F.col(column) >= threshold, 1).otherwise(0).alias(output))


def evaluate(scored: DataFrame, label: str, threshold: float = 0.5) -> DataFrame:
    """One row: rows, those of class 1, accuracy at ``threshold``, and the area under the
    precision-recall curve, which accuracy on imbalanced classes does not show."""
    area = BinaryClassificationEvaluator(
        rawPredictionCol="score", labelCol="_label", metricName="areaUnderPR",
        numBins=0,  # exact: a point per distinct score
    ).evaluate(scored.select("score", F.col(label).cast("double").alias("_label")))
    hit = (F.col("score") >= threshold).cast("int") == F.col(label).cast("int")
    return scored.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col(label) == 1).alias("n_positive"),
        F.avg(hit.cast("double")).alias("accuracy"),
        F.lit(float(area)).alias("area_under_pr"),
    )


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
