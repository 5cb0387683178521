"""Supervised risk-tier model: engineered features and a cross-validated tree ensemble on MLlib."""

from __future__ import annotations

import math
from collections.abc import Callable
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import MinMaxScaler, OneHotEncoder, StringIndexer, TargetEncoder, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import min_max
from ..functions.timeparts import six_hour_bucket
from .radius import neighbour_counts
from .scale import materialize, skew_safe_join

BUCKETS = ("Night", "Morning", "Afternoon", "Evening")

DEPTHS = (4, 8)
# Training rows are dealt over all cores as long as a task has this many, and over more tasks once one would have more than the second number.
LEAST_TASK_ROWS, MOST_TASK_ROWS = 5_000, 250_000
# A forest keeps its rows with a count per tree while it grows, and the statistics of its nodes meet in the driver. So many forests grow side by side at
# most, and only as long as they keep no more rows than this in all.
SIDE_BY_SIDE, KEPT_ROWS = 3, 2_000_000


def station_ratio(incidents: DataFrame, as_of: Column, days: int = 30, baseline_days: int = 365) -> DataFrame:
    """log of (1 + last ``days`` count) over (1 + mean count of a span of that length in the year)."""
    age = F.datediff(as_of, "occurrence_datetime")
    now = F.count_if((age >= 0) & (age < days))
    year = F.count_if((age >= 0) & (age < baseline_days))
    return incidents.groupBy("police_station").agg(now.alias("_now"), (year * F.lit(days / baseline_days)).alias("_base")).select(
        "police_station", F.log((1.0 + F.col("_now")) / (1.0 + F.col("_base"))).alias("station_ratio")
    )


def target_encoding(df: DataFrame, category: str, target: Column, smoothing: float = 0.0) -> DataFrame:
    """Mean target per category, drawn toward the overall mean by ``smoothing`` pseudo-rows."""
    overall = df.agg(F.avg(target).alias("v")).scalar()
    return df.groupBy(category).agg(F.count(F.lit(1)).alias("_n"), F.avg(target).alias("_m")).select(
        category, ((F.col("_n") * F.col("_m") + F.lit(smoothing) * overall) / (F.col("_n") + F.lit(smoothing))).alias("mo_weight")
    )


def model_features(incidents: DataFrame, as_of: Column, category: str, target: Column, prior: Column, density: DataFrame | None = None) -> DataFrame:
    """The six engineered features per incident. ``density`` may hold precomputed 1 km counts."""
    near = neighbour_counts(incidents, 1000.0) if density is None else density
    ratios = station_ratio(incidents, as_of)
    codes = target_encoding(incidents, category, target)
    loss = incidents.agg(F.struct(F.min("property_loss").alias("lo"), F.max("property_loss").alias("hi")).alias("v")).scalar()
    placed = skew_safe_join(incidents, near.select("latitude", "longitude", F.col("neighbours").alias("spatial_density_1km")), ["latitude", "longitude"], "left")
    joined = placed.join(codes, category, "left").join(ratios, "police_station", "left")
    bucket = six_hour_bucket(F.col("occurrence_datetime"))
    return joined.withColumn("_l", loss).select(
        "incident_id", "station_ratio", "mo_weight", F.coalesce("spatial_density_1km", F.lit(0)).cast("bigint").alias("spatial_density_1km"),
        prior.cast("double").alias("prior_offender"), min_max(F.col("property_loss"), F.col("_l.lo"), F.col("_l.hi")).alias("property_loss_scaled"),
        bucket.alias("time_bucket"), target.cast("double").alias("target"),
    )


def raw_features(incidents: DataFrame, as_of: Column, category: str, prior: Column, target: Column, label: Column, density: DataFrame | None = None) -> DataFrame:
    """What the model's own stages start from: no column is made from the target or from the range of other rows' losses."""
    near = neighbour_counts(incidents, 1000.0) if density is None else density
    placed = skew_safe_join(incidents, near.select("latitude", "longitude", F.col("neighbours").alias("spatial_density_1km")), ["latitude", "longitude"], "left")
    return placed.join(station_ratio(incidents, as_of), "police_station", "left").select(
        "incident_id", "station_ratio", F.col(category).alias("category"), F.coalesce("spatial_density_1km", F.lit(0)).cast("double").alias("spatial_density_1km"),
        prior.cast("double").alias("prior_offender"), F.col("property_loss").cast("double").alias("property_loss"),
        six_hour_bucket(F.col("occurrence_datetime")).alias("time_bucket"), target.cast("double").alias("target"), label.alias("label"),
    )


def held_out(key: Column, share: int = 20) -> Column:
    """Whether a row is kept from training: by its key alone, so neither order nor other columns move it."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint") % 100 < share


def model_stages(forest: RandomForestClassifier, smoothing: float = 10.0) -> list:
    """Encoders and scaler are stages, so every fold fits them on its own training rows. The share of targets per category is smoothed toward that of all."""
    index = {"handleInvalid": "keep", "stringOrderType": "alphabetAsc"}
    return [
        StringIndexer(inputCol="label", outputCol="_label", **index),
        StringIndexer(inputCol="category", outputCol="_category", **index),
        TargetEncoder(inputCol="_category", outputCol="mo_weight", labelCol="target", targetType="continuous", smoothing=smoothing, handleInvalid="keep"),
        VectorAssembler(inputCols=["property_loss"], outputCol="_loss", handleInvalid="keep"),
        MinMaxScaler(inputCol="_loss", outputCol="_loss_scaled"),
        StringIndexer(inputCol="time_bucket", outputCol="_bucket", **index),
        OneHotEncoder(inputCol="_bucket", outputCol="_bucket_hot"),
        VectorAssembler(inputCols=["station_ratio", "mo_weight", "spatial_density_1km", "prior_offender", "_loss_scaled", "_bucket_hot"], outputCol="_x", handleInvalid="keep"),
        forest,
    ]


def _tasks(rows: int, cores: int) -> int:
    """Parts that training rows are dealt into."""
    return max(1, min(cores, math.ceil(rows / LEAST_TASK_ROWS)), math.ceil(rows / MOST_TASK_ROWS))


def _side_by_side(spark: SparkSession, jobs: list[Callable], threads: int) -> list:
    """Results of the jobs in their order."""
    with ThreadPool(threads) as pool:
        return pool.map(lambda job: job(), [inheritable_thread_target(spark)(job) for job in jobs], chunksize=1)


def train_tier_model(rows: DataFrame, folds: int = 5, seed: int = 42, trees: int = 50, key: str = "incident_id") -> tuple[PipelineModel, DataFrame]:
    """Cross-validation on the training part of ``raw_features``; the model and (metric, value) on the held-out part, read once.

    The encoders of a fold do not depend on the depth of its trees: they are fitted and its rows encoded once. Folds and depths are independent of each
    other and grow side by side.
    """
    spark = rows.sparkSession
    marked = materialize(rows.withColumns({"_held": held_out(F.col(key)), "_fold": F.floor(F.rand(seed) * folds).cast("int")}))
    sizes = {r["_held"]: r["count"] for r in marked.groupBy("_held").count().collect()}
    learnt = sizes.get(False, 0)
    train = materialize(marked.where("not _held").drop("_held").repartition(_tasks(learnt, spark.sparkContext.defaultParallelism)))
    test = marked.where("_held").drop("_held", "_fold")
    *encoders, forest = model_stages(RandomForestClassifier(labelCol="_label", featuresCol="_x", seed=seed, numTrees=trees))
    f1 = MulticlassClassificationEvaluator(labelCol="_label", metricName="f1")
    threads = max(1, min(SIDE_BY_SIDE, KEPT_ROWS // max(1, learnt)))

    def encode(fold: int | None) -> tuple[PipelineModel, DataFrame]:
        """Encoders of a fold's training rows, or of all, and all rows encoded by them."""
        model = Pipeline(stages=encoders).fit(train if fold is None else train.where(F.col("_fold") != fold))
        return model, materialize(model.transform(train).select("_fold", "_label", "_x"))

    def grow(encoded: DataFrame, depth: int):
        return forest.copy({forest.maxDepth: depth}).fit(encoded)

    def judge(encoded: DataFrame, fold: int, depth: int) -> float:
        return f1.evaluate(grow(encoded.where(F.col("_fold") != fold), depth).transform(encoded.where(F.col("_fold") == fold)))

    *by_fold, (encoder, every) = _side_by_side(spark, [lambda i=i: encode(i) for i in [*range(folds), None]], threads)
    tried = [(depth, i) for depth in sorted(DEPTHS, reverse=True) for i in range(folds)]  # the longest first
    values = dict(zip(tried, _side_by_side(spark, [lambda d=d, i=i: judge(by_fold[i][1], i, d) for d, i in tried], threads)))
    means = [sum(values[depth, i] for i in range(folds)) / folds for depth in DEPTHS]
    best = PipelineModel(stages=[*encoder.stages, grow(every, DEPTHS[means.index(max(means))])])
    scored = materialize(best.transform(test).select("_label", "probability", "prediction"))
    values = {"train_rows": float(learnt), "held_out_rows": float(sizes.get(True, 0)), "validation_f1": float(max(means)), "f1": f1.evaluate(scored)}
    if len(best.stages[0].labels) == 2:
        second = scored.select("_label", vector_to_array("probability")[1].alias("score"))  # the third class is that of unknown labels
        values["auc"] = BinaryClassificationEvaluator(labelCol="_label", rawPredictionCol="score").evaluate(second)
    metrics = spark.createDataFrame(list(values.items()), "metric string, value double")
    return best, metrics
