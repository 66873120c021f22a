"""Features, delay models and scoring with Spark ML."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from headway.operators import boosting
from headway.operators.baseline import regression_metrics
from headway.operators.clean import FEATURES

def encoder(train: DataFrame, name: str = "route_short_name") -> DataFrame:
    """``name, route_encoded``: sorted distinct labels from 0.

    Labels are numbered within those of equal first letters and shifted by the number of labels before these.
    """
    labels = train.select(name).na.drop().distinct().withColumn("__first", F.substring(name, 1, 4))
    counts = labels.groupBy("__first").agg(F.count("*").alias("n"))
    before = Window.orderBy("__first").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("__first").orderBy(name)) - 1
    return labels.withColumn("__at", inside).join(starts, "__first").select(name, (F.col("start") + F.col("__at")).cast("double").alias("route_encoded"))


def encode_route(df: DataFrame, codes: DataFrame, strict: bool = True) -> DataFrame:
    """Add ``route_encoded``; an unknown label is an error, or null if not strict."""
    out = df.join(codes, "route_short_name", "left")
    if strict:
        code = F.when(F.col("route_encoded").isNull(), F.raise_error(F.concat(F.lit("unknown route: "), "route_short_name")).cast("double")).otherwise(F.col("route_encoded"))
        out = out.withColumn("route_encoded", code)
    return out


def encode_route_fallback(name):
    """Without an encoder: the name's whole number, else 0."""
    return F.coalesce(F.trim(name).try_cast("bigint"), F.lit(0)).cast("double")


def assemble_features(df: DataFrame) -> DataFrame:
    """The seven features as doubles, missing ones 0."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in FEATURES})


def _pipeline(stage) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), stage])


def train_random_forest(train: DataFrame, trees: int = 30, depth: int = 10, seed: int = 42) -> PipelineModel:
    return _pipeline(RandomForestRegressor(labelCol="delay_minutes", numTrees=trees, maxDepth=depth, minInstancesPerNode=2, featureSubsetStrategy="sqrt", seed=seed)).fit(train)


def train_boosted_trees(train: DataFrame, rounds: int = 50, depth: int = 6, seed: int = 42) -> PipelineModel:
    """Each tree on four fifths of the rows and five of the seven features."""
    trees = boosting.fit(train, FEATURES, "delay_minutes", rounds, depth, seed=seed)
    return PipelineModel([VectorAssembler(inputCols=FEATURES, outputCol="features"), trees])


def evaluate(model: PipelineModel, rows: DataFrame) -> dict[str, float]:
    return regression_metrics(model.transform(rows), "delay_minutes", "prediction").first().asDict()


def select_best(forest: PipelineModel, boosted: PipelineModel, val: DataFrame) -> tuple[str, PipelineModel]:
    """The one with the lower mean absolute error; boosting if equal."""
    a, b = evaluate(forest, val)["mae"], evaluate(boosted, val)["mae"]
    return ("RandomForest", forest) if a is not None and a < b else ("GradientBoosting", boosted)


def feature_importance(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """``feature, label, importance``, the least important first."""
    values = next(s for s in model.stages if hasattr(s, "featureImportances")).featureImportances.toArray()
    rows = [(f, f.replace("_", " ").title(), float(v)) for f, v in zip(FEATURES, values, strict=True)]
    return spark.createDataFrame(rows, "feature string, label string, importance double").orderBy("importance", "feature")


class RouteCodes(Transformer, MLWritable, MLReadable):
    """Adds ``route_encoded``, ``status`` (``route_not_found`` where a route has no code) and the features without gaps; its codes are saved with it."""

    def __init__(self, codes: DataFrame | None = None) -> None:
        super().__init__()
        self.codes = codes

    def _transform(self, dataset: DataFrame) -> DataFrame:
        known = F.col("route_encoded").isNotNull()
        coded = encode_route(dataset, self.codes, strict=False)
        return assemble_features(coded.withColumn("status", F.when(known, "ok").otherwise("route_not_found")))

    def write(self) -> MLWriter:
        return _CodesWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _CodesReader()


class _CodesWriter(MLWriter):
    def __init__(self, instance: RouteCodes) -> None:
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance.codes.write.parquet(f"{path}/codes")


class _CodesReader(MLReader):
    def load(self, path: str) -> RouteCodes:
        facts = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        out = RouteCodes(self.sparkSession.read.parquet(f"{path}/codes"))
        out._resetUid(facts["uid"])
        return out


class KnownOnly(Transformer, MLWritable, MLReadable):
    """Takes the prediction from rows whose status isn't ``ok``."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn("prediction", F.when(F.col("status") == "ok", F.col("prediction"))).drop("features")

    def write(self) -> MLWriter:
        return DefaultParamsWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return DefaultParamsReader(cls)


def artefact(model: PipelineModel, codes: DataFrame) -> PipelineModel:
    """All that turns visits or stops into delays, as one pipeline: codes, features, the model, and what becomes of unknown routes."""
    return PipelineModel([RouteCodes(codes), *model.stages, KnownOnly()])


def score_batch(rows: DataFrame, codes: DataFrame, model: PipelineModel) -> DataFrame:
    """Add ``prediction`` and ``status``: rows of unknown routes get none, ``route_not_found``."""
    return artefact(model, codes).transform(rows)


def save_model(model: PipelineModel, codes: DataFrame, path: str) -> None:
    """The artefact, so that codes and model can't drift apart."""
    artefact(model, codes).write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    """What ``save_model`` has saved: its ``transform`` gives ``prediction`` and ``status``."""
    return PipelineModel.load(path)
