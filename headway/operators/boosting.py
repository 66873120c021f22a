"""Gradient boosting over Spark's regression trees, with rows and columns drawn anew for each tree.

Each round fits a tree to what the trees before leave of the label, on a hashed share of the rows and a fixed number of columns,
drawn once for the tree: the others are zero in what it sees, so it can't split on them, and its numbering of columns is that of
the whole vector, to which it is applied later.  Rows are drawn by a hash of the row, the seed and the round, so the same table gives
the same model however it is partitioned.
"""

from __future__ import annotations

import random

from pyspark import SparkContext
from pyspark.ml import Model
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param.shared import HasFeaturesCol, HasPredictionCol
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressionModel
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headway.sources.shared import delete, written

#: What the trees so far leave is kept in memory or on local disks, so that a fit doesn't apply them again; after so many trees it is written, so that
#: neither plans grow nor a lost executor makes all trees be applied.
KEPT = 10


class BoostedTrees(Model, HasFeaturesCol, HasPredictionCol, MLWritable, MLReadable):
    """``prediction``: a start and a step for each tree.  features: the whole vector."""

    def __init__(self, start: float = 0.0, step: float = 0.1, columns: list[list[int]] | None = None, trees: list | None = None, size: int = 0) -> None:
        super().__init__()
        self._setDefault(featuresCol="features", predictionCol="prediction")
        self.start, self.step, self.columns, self.trees, self.size = start, step, columns or [], trees or [], size

    def _transform(self, dataset: DataFrame) -> DataFrame:
        if not self.trees:
            return dataset.withColumn(self.getPredictionCol(), F.lit(self.start))
        out = self._together().setFeaturesCol(self.getFeaturesCol()).setPredictionCol("__steps").transform(dataset)
        return out.withColumn(self.getPredictionCol(), F.lit(self.start) + F.col("__steps")).drop("__steps")

    def _together(self) -> GBTRegressionModel:
        """The trees and their steps as one model of Spark's, so that a row's vector is read once and not for each tree."""
        context = SparkContext._active_spark_context
        trees = context._gateway.new_array(context._jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, len(self.trees))
        steps = context._gateway.new_array(context._jvm.double, len(self.trees))
        for k, tree in enumerate(self.trees):
            trees[k], steps[k] = tree._java_obj, self.step
        return GBTRegressionModel(context._jvm.org.apache.spark.ml.regression.GBTRegressionModel(self.uid, trees, steps))

    @property
    def featureImportances(self) -> DenseVector:
        """The trees' importances, added up to 1."""
        total = [0.0] * self.size
        for tree in self.trees:
            for i, x in enumerate(tree.featureImportances.toArray()):
                total[i] += float(x)
        return DenseVector([x / (sum(total) or 1.0) for x in total])

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, instance: BoostedTrees) -> None:
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        m = self.instance
        DefaultParamsWriter.saveMetadata(m, path, self.sparkSession, extraMetadata={"start": m.start, "step": m.step, "columns": m.columns, "size": m.size})
        if m.trees:
            m._together().write().save(f"{path}/trees")


class _Reader(MLReader):
    def load(self, path: str) -> BoostedTrees:
        facts = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        trees = list(GBTRegressionModel.load(f"{path}/trees").trees) if facts["columns"] else []
        out = BoostedTrees(facts["start"], facts["step"], facts["columns"], trees, facts["size"])
        out._resetUid(facts["uid"])
        DefaultParamsReader.getAndSetParams(out, facts)
        return out


def fit(rows: DataFrame, names: list[str], label: str, rounds: int, depth: int, step: float = 0.1, share: float = 0.8, columns: int | None = None, seed: int = 42) -> BoostedTrees:
    """rows: ``names`` as doubles, and the label.  columns: how many of the names each tree gets (``share`` of them, rounded down, at least one)."""
    spark, size = rows.sparkSession, len(names)
    columns = columns or max(1, int(size * share))
    start = rows.agg(F.avg(label)).first()[0] or 0.0
    left = rows.select(*names, (F.col(label) - start).alias("__left")).persist()
    whole = VectorAssembler(inputCols=names, outputCol="features")
    drawn, trees, tables, before = [], [], [], None
    for k in range(rounds):
        some = sorted(random.Random(f"{seed}-{k}").sample(range(size), columns))
        kept = F.pmod(F.xxhash64(*names, "__left", F.lit(seed), F.lit(k)), F.lit(1_000_000)) < int(share * 1_000_000)
        seen = left.filter(kept).select("__left", *[F.col(n) if i in some else F.lit(0.0).alias(n) for i, n in enumerate(names)])
        tree = DecisionTreeRegressor(featuresCol="features", labelCol="__left", predictionCol="__tree", maxDepth=depth, seed=seed + k).fit(whole.transform(seen))
        drawn.append(some)
        trees.append(tree)
        if before is not None:  # the fit has read what this is made of, and keeps it
            before.unpersist()
        before = left
        left = tree.transform(whole.transform(left)).select(*names, (F.col("__left") - F.lit(step) * F.col("__tree")).alias("__left"))
        if k % KEPT == KEPT - 1 and k < rounds - 1:
            left = written(left)
            tables.append(left)
        left = left.persist()
    for table in (before, left):
        if table is not None:
            table.unpersist()
    for table in tables:
        delete(spark, table.inputFiles()[0].rsplit("/", 1)[0])
    return BoostedTrees(float(start), step, drawn, trees, size)
